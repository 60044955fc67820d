"""The pipeline's stages on a small table, each checked against its own input."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcheck.llm import quality, tokens
from quillcheck.llm.common import written

from .test_near_copies import kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_each_stage_returns_documents_and_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, SF)
        assert after.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert rows.count() > 0


def test_run_is_what_brute_force_gives(spark):
    """Every stage again over plain rows, near copies by the true similarity of their shingle sets; the classifier's score
    is the query's, which has tests of its own."""
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.quality_report(table, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in table.collect() if r.doc_id in good]
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
    seen = Counter(k for _, text, _ in rows for k in {key(x) for x in text.split("\n")})
    gone = {k for k, n in seen.items() if k and n >= 10}
    rows = [(i, "\n".join(x for x in text.split("\n") if key(x) not in gone), source) for i, text, source in rows]

    first = set(kept([(i, text) for i, text, _ in rows]))
    rows = [r for r in rows if r[0] in first]

    of = Counter(source for _, _, source in rows)
    times = {}
    for i, _, source in rows:
        rate = len(rows) / len(of) / of[source]
        u = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:12], 16) / 2**48
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        times[i] = k
    coder = tokens.coder(tokens.default_path())
    want = Counter()
    for i, text, _ in rows:
        own = [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(own), 2048)):
            part = own[at : at + 2048]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += times[i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == +want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]


EXTRA = ("score", "copy", "position", "line_count", "line_drops", "kept_text", "quality_score", "of", "tie", "c0", "first")


@pytest.fixture(scope="module")
def odd(spark, docs_schema):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns named like those that stages work with."""
    rows = [(1, "a fine text of some words", "en", "s", 5), (1, "a fine text of some words", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t", "en", "s", 3)]
    rows += [(None, "no id at all here, only words", "en", "s", 9), (5, "long words of a row " * 20_000, "en", "t", 1)]
    rows += [(10 + i, f"the same line\nown line {i}", "en", "t", 20) for i in range(12)]
    return spark.createDataFrame(rows, docs_schema).select("*", *(F.lit(f"own {n}").alias(n) for n in EXTRA))


def test_stages_take_odd_rows(spark, odd):
    keep, lines, copies, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    n = odd.count()
    for stage in (keep, lines, copies, mixed):
        got = stage(spark, odd, SF)
        assert got.dtypes == odd.dtypes, stage
        rows = got.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in EXTRA)
        assert stage(spark, odd.where("false"), SF).dtypes == odd.dtypes and not stage(spark, odd.where("false"), SF).collect()
    same = {(r.doc_id, r.text, r.n_chars) for r in odd.collect()}
    after = lines(spark, odd, SF).collect()
    assert len(after) == n and all(r.text == f"own line {r.doc_id - 10}" and r.n_chars == len(r.text) if (r.doc_id or 0) >= 10 else (r.doc_id, r.text, r.n_chars) in same for r in after)
    # Null, empty and blank texts are copies of each other, as are the rows that repeat; the rest stays.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in copies(spark, odd, SF).collect()) == [(False, i) for i in (1, 2, 5, *range(10, 22))] + [(True, 0)]
    pieces = packed(spark, odd, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in odd.collect())
    assert not packed(spark, odd.where("false"), SF).collect()


def test_run_deletes_what_stages_leave_behind(spark):
    before = len(written(spark))
    corpus_pipeline.run(spark, SF).count()
    # The four stages' results and what the last one stands on.
    assert len(written(spark)) - before <= 6
