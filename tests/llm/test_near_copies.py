"""Near copies in the pipeline, beside brute force over the shingle sets."""

import random

import pytest

from quillcheck.llm import simhash


def sets(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def kept(rows):
    """The smallest id of each group that pairs at 0.8 or more join."""
    root, own = list(range(len(rows))), [sets(t) for _, t in rows]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted(least.values())


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def left(spark, schema, rows):
    return sorted(r.doc_id for r in simhash.near_dedup(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], schema)).collect())


@pytest.mark.parametrize("block", [4, 256])
def test_both_sides_of_the_similarity(spark, docs_schema, block, monkeypatch):
    """Pairs at 0.70 to 0.90, and families whose members are near some others of their own only."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng, rows = random.Random(9), []
    for i in range(200):
        n, j = rng.choice([60, 300, 450]), rng.choice([0.7, 0.75, 0.78, 0.79, 0.8, 0.8, 0.81, 0.82, 0.85, 0.9])
        common = round(2 * n * j / (1 + j) + 0.5)
        w = fresh(rng, n + 4)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: common + 4] + fresh(rng, n - common)))]
    for f in range(3):
        base = fresh(rng, 200)
        for k in range(25):
            at = rng.randrange(60)
            rows.append((1000 + 100 * f + k, " ".join(fresh(rng, at) + base[at:])))
    want = kept(rows)
    assert 240 < len(want) < 400
    assert left(spark, docs_schema, rows) == want


def test_given_documents_are_kept_as_brute_force_does(spark, docs_schema):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert left(spark, docs_schema, rows) == kept(rows)


def test_a_repeated_shingle_counts_once(spark, docs_schema):
    rng, rows = random.Random(10), []
    for i in range(20):
        # Two that share a run of one word only, and two copies of which one has such a run.
        rows += [(10 * i + k, " ".join(fresh(rng, 300) + ["0"] * 70)) for k in range(2)]
        w = fresh(rng, 300)
        rows += [(10 * i + 2, " ".join(w)), (10 * i + 3, " ".join(w + ["0"] * 200))]
    want = kept(rows)
    assert want == [10 * i + k for i in range(20) for k in range(3)]
    assert left(spark, docs_schema, rows) == want


def test_rows_go_by_id_and_text(spark, docs_schema):
    rng = random.Random(11)
    a, b, c, d, e = (" ".join(fresh(rng, 100)) for _ in range(5))
    # 5 stands on a copy and on a text of its own, 6 on two such texts; one of two copies without an id is a copy of 1 as well.
    rows = [(1, a), (5, a + " more"), (5, b), (6, c), (6, d), (6, d), (None, a + " other"), (None, e), (None, e + " last")]
    got = simhash.near_dedup(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], docs_schema)).collect()
    last = {r.text for r in got if r.doc_id is None}
    assert len(got) == 5 and len(last) == 1 and last <= {e, e + " last"}
    assert {(r.doc_id, r.text) for r in got if r.doc_id is not None} == {(1, a), (5, b), (6, c), (6, d)}
