"""Each operator against a brute-force version, an exact round trip or held-out labels, on small tables with edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillcheck.llm import chat, dac, exact_dedup, graph, line_dedup, mixing, packing, quality, simhash, tokens, topk, warc
from quillcheck.llm.common import drop_orphans
from quillcheck.llm.cuckoo import CuckooFilter

BLANKS = " \t\n\v\f\r"
SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, docs_schema):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        rows.append((i, words(rng, rng.randrange(1, 60)), "en", f"s{i % 3}", 1))
    rows += [(200 + i, rows[0][1], "en", "hot", 1) for i in range(60)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \t\n", "en", "s0", 3), (None, "null id", "en", "s1", 7)]
    rows += [(303, "a\x1cb it's <|endoftext|> x y 3 z İ ﬁ é", "en", "s1", 9)] * 2
    rows += [(304, "very long " * 5000, "en", "s2", 50000)]
    rows += [(310 + i, f"shared LINE\nown {i}\n  shared line \n\n", "en", "s2", 5) for i in range(12)]
    return spark.createDataFrame(rows, docs_schema).withColumn("refs", F.lit(1)).withColumn("key", F.lit("x")).withColumn("of", F.lit("y")).repartition(5)


def collected(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def empty(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)


# Filters


def test_cuckoo_filter_inserts_deletes_and_resizes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    full = CuckooFilter(16)
    assert not all(full.insert(k) for k in keys)
    cuckoo = CuckooFilter.of(keys)
    assert all(k in cuckoo for k in keys)
    for k in keys[:1000]:
        assert cuckoo.delete(k)
    assert all(k in cuckoo for k in keys[1000:])
    others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(3000)]
    assert sum(k in cuckoo for k in others) < 10
    raw = np.frombuffer(b"".join(others + keys), np.uint8).reshape(-1, 32)
    heads, marks = raw[:, :8].copy().view("<u8")[:, 0], raw[:, 8:10].copy().view("<u2")[:, 0]
    assert cuckoo.probe(heads, marks).tolist() == [k in cuckoo for k in others + keys]


# 1


def brute_top_k(rows, k, every):
    good = [(i, s) for i, v in rows if i is not None and (s := topk.scaled(v, 1024)) is not None]
    out = []
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), j) for n, (j, c) in enumerate(good) if n != at and len(c) == len(q)))[:k]
            out += [(i, n, j, max(-(2**63 - 1), min(2**63 - 1, -s))) for n, (s, j) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("shard_rows, options", [(16, {"group_shards": 2, "first_wave": 1}), (8192, {})])
def test_top_k_is_exact(spark, shard_rows, options):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(500, None), (600, [math.nan] * 8), (700, [None] * 8), (800, [1.0, 2.0]), (900, [1e30] * 8), (901, [-1e30] * 8), (None, [0.1] * 8), (1000, []), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert Counter(collected(topk.top_k(df, 5, 50, shard_rows=shard_rows, **options))) == brute_top_k(rows, 5, 50)


def test_a_repeated_row_is_a_candidate_of_the_others(spark):
    df = spark.createDataFrame([(100, [1.0]), (100, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert sorted(collected(topk.top_k(df))) == [(100, 1, 100, 1024 * 1024)] * 2 + [(100, 2, 1, 512 * 1024)] * 2


def test_blocks_go_only_where_they_can_gain():
    """Of 1000 shards in 250 far clusters, a block whose scores are known goes to the few that can beat them; inner nodes prune too."""
    rng = np.random.default_rng(4)
    at = rng.normal(0, 1, (250, 16))
    at *= 5000 / np.linalg.norm(at, axis=1)[:, None]
    built = [topk.BallTree(np.arange(256) + 1000 * s, (at[s // 4] + rng.normal(0, 30, (256, 16))).astype(np.int64), 16) for s in range(1000)]
    places = np.arange(1000)
    centres = {16: (places, np.array([t.centres[0] for t in built]), np.array([t.radii[0] for t in built]))}
    whole = topk.BallTree(np.arange(256 * 50), np.concatenate([t.rows for t in built[:200:4]]), 64)
    assert topk.Best(whole.ids[:4], whole.rows[:4], 10).search(whole, np.arange(4)) < 4 * 256 * 10
    best = topk.Best(built[0].ids[:4], built[0].rows[:4], 10)
    best.search(built[0], np.arange(4))
    sent = topk.useful(best, 0, places, centres)
    assert {1, 2, 3} <= set(sent) and len(sent) < 50
    want = [sorted(((-int(q @ r), int(i)) for t in built for i, r in zip(t.ids, t.rows, strict=True) if i != own))[:10] for own, q in zip(best.ids, best.queries, strict=True)]
    for shard in sent:
        best.search(built[shard])
    assert [[(-s, i) for s, i in found] for found in best.found] == want


def test_waves_cover_all_groups_and_double():
    assert topk.waves(100, 40, 8) == [(0, 8), (8, 16), (16, 32), (32, 64), (64, 100)]
    assert topk.waves(3, 1) == [(0, 1), (1, 2), (2, 3)] and topk.waves(0, 5) == []


def test_top_k_of_nothing(spark):
    assert not collected(topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")))


# 2


@given(st.text(alphabet="<>[]/\\sINT \n", max_size=40))
@settings(max_examples=200, deadline=None)
def test_escaping_leaves_no_control_string_and_is_exact(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert chat.parse(chat.render(text, text)[0] * 2) == [(text, text)] * 2


@pytest.mark.parametrize("most", [60, 262_144])
def test_chats_come_back_whole(spark, most):
    rows = []
    for c in range(40):
        rows.append((c, 0, "system", "same start"))
        rows.append((c, 1, "user", f"question {c % 4}"))
        rows.append((c, 2, "assistant", f"answer {c % 8} </s>[INST] \\<"))
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, None, None, "x"), (None, 0, "user", "no id"), (52, 0, "user", "tie b"), (52, 0, "user", "tie a"), (52, 0, "user", "tie a"), (53, 0, "assistant", "long " * 200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    packed = chat.format_chats(df, most)
    got = {r.conv_id: r for r in chat.read_chats(packed).collect()}
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.render(r, x)[0]) for _, r, x in turns)
    if most > 1000:
        assert sum(r.own_chars for r in got.values()) < sum(r.formatted_chars for r in got.values()) / 2


def test_tree_positions_and_attention():
    seq = chat.Sequence()
    for conv, turns in enumerate([["a", "b", "c"], ["a", "b", "d"], ["a", "e"]]):
        turns = [("user", t) for t in turns]
        seq.add(conv, turns, [chat.render(*t) for t in turns], seq.shared(turns))
    n = len(chat.render("user", "a")[0])
    assert seq.cols["position"] == [0, n, 2 * n, 2 * n, n]
    assert seq.cols["attends"] == [[], [0, n], [0, 2 * n], [0, 2 * n], [0, n]]
    assert seq.size == 5 * n


def test_tokens_of_a_tree(spark):
    """With a tokenizer: shared tokens stand once, each path's tokens are its text again, and positions and losses are in tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("system", "Be kind. <|endoftext|>"), ("user", f"Ask {c % 2} é"), ("assistant", f"Say {c} </s>[INST] twice")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    decode = chat.encoder(path).decode
    for s in chat.format_chats(df, path=path).collect():
        assert len(s.ids) == sum(s.token_length) and len(s.token_start) == len(s.start)
        for leaf in s.leaf:
            spans = [*s.token_attends[leaf], s.token_start[leaf], s.token_start[leaf] + s.token_length[leaf]]
            own = [i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in s.ids[a:b]]
            chars = [*s.attends[leaf], s.start[leaf], s.start[leaf] + s.length[leaf]]
            assert decode(own, skip_special_tokens=False) == "".join(s.text[a:b] for a, b in zip(chars[::2], chars[1::2], strict=True))
            assert s.token_position[leaf] == len(own) - s.token_length[leaf]
            a = s.token_loss_start[leaf]
            learned = decode(s.ids[a : a + s.token_loss_length[leaf]], skip_special_tokens=False)
            assert learned == s.text[s.loss_start[leaf] : s.loss_start[leaf] + s.loss_length[leaf]]


def test_no_chats(spark):
    assert not collected(chat.read_chats(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))


# 3


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_quality_ignores_labels_it_may_not_learn(spark, docs_schema):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(collected(quality.quality_report(docs, labels))) == sorted(collected(quality.quality_report(docs, wrong)))


def test_quality_is_a_plain_refit(spark):
    """The query's columns again in plain Python: who is held out, the fit on the others, every score, what is predicted."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and not out[r.doc_id]}
    ids = sorted(known)
    x = np.stack([quality.features((texts[i] or "").encode()) for i in ids])
    y = np.array([known[i] for i in ids])
    mean, scale = x.mean(0), np.where(x.std(0) < 1e-6, 1.0, x.std(0))
    z = np.clip((x - mean) / scale, -8, 8).astype(float)
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    gap = z[rng.choice(good, 40_000)] - z[rng.choice(bad, 40_000)]
    w = np.zeros(z.shape[1])
    for _ in range(300):  # plain descent on the logistic loss of the same pairs
        w += 0.5 * (gap.T @ (1 / (1 + np.exp(gap @ w))) / len(gap) - 1e-3 * w)
    share = float(np.mean([q for q in (r.quality for r in labels.collect() if not zlib.crc32(str(r.doc_id).encode()) % 3 == 1)]))
    cut = np.quantile(z @ w, 1 - share)
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i].held_out == out[i] and got[i].predicted == (got[i].score >= 0.5) and 0 <= got[i].score <= 1 for i in texts)
    own = {i: float(np.clip((quality.features((texts[i] or "").encode()) - mean) / scale, -8, 8) @ w - cut) for i in texts}
    agree = np.mean([(own[i] >= 0) == bool(got[i].predicted) for i in texts])
    ranks = np.corrcoef(np.argsort(np.argsort([own[i] for i in texts])), np.argsort(np.argsort([got[i].score for i in texts])))[0, 1]
    assert agree > 0.95 and ranks > 0.9


def test_quality_learns_every_label_and_pair(spark):
    """More than 4000 rows of each label: means, loss and threshold are those of all of them, on the driver or where the rows are."""
    rng = random.Random(11)
    texts = {i: f"{words(rng, rng.randrange(1, 9))} {'!?' * rng.randrange(3) if i % 2 else rng.randrange(10**6)}" for i in range(8700)}
    texts |= {i: texts[0] for i in range(0, 60, 2)}
    known = {i: i % 2 if rng.random() < 0.9 else 1 - i % 2 for i in texts}
    docs = spark.createDataFrame([*texts.items(), (5, texts[5]), (9000, "no label")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([*known.items(), *((10_000 + i, 0) for i in range(700))], "doc_id long, quality int")
    got = quality.learn(docs, labels)
    x = np.stack([quality.features(texts[i].encode()) for i in texts]).astype(float)
    y = np.array([known[i] for i in texts])
    assert min((y == 1).sum(), (y == 0).sum()) > 4000
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.scale, np.where(x.std(0) < 1e-6, 1.0, x.std(0)))
    z = np.clip((x - got.mean) / got.scale, -8, 8)
    s = z @ got.weights
    lost = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None, :]))
    slope = lost.mean(0) @ z[y == 0] / (y == 0).sum() - lost.mean(1) @ z[y == 1] / (y == 1).sum() + 1e-3 * got.weights
    assert np.abs(slope).max() < 2e-4 and np.abs(got.weights).max() > 0.1
    share = (y == 1).sum() / (len(y) + 700)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    values = np.unique(s.round(9))
    up_to = np.cumsum(np.bincount(np.searchsorted(values, s.round(9)), weight))
    at = int(np.searchsorted(up_to, 1 - share, "right"))
    assert abs(got.threshold - (values[at - 1] + values[at]) / 2) < 1e-6

    near = quality.learn(docs.repartition(2), labels, local_blocks=64)
    for name in ("mean", "scale", "weights", "threshold"):
        assert np.array_equal(getattr(got, name), getattr(near, name))


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert {r.score for r in quality.quality_report(docs, none).collect()} == {0.5}
    assert not collected(quality.quality_report(empty, labels))


# 4


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7} é</p>") for i in range(50)]
    rows += [(60, None, None), (61, "http://h/a b\r\nX: y", ""), (62, "http://h/c", "big " * 100_000), (None, "http://h/n", "lone"), (None, "http://h/n", "lone"), (5, "http://h/5", "<p>page 5 é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("first", F.lit(1)).repartition(3)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    want = Counter()
    for i, _, h in rows:
        f = first[h or ""]
        data = (h or "").encode()
        want[i, len(data), warc.base32_sha1(data), "response" if i == f else "revisit", None if i == f else f] += 1
    assert Counter(collected(warc.round_trip(df, file_bytes=2000))) == want
    index, folder = warc.write(df)
    got = warc.read(index.where("page_id in (3, 62)"), folder).collect()
    assert {r.page_id: r.payload.decode() for r in got} == {3: "<p>page 3 é</p>", 62: "big " * 100_000}
    assert not collected(warc.round_trip(df.where("false")))


def test_records_have_ids_of_their_own(spark):
    rows = [(1, "http://h/1", "same"), (1, "http://h/1", "same"), (None, "http://h/n", "lone"), (None, "http://h/n", "lone"), (2, "http://h/2", "same")]
    index, folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    fs, root = warc.storage(folder)
    heads = []
    for r in index.collect():
        with fs.open_input_file(f"{root}/{r.file}") as f:
            heads.append(warc.parse(f.read_at(r.length, r.offset))[0])
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    (revisit,) = (h for h in heads if h["WARC-Type"] == "revisit")
    assert revisit["WARC-Refers-To-Target-URI"] == "http://h/1" and revisit["X-Refers-To-Page-Id"] == "1"


def test_orphans_go(spark):
    index, folder = warc.write(spark.createDataFrame([(1, "http://h/1", "x")], "page_id long, url string, html string"))
    fs, root = warc.storage(folder)
    with fs.open_output_stream(f"{root}/part-000000-left.warc.gz") as f:
        f.write(b"half")
    assert drop_orphans(spark, folder, index) == 1
    assert [r.page_id for r in warc.read(index, folder).collect()] == [1]


def test_byte_ranges_are_joined():
    assert warc.ranges([(0, 10), (10, 10), (100, 5), (10_000, 5)], gap=100, most=1000) == [(0, 105, 3), (10_000, 5, 1)]


# 5


def test_exact_dedup(docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.translate(dict.fromkeys(map(ord, BLANKS)))].append((-len(t), i is None, i or 0, i, t))
    want = Counter()
    for key, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            want[m[3], members[0][3], len(members), n == 0, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter(collected(exact_dedup.exact_dedup(docs))) == want
    assert not collected(exact_dedup.exact_dedup(empty))


def test_index_takes_insertions_and_deletions(docs):
    rows = exact_dedup.text_digests(docs)
    some = rows.where("doc_id < 100")
    index = exact_dedup.CuckooIndex(None, 16).insert(some)
    more = index.insert(rows)
    back = more.delete(rows)
    count = lambda df: {bytes(r[0]): r[1] for r in df.collect()}
    assert count(index.keys()) == count(back.keys()) == count(some.groupBy("digest").count())
    assert count(more.keys()) == count(rows.unionByName(some).groupBy("digest").count())
    assert not back.delete(some).keys().count()


# 6


def brute_lines(rows, least):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(BLANKS))
    seen = Counter(k for _, ls in split for k in {key(x) for x in ls})
    gone = {k for k, n in seen.items() if k and n >= least}
    out = Counter()
    for i, ls in split:
        stay = [x for x in ls if key(x) not in gone]
        out[i, len(ls), len(ls) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("task_lines", [5, 10**6])
def test_line_dedup(docs, empty, task_lines):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(collected(line_dedup.line_report(docs, task_lines=task_lines))) == brute_lines(rows, 10)
    assert not collected(line_dedup.line_report(empty, task_lines=task_lines))
    whole = line_dedup.line_dedup(docs, task_lines=task_lines)
    assert whole.columns[: len(docs.columns)] == docs.columns and whole.where("of = 'y' and key = 'x'").count() == len(rows)


CLASHING = ("raw", "own", "of", "gone", "__text", "__gone", "__of", "__u", "__times", "__source", "run", "parts", "cdf", "times", "line_count", "quality_score", "Key")


def test_columns_of_any_name_pass_through(spark, docs):
    """Working columns have names that the input's have not."""
    own = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"own {n}").alias(n) for n in CLASHING))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    lines = line_dedup.line_dedup(own)
    scored = quality.classify(own, labels, name="score of mine")
    mixed = mixing.mix(own)
    for got, new in ((lines, {"line_count"}), (scored, set()), (mixed, set())):
        rows = got.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in CLASHING if n not in new)
    assert scored.columns == [*own.columns, "score of mine"]


def test_many_dropped_lines_have_one_way(spark, docs_schema):
    """Filters of many shards, each with a part of the dropped keys."""
    rows = [(i, "\n".join(f"line {k}" for k in range(i % 7, 3000, 7)) + f"\nown {i}", "en", "s", 1) for i in range(70)]
    df = spark.createDataFrame(rows, docs_schema).repartition(4)
    index = line_dedup.LineIndex(shards=256).insert(df)
    assert index.dropped().count() == 3000 and index.cells.count() == 256
    got = line_dedup.drop_lines(df, index, 100).collect()
    assert all(bytes(r.kept_text).decode() == f"own {r.doc_id}" for r in got) and len(got) == 70


def test_line_index_can_be_undone(docs):
    some, rest = docs.where("doc_id < 315 or doc_id is null"), docs.where("doc_id >= 315")
    index = line_dedup.LineIndex().insert(some)
    back = index.insert(rest).delete(rest)
    table = lambda x: {bytes(r.key): r.refs for r in x.refs.collect()}
    assert table(index) == table(back)
    marks = lambda x: sum(np.count_nonzero(np.frombuffer(r.filter, np.uint16)) for r in x.cells.collect())
    assert marks(index) == marks(back) == index.dropped().count() < marks(index.insert(rest))
    rows = [(r.doc_id, r.text) for r in some.collect()]
    done = line_dedup.drop_lines(some.select("doc_id", "text"), back)
    got = Counter((r.doc_id, r.line_count, r.line_drops, hashlib.sha256(r.kept_text).hexdigest()) for r in done.collect())
    assert got == brute_lines(rows, 10)


# 7 and 8


@pytest.fixture(scope="module")
def ids():
    coder = tokens.coder(tokens.default_path())
    return lambda text: coder.tokenizer.encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("ab'sé́ﬁİ3<|endoftx>\x1c   \n\t\r"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_word_cache_gives_the_tokenizers_ids(text):
    coder = tokens.coder(tokens.default_path())
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_cache_on_latin_words_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    coder = tokens.WordCoder(tokens.default_path())
    rng = random.Random(2)
    for _ in range(300):
        own = ["".join(rng.choice("abcdeABÉéßẞñÑçİıſŁø,.'") for _ in range(rng.randrange(1, 9))) for _ in range(20)]
        text = " ".join([*own, *(w + rng.choice(",.") for w in own), "H\u0331 ΑΣ, ΟΔΟΣ. café cafe\u0301. ..., é,. don't."])
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bucket", [3, 10**6])
def test_packing(docs, empty, ids, bucket):
    size = 64
    got = packing.pack(docs, size=size, bucket=bucket).collect()
    want = Counter()
    for r in docs.collect():
        own = [*ids(r.text), 0]
        for k, a in enumerate(range(0, len(own), size)):
            part = own[a : a + size]
            want[r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    assert not collected(packing.pack(empty))


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_all_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    for n in rng.integers(20, 257, 300):
        counts[n] += rng.integers(1, 500)
    plan = packing.solve(counts, 256)
    placed = np.zeros(257, np.int64)
    for filling, n in plan:
        assert sum(a * b for a, b in filling) <= 256
        for a, b in filling:
            placed[a] += b * n
    assert (placed == counts).all()
    assert sum(n for _, n in plan) <= sum(packing.best_fit(counts, 256).values())


def test_configuration_program_beats_best_fit():
    rng = np.random.default_rng(1)
    counts = np.zeros(2049, np.int64)
    for n in rng.integers(500, 1100, 300):
        counts[n] += rng.integers(1, 500)
    assert sum(n for _, n in packing.solve(counts)) < sum(packing.best_fit(counts, 2048).values())


def test_a_share_of_the_program_is_that_share():
    """Rounding keeps the amount of sequences, as far as pieces last."""
    sizes, wanted = np.array([50, 34, 33, 20]), np.array([400.0, 1000.0, 1000.0, 600.0])
    amounts = packing.program(sizes, wanted, 100)
    for share in (0.1, 0.5):
        n = sum(n for _, n in packing.rounded(amounts, share, wanted))
        assert abs(n - share * sum(amounts.values())) <= 1


def test_smallest_pieces_are_left_to_best_fit():
    sizes = np.array([50, 34, 33, 20])
    assert packing.without_smallest(((0, 1), (3, 2)), sizes) == ((0, 1), (3, 1))
    assert packing.without_smallest(((0, 1), (3, 1)), sizes) == ((0, 1),)
    assert packing.without_smallest(((2, 1),), sizes) == ((2, 1),)


def test_program_covers_its_classes():
    sizes, wanted = np.array([50, 34, 33, 20]), np.array([40.0, 100.0, 100.0, 60.0])
    covered = np.zeros(4)
    for configuration, amount in packing.program(sizes, wanted, 100).items():
        assert sum(sizes[k] * n for k, n in configuration) <= 100
        for k, n in configuration:
            covered[k] += n * amount
    assert (covered > 0.9 * wanted).all()


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_are_directly_addressable(values, data):
    codes = dac.Codes(dac.encode(np.array(values, np.uint32)))
    assert codes[:].tolist() == values
    if values:
        a, b = sorted(data.draw(st.tuples(st.integers(0, len(values)), st.integers(0, len(values)))))
        assert codes[a:b].tolist() == values[a:b]
        i = data.draw(st.integers(0, len(values) - 1))
        assert codes[i].tolist() == [values[i]]


@pytest.mark.parametrize("file_ids", [100, 10**6])
def test_token_files(docs, empty, ids, file_ids):
    rows = sorted(((r.doc_id, [*ids(r.text), 2]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = Counter(), 0
    for doc, own in rows:
        want[doc, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
        at += len(own)
    assert Counter(collected(dac.report(docs, file_ids=file_ids))) == want
    assert not collected(dac.report(empty))
    index, folder = dac.write(docs, file_ids=file_ids)
    some = dac.read(index.where("doc_id in (5, 304)"), folder, batch_ids=10).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in some} == {d: own for d, own in rows if d in (5, 304)}


# 9


def brute_simhash(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in BLANKS:
        low = low.replace(c, " ")
    w = low.split(" ")
    w = [x for x in w if x]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, radius):
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= radius:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, f"{a:016x}", least.get(top(i))) for i, (d, a) in enumerate(rows))


def test_near_components(docs, empty):
    rows = [(r.doc_id, brute_simhash(r.text)) for r in docs.collect()]
    assert Counter(collected(simhash.near_components(docs))) == brute_components(rows, 3)
    assert not collected(simhash.near_components(empty))


@pytest.mark.parametrize("full", [8, 2048])
def test_linked_chains_of_fingerprints(spark, full, monkeypatch):
    rng = random.Random(5)
    rows, x = [], rng.getrandbits(64)
    for i in range(150):
        x = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if i % 30 else rng.getrandbits(64)
        rows.append((1000 - i, x))
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in rows], "doc_id long, fp binary")
    monkeypatch.setattr(simhash.links, "__defaults__", (full,))
    groups = simhash.near_groups(df, 3).collect()
    got = {int.from_bytes(r.fp, "big"): r.component_id for r in groups}
    want = brute_components(rows, 3)
    assert Counter((d, f"{v:016x}", got[v]) for d, v in rows) == want


@pytest.mark.parametrize("n", [10, 10**8, 10**13])
def test_masks_meet_whatever_links(n):
    rng = random.Random(n)
    chosen = simhash.masks(3, n)
    assert len(chosen) == {10: 4, 10**8: 10, 10**13: 20}[n]
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not x & m for m in chosen)


def test_more_blocks_give_the_same_groups(docs, monkeypatch):
    rows = [(r.doc_id, brute_simhash(r.text)) for r in docs.collect()]
    few = simhash.masks
    monkeypatch.setattr(simhash, "masks", lambda radius, n: few(radius, 10**13))
    assert Counter(collected(simhash.near_components(docs))) == brute_components(rows, 3)


def test_components_of_paths_stars_and_trees(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2000 + rng.randrange(i)) for i in range(1, 200)] + [(5, 4), (7, 7)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges], "a binary, b binary")
    groups = defaultdict(set)
    for r in graph.components(df).collect():
        groups[bytes(r.label)].add(int.from_bytes(r.node, "big"))
    assert sorted(map(sorted, groups.values())) == [list(range(301)), list(range(1000, 1201)), list(range(2000, 2200))]
    assert all(int.from_bytes(k, "big") in v for k, v in groups.items())
    assert not collected(graph.components(df.where("false")))


def test_near_dedup_keeps_one_of_each_group(spark, docs_schema):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        w = words(rng, 300).split()
        rows.append((i, " ".join(w), "en", "a", 1))
        w[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(w), "en", "a", 1))
    rows += [rows[0], (200, "a lone short text", "en", "a", 1), (None, "no id and other words than all", "en", "a", 1)]
    df = spark.createDataFrame(rows, docs_schema)
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x)) == [*range(30), 200, None]


# 10


def test_mixing_counts_and_weights(spark, docs_schema):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(6000)] + [(9999, None, None, None, None)]
    df = spark.createDataFrame(rows, docs_schema).withColumn("rate", F.lit(5)).withColumn("copy", F.lit(7))
    got = mixing.mix(df, {"hot": 1.0, "s1": 3.0}, total=2.0)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(counts) == {"hot", "s1"}
    assert abs(counts["hot"] - 3000) < 200 and abs(counts["s1"] - 9000) < 400
    assert got.columns[:-2] == [c for c in df.columns if c != "copy"]
    per = Counter((r.doc_id, r.copy) for r in got.collect())
    assert max(per.values()) == 1
    again = Counter((r.doc_id, r.copy) for r in mixing.mix(df.repartition(7), {"hot": 1.0, "s1": 3.0}, total=2.0).collect())
    assert again == per


def test_mixing_inverts_the_poisson_distribution(spark, docs):
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    rows = docs.collect()
    n = Counter(r.source for r in rows)
    for r in rows:
        rate = len(rows) / len(n) / n[r.source]
        u = int(hashlib.md5(f"42|{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        assert got[r.doc_id] == k * sum(x.doc_id == r.doc_id for x in rows)


@pytest.mark.parametrize("rate", [150.0, 1e6])
def test_large_rates(spark, docs_schema, rate):
    """A rate beyond what is drawn at once: parts that add up to a draw of the same distribution."""
    n = 40 if rate < 1000 else 1
    rows = [(i, "", "en", "rare", 1) for i in range(n)]
    df = spark.createDataFrame(rows, docs_schema)
    counts = {r.doc_id: r["count"] for r in mixing.mix(df, total=rate, shuffled=False).groupBy("doc_id").count().collect()}
    draws = np.array(list(counts.values()))
    assert len(draws) == n and abs(draws.mean() - rate) < 5 * math.sqrt(rate / n)
    if n > 1:
        assert 0.4 * rate < draws.var() < 2 * rate
        for i, k in counts.items():
            want = 0
            for j in range(3):
                name = f"42|{i}" if not j else f"42|part|{j}|{i}"
                u, own = int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / 2**48, 0
                total = math.exp(-rate / 3)
                while total <= u:
                    own += 1
                    total += math.exp(-rate / 3 + own * math.log(rate / 3) - math.lgamma(own + 1))
                want += own
            assert k == want


def test_mixing_nothing(empty):
    assert not collected(mixing.mix(empty))


def test_codes_read_only_what_an_answer_needs():
    """A slice and a single id of a large file touch a small part of its bytes."""
    values = np.random.default_rng(3).integers(0, 49_000, 200_000).astype(np.uint32)
    data, read = dac.encode(values), []

    def at(n, place):
        read.append(n)
        return data[place : place + n]

    codes = dac.Codes(at)
    assert codes[123_456].tolist() == [values[123_456]] and codes[150_000:150_300].tolist() == values[150_000:150_300].tolist()
    assert sum(read) < 3000 < len(data)


def test_word_coder_leaves_other_vocabularies_to_the_library(tmp_path):
    """A file with another pattern is not cut into words."""
    import json

    own = json.loads(open(tokens.default_path(), encoding="utf-8").read())
    own["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    (tmp_path / "other.json").write_text(json.dumps(own), encoding="utf-8")
    other = tokens.WordCoder(str(tmp_path / "other.json"))
    assert tokens.coder(tokens.default_path()).by_word and not other.by_word
    for text in ("don't stop, 12 times", "Straße ß 2.5!!"):
        assert np.frombuffer(other.encode(text), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
