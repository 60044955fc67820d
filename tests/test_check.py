"""Verdicts, readers, ledgers, audits, cards and statistics on literal rows."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import textexpr as X
from quillcheck.operators import audit, cards, check, metrics, reader
from quillcheck.plans import queries
from quillcheck.schemas import CLAIMS, EVIDENCE
from quillcheck.sources import files

PAGE = "Zeta Desk costs $29 per month for each agent. It does not offer phone support on weekends. Teams of five percent more pay $425 million."


def evidence(spark):
    rows = [(0, "e1", "https://www.zeta-desk.example/pricing", PAGE, "Zeta Desk pricing", "2024-01-01T00:00:00Z", "", "code"), (1, "e2", "http://[bad", None, None, None, None, None)]
    return spark.createDataFrame(rows, EVIDENCE)


CASES = [
    ("Zeta Desk costs $29 per month", "costs $29 per month", "e1", "Zeta Desk", "ok"),
    ("Zeta Desk costs $29 per month", "costs $29 per month", "gone", "Zeta Desk", "no_evidence"),
    ("Zeta Desk costs $29 per month", "costs", "e1", "Zeta Desk", "no_quote"),
    ("Zeta Desk costs $29 per month", "costs $31 per month", "e1", "Zeta Desk", "quote_not_in_source"),
    ("Omega costs $29 per month", "costs $29 per month", "e1", "Omega", "wrong_subject"),
    ("It costs $29 per month", "costs $29 per month", "e1", "", "wrong_subject"),
    ("Zeta Desk costs $30 per month", "costs $29 per month", "e1", "Zeta Desk", "figure_not_in_quote"),
    ("Zeta Desk costs 29 per month", "costs $29 per month", "e1", "Zeta Desk", "figure_not_in_quote"),
    ("They pay $425", "pay $425", "e1", "Zeta Desk", "figure_not_in_quote"),
    ("Zeta Desk offers phone support on weekends", "phone support on weekends", "e1", "Zeta Desk", "polarity_mismatch"),
    ("Zeta Desk costs $29 and wins every award worldwide", "costs $29 per month", "e1", "Zeta Desk", "beyond_quote"),
    ("teams of 5% more", "Teams of five percent more", "e1", "Zeta Desk", "ok"),
    (None, None, None, None, "no_evidence"),
    ("x", "three words here", "e2", "x", "quote_not_in_source"),
]


def verdicts(spark, **options):
    claims = spark.createDataFrame([(i, "same id", *c[:4], None) for i, c in enumerate(CASES)], CLAIMS)
    return check.check_claims(claims, evidence(spark), **options)


def test_first_failing_test_is_the_reason(spark):
    got = {r.pos: r for r in verdicts(spark).collect()}
    assert [got[i].reason for i in range(len(CASES))] == [c[4] for c in CASES]
    assert got[6].detail == "30" and got[1].detail == "gone" and got[10].detail == "20% of its words are in the quote"
    assert got[0].match == "exact" and got[3].match is None


def test_one_python_node_for_claims_and_one_for_pages(spark):
    """Pages are brought to compared form before they meet their claims, so once each; claims are read in one pass after that."""
    plan = verdicts(spark).where("supported")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    claims, pages = (i for i in range(len(plan)) if plan.startswith("ArrowEvalPython", i))
    assert claims < plan.index("Join") < pages


def test_stale_marks_and_never_cuts(spark):
    got = verdicts(spark, max_age_days=30, now="2024-03-01").where("supported").collect()
    assert got and all(r.stale for r in got)
    assert not any(r.stale for r in verdicts(spark, max_age_days=90, now="2024-03-01").collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], CLAIMS)
    assert not check.check_claims(none, evidence(spark)).collect()
    assert check.report(check.check_claims(none, evidence(spark))).first().exit_code == 0


def test_reader_only_cuts(spark):
    v = verdicts(spark)
    r = spark.createDataFrame([(0, False, "a part"), (6, True, "")], "pos long, stated boolean, gap string")
    got = {x.pos: (x.reason, x.detail) for x in reader.merge_readings(v, r).collect()}
    assert got[0] == ("not_stated", "a part") and got[6][0] == "figure_not_in_quote" and got[11][0] == "unread"


def test_reader_stage_end_to_end(spark):
    rows = [(i, "t <b>", "q", "p1" if i < 12 else "p2") for i in range(14)]
    batched = reader.batches(spark.createDataFrame(rows, "pos long, text string, quote string, evidence_id string"))
    prompts = reader.prompts(batched)
    assert sorted((r.evidence_id, r.batch, r["size"]) for r in prompts.collect()) == [("p1", 0, 10), ("p1", 1, 2), ("p2", 0, 2)]
    assert not any("<b>" in r.prompt for r in prompts.collect())

    def call(prompt):
        if prompt.count("<pair") == 10:
            raise RuntimeError("no answer")
        return json.dumps({"answers": [{"n": 1, "stated": True, "gap": ""}, {"n": 2, "stated": False, "gap": "g"}, {"n": 2, "stated": True, "gap": ""}, {"n": 9, "stated": True}]})

    replies = reader.ask(prompts, call).join(prompts.select("evidence_id", "batch", "size"), ["evidence_id", "batch"])
    assert {r.error for r in replies.collect()} == {None, "no answer"}
    answers = reader.parse_answers(replies).join(prompts.select("evidence_id", "batch", "size"), ["evidence_id", "batch"])
    once = reader.answers_once(answers, ("evidence_id", "batch")).collect()
    assert sorted((r.evidence_id, r.batch, r.n, r.stated) for r in once) == [("p1", 1, 1, True), ("p2", 0, 1, True)]


def test_probabilities(spark):
    v = spark.createDataFrame([(i, True, "ok", "") for i in range(4)], "pos long, supported boolean, reason string, detail string")
    p = spark.createDataFrame([(0, 0.5), (1, 0.49), (2, float("nan"))], "pos long, p double")
    assert [r.reason for r in reader.merge_probabilities(v, p).orderBy("pos").collect()] == ["ok", "not_stated", "unread", "unread"]
    with pytest.raises(ValueError, match="threshold"):
        reader.merge_probabilities(v, p, 0)


def test_claims_and_ledgers_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"claims": [{"text": "t"}, {"id": "x", "quote": null}]}')
    assert [(r.pos, r.id, r.text, r.quote) for r in files.read_claims(spark, f"file://{tmp_path}/a.json").orderBy("pos").collect()] == [(0, "c1", "t", ""), (1, "x", "", "")]
    (tmp_path / "b.json").write_text('"nothing"')
    with pytest.raises(Exception, match="list of objects"):
        files.read_claims(spark, f"file://{tmp_path}/b.json").collect()
    pages = files.add_text(spark.createDataFrame([(i, "u", "T", t, "", "code") for i, t in enumerate(["A", "B", "A"])], "seq long, url string, title string, text string, fetched_at string, via string"))
    got = {r.text: r for r in pages.collect()}
    assert len(got) == 2 and got["A"].seq == 2 and got["B"].id.startswith(got["A"].id + ".")
    rows = [json.loads(r.value) for r in files.ledger_json(pages).collect()]
    (tmp_path / "l.json").write_text(json.dumps([r | {"unknown": 1} for r in rows]))
    assert files.read_ledger(spark, f"file://{tmp_path}/l.json").count() == 2
    (tmp_path / "m.json").write_text(json.dumps([rows[0] | {"text": "changed"}]))
    with pytest.raises(Exception, match="does not fit its hash"):
        files.read_ledger(spark, f"file://{tmp_path}/m.json").collect()
    assert files.latest(pages).first().id == got["A"].id
    assert files.read_jsonl(spark, f"file://{tmp_path}/none", "a int").count() == 0
    files.write_jsonl(pages, f"file://{tmp_path}/out")
    assert files.read_jsonl(spark, f"file://{tmp_path}/out", pages.schema.simpleString()[7:-1].replace(":", " ")).count() == 2


def test_pages_and_sinks(spark, tmp_path):
    (tmp_path / "a.html").write_text(f"<title>T</title><p>{'word ' * 60}</p>")
    (tmp_path / "b.txt").write_text("Just a moment... " + "x" * 300)
    got = {r.path.rpartition("/")[2]: r for r in files.pages_from_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.html"].usable and got["a.html"].title == "T" and not got["b.txt"].usable
    lines = [r.line for r in files.console_lines(verdicts(spark)).orderBy("pos").collect()]
    assert lines[0].startswith("PASS") and lines[6].endswith("(30)")
    v = verdicts(spark).withColumn("detail", F.lit('<a href="x">&'))
    assert "&lt;a href=&quot;x&quot;&gt;&amp;" in files.html_rows(v).first().html


def test_audit(spark):
    text = "- Rated 4.5/5 by 900 users (https://x.example/a).\n\n| a | $20 |\n|---|---|\nAccording to Gartner it grew."
    texts = spark.createDataFrame([(1, text)], "doc long, text string")
    found = audit.specifics(texts)
    assert Counter((r.kind, r.linked) for r in found.collect()) == Counter({("RATING", True): 1, ("COUNT", True): 1, ("MONEY", False): 1, ("ATTRIBUTION", False): 2})
    sources = spark.createDataFrame([(0, "u0", "Something else."), (1, "u1", "It grew. Gartner says it grew according to plan. A table has $20 in a.")], "seq long, url string, text string")
    traced = audit.trace(found, sources)
    assert {(r.kind, r.traced_to) for r in traced.collect()} >= {("ATTRIBUTION", "u1"), ("RATING", None)}
    row = audit.summary(traced, texts).first()
    assert row.lines == 3 and row.specifics == 5 and row.linked == 2


def test_lines_stand_on_facts(spark):
    facts = spark.createDataFrame([("f1", "Zeta costs $29", "costs $29"), ("f2", "Zeta does not offer calls", "does not offer calls")], "id string, text string, quote string")
    lines = spark.createDataFrame(
        [(1, "we_win", "Zeta costs $29", "", ["f1"]), (2, "we_win", "Zeta", "", []), (3, "we_win", "Zeta", "", ["f1", "no"]), (4, "advice", "Say 29 twice", "", ["f1"]), (5, "advice", "Zeta offers calls", "", ["f2"]), (6, "we_win", "Brilliant heroic margins", "", ["f1"]), (7, "advice", "Brilliant heroic margins", "", ["f1"])],
        "line_id long, section string, text string, objection string, cites array<string>",
    )
    got = {r.line_id: (r.kept, r.reason) for r in cards.check_lines(lines, facts, "Zeta").collect()}
    assert [got[i][0] for i in range(1, 8)] == [True, False, False, False, False, False, True]
    brief = cards.check_brief_lines(lines.withColumn("section", F.lit("why_now")), facts, "Zeta", "We sell desks")
    assert not {r.line_id: r for r in brief.collect()}[2].kept


def test_second_quotes(spark):
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "pos long, quote string")
    answers = spark.createDataFrame([(1, "ONE"), (2, "better"), (3, "x"), (3, "y")], "pos long, quote string")
    assert [tuple(r) for r in cards.second_quotes(answers, first).collect()] == [(2, "better")]


def test_pick_pages(spark):
    home = "https://www.acme.example"
    urls = ["https://other.example/news", "https://acme.example/a/b/news", "https://acme.example/company/careers", "https://blog.acme.example/", "https://acme.example/press", "https://acme.example/about.pdf", "https://acme.example/about/"]
    links = spark.createDataFrame([(1, home, i, u) for i, u in enumerate(urls)], "page_id long, home string, pos int, url string")
    assert [(r.kind, r.url) for r in cards.pick_pages(links).collect()] == [("news", urls[3]), ("careers", urls[2]), ("about", urls[6])]
    assert cards.pick_pages(links, 1).count() == 1


def test_statistics(spark):
    rows = spark.createDataFrame([(i, f"p{i % 3}", i % 4 != 0, i % 2 == 0, True, i % 3 != 0) for i in range(24)], "id long, page string, true boolean, code boolean, on_page boolean, said_yes boolean")
    got = {r.arm: (r.wrong, r.delivered) for r in metrics.error_rate(metrics.arms(rows), "true").collect()}
    assert got == {"keep_all": (6, 24), "quote_on_page": (6, 24), "code_only": (6, 12), "reader_only": (4, 16), "both": (4, 8)}
    top, bottom = F.when(~F.col("true"), 1).otherwise(0), F.lit(1)
    low, high = metrics.bootstrap(rows, "page", top, bottom, 200).first()
    rng, values = random.Random(11), []
    for _ in range(200):
        d = [i for p in rng.choices(["p0", "p1", "p2"], k=3) for i in range(24) if f"p{i % 3}" == p]
        values.append(sum(i % 4 == 0 for i in d) / len(d))
    values.sort()
    assert (low, high) == (round(values[round(0.025 * 199)], 4), round(values[round(0.975 * 199)], 4))
    w = spark.range(1).select(metrics.wilson(F.lit(52), F.lit(60)).alias("w"), metrics.wilson(F.lit(0), F.lit(0)).alias("z")).first()
    assert [round(x, 2) for x in w.w] == [0.76, 0.93] and list(w.z) == [0.0, 1.0]
    assert rows.agg(metrics.kappa(F.col("code"), F.col("code")).alias("k")).first().k == 1.0
    curve = metrics.threshold_curve(rows.select("true", F.lit(True).alias("past_code"), (F.col("id") / 24).alias("p")), [0.25, 0.5, 0.75])
    assert tuple(metrics.pick_threshold(curve, 3).first()) == (0.5, True)
    assert tuple(metrics.pick_threshold(curve, 99).first()) == (0.75, False)
    with pytest.raises(ValueError, match="no label"):
        metrics.need_all(rows, rows.where("id < 5").select("id", F.lit(1).alias("l")), "id")


def test_addresses_that_share_an_id_are_told_apart(spark):
    """The addresses of orders 28888 and 113323 have the same first eight digits of their hash."""
    urls = ["https://orders.example/28888", "https://orders.example/113323"]
    rows = [(i, u, "T", t, "", "code") for i, (u, t) in enumerate([(urls[0], "A"), (urls[1], "B"), (urls[0], "C"), (urls[1], "B")])]
    pages = files.add_text(spark.createDataFrame(rows, "seq long, url string, title string, text string, fetched_at string, via string")).collect()
    base = spark.range(1).select(X.evidence_id(F.lit(urls[1])).alias("i")).first().i
    got = {r.text: r for r in pages}
    assert len(pages) == len({r.id for r in pages}) == 3
    assert got["A"].id == base and got["B"].id.startswith(f"{base}.") and got["C"].id.startswith(f"{base}.") and got["B"].seq == 3


def test_claims_on_pages_whose_addresses_share_an_id(spark, tmp_path):
    keys = spark.createDataFrame([(k,) for k in (28888, 113323, 9014, 111831, 8)], "o_orderkey long")
    keys.selectExpr("o_orderkey", "100.5D as o_totalprice", "'5-LOW' as o_orderpriority", "timestamp '1996-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.pos, r.reason) for r in queries.order_verdicts(spark, str(tmp_path)).collect())
    assert got == [(8, "ok"), (9014, "no_quote"), (28888, "ok"), (111831, "no_evidence"), (113323, "polarity_mismatch")]
