"""Whole rounds with scripted models, a study's labels, and the guard of connections, on literal rows."""

import http.server
import json
import threading
import urllib.error

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import pages, pytext
from quillcheck.operators import cards, metrics, reader, rounds, study
from quillcheck.schemas import CLAIMS, EVIDENCE
from quillcheck.sources import ways, web

PAGE = "Zeta costs $29 per month. Zeta has no phone support. Zeta was founded in Oslo."


def evidence(spark):
    return spark.createDataFrame([(0, "e1", "https://zeta.example/", PAGE, "Zeta", "", "", "code"), (1, "e2", "https://zeta.example/b", PAGE, "Zeta", "", "", "code")], EVIDENCE)


def claims(spark, *rows):
    return spark.createDataFrame([(i, f"c{i}", text, quote, page, "Zeta", "") for i, (text, quote, page) in enumerate(rows)], CLAIMS)


GOOD = ("Zeta costs $29 per month", "Zeta costs $29 per month", "e1")


def test_both_stages(spark):
    """Only what the code kept is asked about; what has no usable answer, or two, is cut with the first error as its detail."""
    rows = claims(spark, GOOD, GOOD, ("Zeta costs $30 per month", GOOD[1], "e1"), (*GOOD[:2], "e2"), GOOD)

    def call(prompt):
        if prompt.count("<pair") == 1:
            raise RuntimeError("out of order " * 50)
        return json.dumps({"answers": [{"n": 1, "stated": True, "gap": ""}, {"n": 2, "stated": False, "gap": "a part"}, {"n": 3, "stated": True}, {"n": 3, "stated": True}, {"n": 9, "stated": True}]})

    got = {r.pos: (r.supported, r.reason, r.detail) for r in rounds.check_with_reader(rows, evidence(spark), call).collect()}
    assert got[0] == (True, "ok", "") and got[1] == (False, "not_stated", "a part") and got[2][1] == "figure_not_in_quote"
    assert got[3] == (False, "unread", ("out of order " * 50)[:300]) and got[4] == (False, "unread", "")


def test_stored_answers_are_replayed(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"reader": "a model", "readings": {"c0": [True, ""], "c1": [False, "no such price"]}, "model_calls": 3}, indent=1))
    stored = rounds.stored_readings(spark, f"file://{tmp_path}/r.json")
    assert {(r.claim_id, r.stated, r.gap, r.calls, r.cost) for r in stored.collect()} == {("c0", True, "", 3, 0.0), ("c1", False, "no such price", 3, 0.0)}
    from quillcheck.operators import check

    done = rounds.replay(check.check_claims(claims(spark, GOOD, GOOD, GOOD), evidence(spark)), stored)
    assert [(r.reason, r.detail) for r in done.orderBy("pos").collect()] == [("ok", ""), ("not_stated", "no such price"), ("unread", "")]


def test_second_quotes_pass_what_first_ones_pass(spark):
    from quillcheck.operators import check

    rows = claims(spark, ("Zeta costs $29 per month", "Zeta is cheap as can be", "e1"), ("Zeta was founded in Oslo", "founded in Bergen long ago", "e1"), ("Zeta costs $31", "costs $31 per month", "e2"), GOOD)
    first = check.check_claims(rows, evidence(spark))

    def call(prompt):
        assert "Problem: " in prompt and GOOD[1] in prompt
        return json.dumps({"quotes": [{"n": 1, "quote": "Zeta costs $29 per month."}, {"n": 2, "quote": "founded in Oslo"}, {"n": 2, "quote": "twice given"}, {"n": 7, "quote": "x"}]})

    new, done = rounds.requote(rows, first, evidence(spark), call)
    got = {r.pos: (r.supported, r.reason) for r in done.collect()}
    assert got == {0: (True, "ok"), 1: (False, "quote_not_in_source"), 2: (False, "quote_not_in_source"), 3: (True, "ok")}
    assert {r.pos: r.quote for r in new.collect()}[0] == "Zeta costs $29 per month."
    no = lambda prompt: json.dumps({"answers": [{"n": 1, "stated": False, "gap": "g"}]})
    refused = rounds.requote(rows, first, evidence(spark), call, no)[1]
    assert {r.pos: r.reason for r in refused.collect()}[0] == "quote_not_in_source"


def test_lines_need_facts_of_both_products(spark):
    facts = spark.createDataFrame([("f1", "Us", "price", "Us costs $5", "costs $5"), ("f2", "Them", "price", "Them costs $9", "costs $9")], "id string, subject string, topic string, text string, quote string")
    call = lambda prompt: json.dumps({"we_win": [{"text": "Us costs $5", "cites": ["f1"]}], "objections": [{"objection": "dear?", "response": "Them costs $8", "cites": ["f2"]}]})
    got = [(r.section, r.kept) for r in rounds.write_lines(facts, "Us", "Them", call).orderBy("line_id").collect()]
    assert got == [("we_win", True), ("objections", False)]
    assert not rounds.write_lines(facts.where("subject = 'Us'"), "Us", "Them", call).collect()
    with pytest.raises(Exception, match="1 facts at most"):
        rounds.line_prompt(facts, "Us", "Them", 1).collect()


def test_statements_of_a_reply():
    blocks = [("Here is a list of facts:\n- Zeta costs", []), (" $29 a month", [" costs $29 ", "x"]), ("\nshort one\n3) It has no phone support", []), ("", [])]
    assert pytext.statements(blocks) == [("Here is a list of facts:", "", False, 0), ("Zeta costs $29 a month", "costs $29", True, 2), ("It has no phone support", "", False, 0)]


def test_batches_without_pages_are_numbered_in_one_run(spark):
    rows = spark.range(0, 200_000, 7000).select(F.col("id").alias("pos"))
    got = [(r.batch, r.n) for r in reader.batches(rows, 10, None).orderBy("pos").collect()]
    assert got == [(i // 10, i % 10 + 1) for i in range(29)]


def test_nearest_ranks_are_those_of_sorted_values(spark):
    rows = spark.createDataFrame([("a", i % 7) for i in range(40)] + [("b", 5), ("b", None)], "g string, x int")
    got = {r.g: (r.low, r.mid) for r in metrics.nearest_ranks(rows, ["g"], "x", low=0.025, mid=0.5).collect()}
    values = sorted(i % 7 for i in range(40))
    assert got == {"a": (values[round(0.025 * 39)], values[round(0.5 * 39)]), "b": (5, 5)}


def test_many_pages_are_drawn_where_they_are(spark):
    sums = spark.range(300).select(F.col("id").cast("string").alias("page"))
    few = metrics.drawn_pages(sums, 20, 11, most=10)
    totals = {r.rep: r.n for r in few.groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    assert totals == {i: 300 for i in range(20)} and few.select("page").distinct().count() > 295


def test_label_gate(spark):
    ids = spark.range(100).select("id")
    one = ids.select("id", F.lit(True).alias("page_states"), (F.col("id") % 2 == 0).alias("quote_states"))
    two = one.withColumn("quote_states", F.col("quote_states") != (F.col("id") < 3))
    both = study.two_labellers(ids, one, two)
    settling = study.to_settle(both)
    assert settling.where("why = 'disputed'").count() == 3 and settling.where("why = 'sampled'").count() == 50
    person = settling.join(one, "id").select("id", "page_states", (~F.col("quote_states")).alias("quote_states"))
    stats = study.label_stats(both, settling, person)
    assert stats.first().overturned == 50 and not stats.first().stands
    with pytest.raises(ValueError, match="overturned"):
        study.final_labels(both, person, stats)
    assert study.label_stats(both, settling, one).first().stands
    assert study.final_labels(both, person).where("quote_states").count() > 0
    with pytest.raises(ValueError, match="no label"):
        study.label_stats(both, settling, person.limit(2))
    assert set(study.frozen(pytext, pages)) == {"quillcheck.functions.pytext", "quillcheck.functions.pages"}


def test_sections_are_escaped():
    rows = [{"text": "<b>", "quote": '"q"', "url": "https://a.example/?a&b", "supported": True, "reason": "ok"}, {"text": "cut", "quote": "", "url": "", "supported": False, "reason": "no_quote"}]
    shown = cards.section_html("A & B", rows)
    assert "&lt;b&gt;" in shown and "a&amp;b" in shown and "A &amp; B" in shown and "<s>cut</s> no_quote" in shown
    assert "<li>none</li>" in cards.section_html("x", [])


def test_brief_json_leaves_out_the_seller(spark):
    rows = claims(spark, GOOD)
    verdicts = spark.createDataFrame([(0, True, "ok", "", "u")], "pos long, supported boolean, reason string, detail string, url string")
    lines = spark.createDataFrame([(1, "message", "t", ["f1", "you"], True, "")], "line_id long, section string, text string, cites array<string>, kept boolean, reason string")
    got = {r.what: json.loads(r.value) for r in cards.brief_json(rows, verdicts, lines).collect()}
    assert got["line"]["cites"] == ["f1"] and got["signal"]["supported"]


@pytest.mark.parametrize("spec, want", [("https://a.example", ("", "https://a.example", [])), ("A B=https://a.example, https://a.example/x", ("A B", "https://a.example", ["https://a.example/x"])), ("https://a.example/?q=1", ("", "https://a.example/?q=1", []))])
def test_company_pages(spec, want):
    assert web.company_pages(spec) == want


@pytest.mark.parametrize("spec", ["", "A=", "A=ftp://x", "nothing"])
def test_no_company_pages(spec):
    with pytest.raises(ValueError, match="not a company"):
        web.company_pages(spec)


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        to = {"/in": "http://private.test/", "/on": "/end"}.get(self.path)
        self.send_response(302 if to else 200)
        if to:
            self.send_header("Location", to)
        self.send_header("Content-Type", "text/plain")
        self.end_headers()
        self.wfile.write(b"" if to else b"the end")

    def log_message(self, *_):
        pass


class _Open(web.Guard):
    """Lets the test's own server through, and judges all else."""

    def hosts(self, host):
        return ["127.0.0.1"] if host == "open.test" else super().hosts(host)


def test_redirects_and_connections_are_judged():
    server = http.server.HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    home = f"http://open.test:{server.server_port}"
    opener = web.opener(_Open(lambda host: ["10.0.0.1"]))
    try:
        assert opener.open(f"{home}/on", timeout=5).read() == b"the end"
        with pytest.raises(web.Refused, match="private address"):
            opener.open(f"{home}/in", timeout=5)
        with pytest.raises((web.Refused, urllib.error.URLError)):
            web.opener(web.Guard(lambda host: ["127.0.0.1"])).open(f"{home}/end", timeout=5)
    finally:
        server.shutdown()


def test_a_browser_asks_its_gate():
    gate = ways.Gate(web.Guard(lambda host: ["10.0.0.1"] if host == "in.test" else ["8.8.8.8"]))
    assert gate.lets("https://a.example/x") and gate.lets("data:text/plain,x") and not gate.lets("https://a.example/p.png", "image")
    assert not gate.lets("http://in.test/") and not gate.lets("ftp://a.example/") and not gate.lets("http://[bad")
    assert gate.refused == ["http://in.test/", "ftp://a.example/", "http://[bad"]


def test_ways_need_functions_of_their_own(spark):
    urls = spark.createDataFrame([(1, "https://a.example")], "seq long, url string")
    for via in ("browser", "", "pigeon"):
        with pytest.raises(ValueError):
            web.fetch(urls, via=via)
    page = web.page(ways.by_service(lambda r: {"success": True, "data": {"markdown": "word " * 60, "metadata": {"title": "T"}, "links": ["https://b.example", 3]}}, web.Guard(lambda h: ["8.8.8.8"]))("https://a.example"), "https://a.example")
    assert page[0] == "T" and page[2] == [("https://b.example", "")] and page[3] is None


def test_calls_and_costs_are_counted(spark):
    prompts = spark.createDataFrame([("e", 0, "good"), ("e", 1, "bad")], "evidence_id string, batch long, prompt string")
    told = reader.scripted({"good": "yes"})
    got = {r.batch: (r.reply, r.calls, r.cost, r.error) for r in reader.ask(prompts, lambda p: (told(p), 0.5)).collect()}
    assert got == {0: ("yes", 1, 0.5, None), 1: (None, 2, 0.0, "no reply for this prompt")}
