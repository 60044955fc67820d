"""Fetching by a stand-in, extraction, advice, comparisons of arms and tracing, on literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import pytext as P
from quillcheck.functions.figures import figures
from quillcheck.operators import audit, cards, metrics
from quillcheck.sources import files, web


@pytest.mark.parametrize(
    "url, found, problem",
    [
        ("https://a.example/x", ["8.8.8.8"], None),
        ("https://a.example/x", ["8.8.8.8", "127.0.0.1"], "private address"),
        ("https://a.example/x", ["::ffff:10.1.1.1"], "private address"),
        ("https://a.example/x", ["64:ff9b::7f00:1"], "private address"),
        ("https://a.example/x", ["fe80::1%eth0"], "private address"),
        ("https://a.example/x", ["224.0.0.1"], "private address"),
        ("https://a.example:bad/", ["8.8.8.8"], "malformed address"),
        ("http://[bad", [], "malformed address"),
        ("file:///etc/passwd", [], "no http address"),
        ("https://a.example/a b", [], "no http address"),
        ("", [], "no http address"),
    ],
)
def test_address_rules(url, found, problem):
    assert web.address_problem(url, lambda _: found) == problem


def test_unknown_hosts_and_site_rules():
    def nowhere(_):
        raise OSError

    assert web.address_problem("https://a.example", nowhere) == "unknown host"
    assert not web.robots_allow(403, "", "https://a.example/x") and web.robots_allow(404, "", "https://a.example/x")
    rules = "User-agent: *\nDisallow: /private"
    assert web.robots_allow(200, rules, "https://a.example/x") and not web.robots_allow(200, rules, "https://a.example/private/x")


def test_what_counts_as_a_page():
    long = "<title>T</title><p>" + "words and words. " * 20
    read = lambda kind="text/html", body=long, status=200, charset="utf-8": web.page(web.Response(status, kind, charset, body.encode()), "https://a.example/")
    assert read()[0] == "T" and read()[3] is None
    assert read(charset="no-such-charset")[3] is None
    assert read(kind="image/png")[3] == "not a page: image/png"
    assert read(status=500)[3] == "status 500"
    assert read(body="<p>short")[3] == "too short"
    assert read(body="<p>Just a moment...")[3] == "a wall"
    assert read(body=long + "captcha " + "x " * 2000)[3] is None
    assert web.page(web.Response(200, "text/html", "", b"x" * (web.MOST_BYTES + 1)), "")[3] == "too large"
    assert read(body=long + '<a href="/b#c">B b</a>')[2] == [("https://a.example/b", "B b")]


def test_fetch_keeps_every_row(spark):
    def get(url):
        if url.endswith("/fails"):
            raise ValueError("no answer")
        return web.Response(200, "text/plain", "utf-8", b"" if url.endswith("robots.txt") else b"plain words " * 40)

    urls = spark.createDataFrame([(1, "https://a.example/ok"), (2, "https://a.example/fails"), (3, None)], "seq long, url string")
    got = {r.seq: r for r in web.fetch(urls, get, lambda _: ["8.8.8.8"], via="supplied").collect()}
    assert got[1].problem is None and got[1].text.startswith("plain words") and got[1].via == "supplied"
    assert (got[2].problem, got[2].text, got[3].problem) == ("no answer", "", "no http address")
    with pytest.raises(ValueError):
        web.fetch(urls, get, via="carrier pigeon")


def test_corpus_of_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("Some text.")
    (tmp_path / "index.json").write_text(json.dumps([{"company": "A", "url": "https://w.example/wiki/A%26B_(c)", "file": "a b.txt", "chars": 10}]))
    (row,) = files.read_corpus(spark, f"file://{tmp_path}/index.json", f"file://{tmp_path}").collect()
    assert (row.title, row.text) == ("A&B (c) - Wikipedia", "Some text.")


def test_extraction(spark):
    pages = spark.createDataFrame([(0, "e0", "https://a.example", "T <x>", "b" * 50)], "seq long, id string, url string, title string, text string")
    (p,) = cards.extraction_prompts(pages, 3, 40).collect()
    assert p.partial and "‹x›" in p.prompt and "b" * 40 in p.prompt and "b" * 41 not in p.prompt
    reply = lambda *facts: json.dumps({"facts": [dict(zip(("text", "quote", "topic"), f, strict=True)) for f in facts]})
    rows = [
        (0, "e0", "Zeta", reply(("One thing", "q1", "price"), (" one  THING ", "q2", "price"), ("", "q3", "price"), ("Fourth", "q4", "price"))),
        (1, "e1", "Zeta", reply(("ONE thing", "q5", "price"), ("Another", None, "odd"))),
        (2, "e2", "Zeta", "not json"),
        (3, "e3", "Zeta", None),
    ]
    got = cards.extracted(spark.createDataFrame(rows, "seq long, id string, subject string, reply string"), ["price"], "feature", 3).orderBy("seq", "k").collect()
    assert [(r.id, r.text, r.quote, r.evidence_id, r.topic) for r in got] == [("f0.1", "One thing", "q1", "e0", "price"), ("f1.2", "Another", "", "e1", "feature")]


def test_advice_only_cuts(spark):
    lines = spark.createDataFrame([(1, True, ""), (2, True, ""), (3, True, ""), (4, False, "cut before")], "line_id long, kept boolean, reason string")
    answers = spark.createDataFrame([(1, False, None), (2, True, "a price"), (4, False, None)], "line_id long, adds_fact boolean, what string")
    got = {r.line_id: (r.kept, r.reason) for r in cards.advice(lines, answers).collect()}
    assert got == {1: (True, ""), 2: (False, "it adds a fact: a price"), 3: (False, "no reader read it"), 4: (False, "cut before")}


def test_difference_of_arms(spark):
    rows = [(f"p{i // 20}", arm, arm == "keep_all" or i % 2 == 0, i % 4 != 1) for i in range(240) for arm in ("keep_all", "both")]
    df = spark.createDataFrame(rows, "page string, arm string, kept boolean, true boolean")
    got = metrics.difference(df, "true", "page").first()
    assert (got.less_wrong, got.less_of, got.more_wrong, got.more_of) == (60, 240, 0, 120)
    assert got.difference == -0.25 and got.low <= -0.25 <= got.high < 0 and got.measurable and got.met
    few = metrics.difference(df.where("page = 'p1'"), "true", "page").first()
    assert not few.met
    assert spark.range(1).select(metrics.outcome(F.lit(False), F.lit(True), F.lit(False)).alias("o")).first().o == (2, True)


def test_trace_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("lor", "dax", "wug", "blick", "toma", "gorp", "fep", "kiv", "zup", "mib", "tulv", "hask") for b in ("inor", "alo", "urt", "omp", "ulda", "eck")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    sources = [(i, f"u{i}", ". ".join(f"{prose(6)} {rng.choice(['12%', '$5', 'none'])}" for _ in range(5)) + ".") for i in range(12)]
    lines = [(i, f"{prose(5)} {rng.choice(['12%', '$5'])} {prose(2)}.") for i in range(30)]
    found = audit.specifics(spark.createDataFrame(lines, "doc long, text string"))
    got = {(r.doc, r.unit, r.text): r.traced_to for r in audit.trace(found, spark.createDataFrame(sources, "seq long, url string, text string")).collect()}
    content = lambda t: [w for w in P.norm(t).replace(".", " ").split() if w.isalpha()]

    def first(text, line):
        own, wanted = content(line), {v for v, _ in figures(text)}
        for _, url, page in sources:
            for p in P.passages(page, 2):
                have = set(content(p))
                if wanted <= {v for v, _ in figures(p)} and sum(w in have for w in own) >= 0.4 * len(own):
                    return url
        return None

    assert got and got == {(r.doc, r.unit, r.text): first(r.text, r.line) for r in found.collect()}
    assert any(got.values()) and not all(got.values())
