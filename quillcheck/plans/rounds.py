"""Registered queries of whole rounds with scripted models, and of a study's tables; each with its SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import textexpr as X
from ..operators import cards, reader, rounds, study
from ..sources import files, ways, web
from .queries import _L, _REASON_SQL, labelled, order_claims, order_pages, order_verdicts, query, table

# Models that answer by rule, so that what a round must give is known.


def strict_reader(prompt: str) -> str:
    """Of orders whose number 32 divides it can't be asked, on those that leave 8 by 16 it says no, and it leaves out those that leave 16 by 64."""
    answers = []
    for n, key in re.findall(r"<pair n=(\d+)><claim>Order (\d+)", prompt):
        if int(key) % 32 == 0:
            raise RuntimeError("no answer")
        if int(key) % 64 != 16:
            answers.append({"n": int(n), "stated": int(key) % 16 != 8, "gap": "a gap" if int(key) % 16 == 8 else ""})
    return json.dumps({"answers": answers})


_READ_SQL = f"""SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 8 <> 0 THEN {_REASON_SQL} WHEN o_orderkey % 32 = 0 OR o_orderkey % 64 = 16 THEN 'unread' WHEN o_orderkey % 16 = 8 THEN 'not_stated' ELSE 'ok' END AS reason,
    CASE WHEN o_orderkey % 8 = 0 AND o_orderkey % 32 = 0 THEN 'no answer' WHEN o_orderkey % 16 = 8 THEN 'a gap' ELSE '' END AS detail FROM orders"""


@query(f"SELECT pos, reason = 'ok' AS supported, reason, CASE WHEN reason IN ('ok', 'unread', 'not_stated') THEN detail END AS detail FROM ({_READ_SQL})")
def read_both_stages(spark, sf_dir):
    """The code check, then a reader of what it kept."""
    done = rounds.check_with_reader(order_claims(spark, sf_dir), order_pages(spark, sf_dir), strict_reader)
    told = F.col("reason").isin("ok", "unread", "not_stated")
    return done.select("pos", "supported", "reason", F.when(told, F.col("detail")).alias("detail"))


@query(f"SELECT pos, CASE WHEN reason = 'ok' AND pos % 5 = 0 THEN 'unread' WHEN reason = 'ok' AND pos % 3 = 0 THEN 'not_stated' ELSE reason END AS reason FROM (SELECT o_orderkey AS pos, {_REASON_SQL} AS reason FROM orders)")
def replayed_readings(spark, sf_dir):
    """Stored answers by claim id, of which every fifth is missing."""
    key = F.col("o_orderkey")
    stored = table(spark, sf_dir, "orders").where(key % 5 != 0).select(F.concat(F.lit("c"), key.cast("string")).alias("claim_id"), (key % 3 != 0).alias("stated"), F.lit("").alias("gap"))
    return rounds.replay(order_verdicts(spark, sf_dir), stored).select("pos", "reason")


def second_quoter(prompt: str) -> str:
    """The page's sentence on the price, for every fact of orders whose eighth is even."""
    key = int(re.search(r"^Page: Order (\d+)", prompt, re.M)[1])
    price = re.search(r"Order \d+ costs \$[\d,.]+\d in total\.", prompt.split("<page>")[1])[0]
    facts = re.findall(r'<cut n="(\d+)">', prompt)
    return json.dumps({"quotes": [{"n": int(n), "quote": price} for n in facts if key // 8 % 2 == 0]})


_BETTER_SQL = "o_orderkey % 8 = 2 AND (o_orderkey // 8) % 2 = 0"


@query(f"SELECT o_orderkey AS pos, o_orderkey % 8 = 0 OR ({_BETTER_SQL}) AS supported, CASE WHEN {_BETTER_SQL} THEN 'ok' ELSE {_REASON_SQL} END AS reason, {_BETTER_SQL} AS requoted FROM orders")
def second_quote_round(spark, sf_dir):
    """Cut claims are asked for another quote; one that passes stands in for the first, and all others keep their first reason."""
    claims, pages = order_claims(spark, sf_dir), order_pages(spark, sf_dir)
    new, done = rounds.requote(claims, order_verdicts(spark, sf_dir), pages, second_quoter)
    quotes = claims.select("pos", F.col("quote").alias("was")).join(new.select("pos", "quote"), "pos")
    return done.join(quotes, "pos").select("pos", "supported", "reason", (F.col("quote") != F.col("was")).alias("requoted"))


def line_writer(prompt: str) -> str:
    """A line of strength for each fact, and a question that cites nothing."""
    facts = re.findall(r"^\[(f\d+)\] \([^)]*\) (.*)$", prompt, re.M)
    return json.dumps({"we_win": [{"text": text, "cites": [name]} for name, text in facts], "questions": [{"text": "Why?", "cites": []}]})


@query("""SELECT 'we_win' AS section, n_name || ' serves ' || (1000 + n_nationkey) || ' customers' AS text, true AS kept, '' AS reason FROM nation WHERE n_regionkey IN (0, 1)
    UNION ALL SELECT 'questions', 'Why?', false, 'it cites nothing'""")
def written_lines(spark, sf_dir):
    text = F.concat("n_name", F.lit(" serves "), (F.col("n_nationkey") + 1000).cast("string"), F.lit(" customers"))
    facts = table(spark, sf_dir, "nation").where("n_regionkey in (0, 1)")
    facts = facts.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_regionkey") == 0, "Zeta").otherwise("Omega").alias("subject"), F.lit("price").alias("topic"), text.alias("text"), text.alias("quote"))
    return rounds.write_lines(facts, "Zeta", "Omega", line_writer).select("section", "text", "kept", "reason")


@query("SELECT CAST(sum(calls) AS BIGINT) AS model_calls, round_even(sum(cost), 4) AS cost_usd FROM (SELECT o_orderstatus, max(o_custkey) AS calls, max(o_totalprice) AS cost FROM orders GROUP BY 1)")
def model_totals(spark, sf_dir):
    """Each status stands for a backend whose counters grow from stage to stage."""
    return rounds.totals(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("backend"), F.col("o_custkey").alias("calls"), F.col("o_totalprice").alias("cost")))


@query("""WITH r AS (SELECT o_orderkey AS doc, o_orderkey % 2 = 0 AS even FROM orders)
    SELECT doc, unnest(CASE WHEN even THEN [0, 1, 2] ELSE [0, 1] END)::INT AS k, unnest(CASE WHEN even THEN ['Order ' || doc || ' is paid in full.', 'It ships', 'It is green and very new.'] ELSE ['Order ' || doc || ' is paid in full.', 'It is green and very new.'] END) AS text,
        unnest(CASE WHEN even THEN ['', 'it ships today', ''] ELSE ['', ''] END) AS quote, unnest(CASE WHEN even THEN [false, true, false] ELSE [false, false] END) AS cited, unnest(CASE WHEN even THEN [0, 2, 0] ELSE [0, 0] END)::INT AS citations FROM r""")
def statement_lines(spark, sf_dir):
    """Replies in blocks: a line that cites nothing, one that cites in even orders and is too short otherwise, and one cut by blocks."""
    key = F.col("o_orderkey")
    block = lambda text, cited=None: F.struct((text if cited is None else F.lit(text)).alias("text"), (F.array().cast("array<string>") if cited is None else cited).alias("cited"))
    cites = F.when(key % 2 == 0, F.array(F.lit(" it ships today "), F.lit("another"))).otherwise(F.array().cast("array<string>"))
    blocks = F.array(block(F.concat(F.lit("- Order "), key.cast("string"), F.lit(" is paid in full.\n"))), block("2) It ships", cites), block(F.lit("\nIt is green")), block(F.lit(" and very new.")))
    rows = files.wide(table(spark, sf_dir, "orders").select("o_orderkey"), 1 << 18)
    return rounds.statements(rows.select(key.alias("doc"), blocks.alias("blocks")))


def rule_of_state(state: str) -> float:
    """The hundredths of the order's number; every seventh order can't be decided."""
    shown = json.loads(state)
    key = int(shown["page_title"].split()[1])
    if key % 7 == 0 or set(shown) != {"page_title", "claim", "quote", "before", "after"}:
        raise ValueError("undecided")
    return key % 100 / 100


@query(f"""SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 8 <> 0 THEN {_REASON_SQL} WHEN o_orderkey % 7 = 0 THEN 'unread' WHEN (o_orderkey % 100) / 100 >= 0.5 THEN 'ok' ELSE 'not_stated' END AS reason FROM orders""")
def decided_claims(spark, sf_dir):
    """The code check, then a probability of what it kept, from the claim, its passage and the page around that."""
    claims, pages = order_claims(spark, sf_dir), order_pages(spark, sf_dir)
    verdicts = order_verdicts(spark, sf_dir)
    states = reader.decision_states(claims.join(verdicts.where("supported").select("pos"), "pos", "left_semi"), pages)
    return reader.merge_probabilities(verdicts, reader.ask_probability(states, rule_of_state), 0.5).select("pos", "reason")


_PROBLEM_SQL = "CASE s_suppkey % 5 WHEN 1 THEN 'the page reached for a private address' WHEN 2 THEN 'status 404' WHEN 3 THEN 'a wall' WHEN 4 THEN 'private address' END"


@query(f"SELECT s_suppkey AS seq, 'browser' AS via, {_PROBLEM_SQL} AS problem, CASE WHEN s_suppkey % 5 = 0 THEN 'https://open.example/to/' || s_suppkey END AS first_link FROM supplier UNION ALL SELECT s_suppkey, 'firecrawl', CASE s_suppkey % 5 WHEN 1 THEN 'the service gave no page: {{''success'': False}}' ELSE {_PROBLEM_SQL} END, CASE WHEN s_suppkey % 5 = 0 THEN 'https://open.example/to/' || s_suppkey END FROM supplier")
def pages_by_other_ways(spark, sf_dir):
    """A stand-in for a browser and one for a service: pages that are read, that reach for a private address, are not there, are walls."""
    key = F.col("s_suppkey")
    host = F.when(key % 5 == 4, "private.example").otherwise("open.example")
    urls = table(spark, sf_dir, "supplier").select(key.alias("seq"), F.concat(F.lit("https://"), host, F.lit("/"), key.cast("string")).alias("url"))
    resolve = lambda name: ["10.0.0.1" if name.startswith("private") else "8.8.8.8"]
    guard = web.Guard(resolve)
    body = lambda k: "Just a moment..." if k % 5 == 3 else f"Parts of supplier {k}. " * 20

    def render(url, gate):
        k = int(url.rpartition("/")[2])
        if k % 5 == 1:
            gate.lets("http://private.example/x", "script")
        return ways.Rendered(f"<p>{body(k)}</p><a href='to/{k}'>x</a>", url, 404 if k % 5 == 2 else 200)

    def post(request):
        k = int(request["url"].rpartition("/")[2])
        if k % 5 == 1:
            return {"success": False}
        return {"success": True, "data": {"markdown": body(k), "links": [f"https://open.example/to/{k}", "mailto:x"], "metadata": {"statusCode": 404 if k % 5 == 2 else 200}}}

    none = lambda url: web.Response(404, "text/plain", "utf-8", b"")
    both = [web.fetch(urls, get, resolve, via=via, rules_by=none) for via, get in (("browser", ways.by_browser(render, guard)), ("firecrawl", ways.by_service(post, guard)))]
    first = F.when(F.col("problem").isNull(), F.get("links", F.lit(0))["url"])
    return both[0].union(both[1]).select("seq", "via", "problem", first.alias("first_link"))


# A study's tables


@query("SELECT doc_id AS id, lang AS subject FROM documents")
def blind_sheet(spark, sf_dir):
    """What a labeller sees of a claim: not who wrote it."""
    claims = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("extractor"))
    return study.sheet(claims, shown=("id", "subject"))


@query(f"""{_L}, r AS (SELECT source, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS reason, code AS supported, doc_id FROM l),
    g AS (SELECT source, reason, count(*) AS n, count(*) FILTER (NOT supported) AS caught FROM r GROUP BY ALL),
    m AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM (SELECT * FROM r WHERE supported QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20) GROUP BY 1)
    SELECT source AS type, CAST(sum(n) AS BIGINT) AS n, CAST(sum(caught) AS BIGINT) AS caught, string_agg(reason || ' ' || caught, ', ' ORDER BY reason) FILTER (caught > 0) AS caught_by, coalesce(any_value(array_to_string(ids, ' ')), '') AS missed FROM g LEFT JOIN m USING (source) GROUP BY 1""")
def caught_by_type(spark, sf_dir):
    c = F.col("doc_id") % 4
    rows = labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("type"), F.col("code").alias("supported"), F.when(c == 0, "a").when(c == 1, "b").otherwise("c").alias("reason"))
    done = study.caught_by_type(rows, 20)
    by = F.array_join(F.transform(F.map_entries("caught_by"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")
    return done.select("type", "n", "caught", F.when(F.size("caught_by") > 0, by).alias("caught_by"), F.array_join(F.transform("missed", lambda x: x.cast("string")), " ").alias("missed"))


@query(f"""{_L} SELECT source AS labeller, count(*) FILTER (code AND true_) AS kept_page_states_k, count(*) FILTER (code) AS kept_page_states_n, count(*) FILTER (true_ AND code) AS page_true_kept_k, count(*) FILTER (true_) AS page_true_kept_n,
    count(*) FILTER (toxic AND code) AS quote_yes_kept_k, count(*) FILTER (toxic) AS quote_yes_kept_n, count(*) FILTER (NOT toxic AND NOT code) AS quote_no_cut_k, count(*) FILTER (NOT toxic) AS quote_no_cut_n FROM l GROUP BY 1""")
def pairs_per_labeller(spark, sf_dir):
    return study.per_labeller(labelled(spark, sf_dir).select(F.col("source").alias("labeller"), F.col("code").alias("kept"), F.col("true").alias("page_states"), F.col("toxic").alias("quote_states")))


@query(f"""{_L}, i AS (SELECT doc_id % 2 = 0 AS signal, code AS kept, true_, doc_id % 10 = 1 AS adds, doc_id % 50 = 2 AS person FROM l),
    c AS (SELECT count(*) FILTER (signal AND kept AND true_) AS k0, count(*) FILTER (signal AND kept) AS n0, count(*) FILTER (signal AND true_ AND kept) AS k1, count(*) FILTER (signal AND true_) AS n1,
        count(*) FILTER (NOT signal AND kept AND adds) AS k2, count(*) FILTER (NOT signal AND kept) AS n2, count(*) FILTER (kept AND person) AS k3, count(*) FILTER (kept) AS n3 FROM i)
    SELECT 'kept signals the page states' AS bar, k0 AS k, n0 AS n, coalesce(n0 > 0 AND k0 / n0 >= 0.95, false) AS met FROM c UNION ALL SELECT 'true signals kept', k1, n1, coalesce(n1 > 0 AND k1 / n1 >= 0.70, false) FROM c
    UNION ALL SELECT 'kept lines that add a fact', k2, n2, k2 = 0 FROM c UNION ALL SELECT 'kept items that name a person', k3, n3, k3 = 0 FROM c""")
def brief_bars(spark, sf_dir):
    l, k = labelled(spark, sf_dir), F.col("doc_id")  # noqa: E741
    items = l.select(k.alias("id"), F.when(k % 2 == 0, "signal").otherwise("line").alias("what"), F.col("code").alias("kept"))
    labels = l.select(k.alias("id"), F.col("true").alias("page_states"), (k % 10 == 1).alias("adds_fact"), (k % 50 == 2).alias("names_a_person"))
    return study.brief_bars(items, labels)


@query(f"{_L} SELECT count(*) FILTER (code AND said) AS past_both, count(*) AS written, count(*) FILTER (code AND said) <= 2 AND count(*) >= 6 AS met FROM l WHERE contains(source, '1')")
def red_team_bar(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.upper("source").alias("technique"), F.col("code").alias("past_code"), F.coalesce("said_yes", F.lit(False)).alias("past_reader"))
    return study.red_team_bar(rows, ["1"])


@query(f"{_L} SELECT count(*) FILTER (true_ AND code) AS kept, count(*) FILTER (true_) AS \"true\", count(*) FILTER (doc_id % 17 = 0 AND NOT true_) AS bad_second, coalesce(count(*) FILTER (true_) > 0 AND count(*) FILTER (true_ AND code) / count(*) FILTER (true_) >= 0.8 AND count(*) FILTER (doc_id % 17 = 0 AND NOT true_) = 0, false) AS met FROM l")
def card_bar(spark, sf_dir):
    l, k = labelled(spark, sf_dir), F.col("doc_id")  # noqa: E741
    return study.card_bar(l.select(k.alias("id"), F.col("code").alias("supported"), (k % 17 == 0).alias("second_quote")), l.select(k.alias("id"), F.col("true").alias("page_states")))


@query("""WITH r AS (SELECT count(*) AS n FROM orders), k AS (SELECT o_orderkey % 8 AS c, count(*) AS n FROM orders GROUP BY 1),
    t AS (SELECT CASE c WHEN 1 THEN 'figure not in quote' WHEN 2 THEN 'quote not in source' WHEN 3 THEN 'polarity mismatch' WHEN 4 THEN 'wrong subject' WHEN 5 THEN 'beyond quote' WHEN 6 THEN 'no quote' WHEN 7 THEN 'no evidence' END AS reason, n FROM k WHERE c <> 0),
    x AS (SELECT string_agg(n || ' ' || reason, ', ' ORDER BY n DESC, reason) AS cut_by FROM t), s AS (SELECT count(*) AS kept FROM orders WHERE o_orderkey % 8 = 0),
    l AS (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS wk, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) AS wc, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) AS mk, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1) AS mc FROM orders)
    SELECT r.n AS signals, kept AS kept_signals, cut_by, wk AS why_now_kept, wc AS why_now_cut, mk AS message_kept, mc AS message_cut,
        'signals   ' || kept || ' of ' || r.n || ' supported, ' || (r.n - kept) || ' cut (' || cut_by || ')' || chr(10) || 'why now   ' || wk || ' kept, ' || wc || ' cut' || chr(10) || 'message   ' || mk || ' kept, ' || mc || ' cut' AS text FROM r, x, s, l""")
def brief_panel(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(F.when(k % 3 == 0, "why_now").otherwise("message").alias("section"), (k % 2 == 0).alias("kept"))
    return cards.brief_panel(order_verdicts(spark, sf_dir), lines)


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 END::INT AS ord FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def facts_by_topic(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), (F.col("o_orderkey") % 2 == 0).alias("supported"))
    return cards.by_topic(facts, ["1-URGENT", "5-LOW"]).select("id", "ord")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'fetched as is' WHEN 1 THEN 'rendered in a browser' WHEN 2 THEN 'supplied by the user' WHEN 3 THEN 'not recorded' ELSE 'by post' END AS how, '‹b›' || c_custkey || '‹/b›' AS said FROM customer")
def how_and_data(spark, sf_dir):
    """How a page was had, in words, and a text that can close no tag of a prompt."""
    via = F.array(*map(F.lit, ("code", "browser", "supplied", "", "by post")))[(F.col("c_custkey") % 5).cast("int")]
    text = F.concat(F.lit("<b>"), F.col("c_custkey").cast("string"), F.lit("</b>"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.how(via).alias("how"), X.as_data(text).alias("said"))
