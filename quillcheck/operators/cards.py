"""Lines that stand on cited facts, second quotes, page picking."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import textexpr as X
from ..functions import udfs as U
from ..functions.pytext import norm
from ..schemas import NO_PAGE, PAGE_KINDS, REQUOTABLE

STRENGTH = ("they_win", "we_win")


def check_lines(lines: DataFrame, facts: DataFrame, names: str = "") -> DataFrame:
    """Lines (line_id, section, text, objection, cites) with kept and reason.

    A line must cite facts (id, text, quote) that are all there, state no figure they don't, negate nothing they
    affirm, and, in a section of strength, say mostly what they say.
    """
    cited = lines.select("line_id", F.posexplode("cites").alias("k", "cite"))
    f = facts.select(F.col("id").alias("cite"), F.coalesce("text", F.lit("")).alias("ft"), F.coalesce("quote", F.lit("")).alias("fq"), F.lit(True).alias("there"))
    rows = F.array_sort(F.collect_list(F.struct("k", "ft", "fq")))
    basis = cited.join(f, "cite", "left").groupBy("line_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all_there"), rows.alias("rows"))
    basis = basis.select("line_id", "all_there", F.array_join(F.transform("rows", lambda r: F.concat(r["ft"], F.lit(" "), r["fq"])), " ").alias("basis"), F.array_join(F.transform("rows", lambda r: r["ft"]), " ").alias("said_by"))
    j = lines.join(basis, "line_id", "left")
    # Only lines whose facts are all there are read further.
    stands = (F.coalesce(F.size("cites"), F.lit(0)) > 0) & F.coalesce("all_there", F.lit(False))
    j = j.withColumn("__l", U.line(*(F.when(stands, F.col(c)) for c in ("text", "objection", "basis", "said_by")), F.lit(names)))
    said, known, own = (F.col(f"__l.{c}") for c in ("said", "known", "own"))
    extra = F.transform(F.filter(said, lambda x: ~F.array_contains(known, x) & ~((x["kind"] == "") & F.array_contains(own, x["value"]))), lambda x: x["value"])
    reason = (
        F.when(F.coalesce(F.size("cites"), F.lit(0)) <= 0, "it cites nothing")
        .when(~F.coalesce("all_there", F.lit(False)), "it cites a fact that is not there")
        .when(F.size(extra) > 0, F.concat(F.lit("its facts lack a figure: "), F.array_join(extra, ", ")))
        .when(X.polarity_mismatch_n(F.col("__l.text_n"), F.col("__l.said_by_n")), "it and its facts differ in a negation")
        .when(F.col("section").isin(*STRENGTH) & (X.overlap_n(F.col("__l.text_n"), F.col("__l.basis_n"), F.lit(norm(names))) < 0.5), "its facts say less")
        .otherwise("")
    )
    j = j.withColumn("reason", reason)
    return j.withColumn("kept", F.col("reason") == "").select(*(c for c in lines.columns if c not in ("kept", "reason")), "kept", "reason")


def check_brief_lines(lines: DataFrame, facts: DataFrame, company: str, seller: str) -> DataFrame:
    """Brief lines: no person, a reason to call cites a signal, a figure needs one too; the seller's words ("you") are always cited."""
    you = seller_page(facts.sparkSession, seller)
    signals = F.filter(F.coalesce("cites", F.array().cast("array<string>")), lambda c: c != "you")
    l = lines.withColumn("__sig", signals).withColumn("cites", F.concat(signals, F.array(F.lit("you"))))  # noqa: E741
    l = l.withColumn("__who", U.person("text", F.lit(company))).withColumn("__new", F.size(F.array_except(U.figures("text"), U.figures(F.lit(seller)))))  # noqa: E741
    first = (
        F.when(F.col("__who").isNotNull(), F.concat(F.lit("it names a person: "), "__who"))
        .when((F.col("section") == "why_now") & (F.size("__sig") == 0), "it cites no signal")
        .when((F.size("__sig") == 0) & (F.col("__new") > 0), "it has a figure and no signal")
    )
    base = check_lines(l.withColumn("__first", first), facts.select("id", "text", "quote").unionByName(you), company)
    reason = F.coalesce("__first", "reason")
    return base.withColumn("reason", reason).withColumn("kept", F.col("reason") == "").drop("__sig", "__who", "__new", "__first")


def requotable(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("reason").isin(*REQUOTABLE))


def second_quotes(answers: DataFrame, first: DataFrame) -> DataFrame:
    """pos, quote: of answers (pos, quote), those that came once, are not empty and differ from the first quote (pos, quote)."""
    once = answers.groupBy("pos").agg(F.count(F.lit(1)).alias("c"), F.min("quote").alias("q")).where("c = 1 and trim(coalesce(q, '')) <> ''")
    return once.join(first.select("pos", F.col("quote").alias("was")), "pos").where(U.norm("q") != U.norm("was")).select("pos", F.col("q").alias("quote"))


def merge_second(first: DataFrame, second: DataFrame) -> DataFrame:
    """Verdicts by pos; a second one that is supported stands in for the first, otherwise the first stays with its reason."""
    s = second.where("supported").select("pos", F.struct(*(c for c in first.columns if c != "pos")).alias("new"))
    return first.join(s, "pos", "left").select("pos", *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in first.columns if c != "pos"))


def _kind(path: Column, sub: Column) -> Column:
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    last, n = F.element_at(parts, -1), F.size(parts)
    out = F.lit(None).cast("int")
    for k, (_, names) in reversed(list(enumerate(PAGE_KINDS))):
        by_path = n.between(1, 2) & F.when(n > 0, last).isin(*names)
        out = F.when(by_path | ((n == 0) & sub.isin(*names)), F.lit(k)).otherwise(out)
    return out


def pick_pages(links: DataFrame, limit: int = 4) -> DataFrame:
    """page_id, kind, url: of each home page's links (page_id, home, pos, url), the first of each kind on the same site, kinds in a fixed order.

    No address belongs to two kinds, so the first of each kind needs no look at the others.
    """
    host, site = X.host(F.col("url")), X.host(F.col("home"))
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    same = (host == site) | host.endswith(F.concat(F.lit("."), site))
    file = F.lower(path).rlike(NO_PAGE)
    sub = F.when(host != site, F.element_at(F.split(host, r"\."), 1)).otherwise("")
    rows = links.where(same & ~file & (F.rtrim("url") != "") & (F.regexp_replace("url", "/+$", "") != F.regexp_replace("home", "/+$", "")))
    rows = rows.withColumn("k", _kind(path, sub)).where("k is not null")
    best = rows.groupBy("page_id", "k").agg(F.min_by("url", "pos").alias("url"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("k"))
    names = F.array(*(F.lit(k) for k, _ in PAGE_KINDS))
    return best.withColumn("n", n).where(F.col("n") <= limit).select("page_id", F.element_at(names, F.col("k") + 1).alias("kind"), "url")


def seller_page(spark: SparkSession, words: str) -> DataFrame:
    """The seller's own words as a fact that needs no page."""
    return spark.createDataFrame([("you", words, words)], "id string, text string, quote string")


def extraction_prompts(pages: DataFrame, most: int = 12, chars: int = 40_000) -> DataFrame:
    """One prompt per page (seq, id, url, title, text); ``partial`` marks pages that are longer than a prompt takes."""
    head = F.concat(F.lit("Address: "), X.as_data(F.coalesce("url", F.lit(""))), F.lit("\nTitle: "), X.as_data(F.coalesce("title", F.lit(""))), F.lit(f"\nList {most} facts at most.\n<page>\n"))
    body = X.as_data(F.substring(F.coalesce("text", F.lit("")), 1, chars))
    return pages.select("seq", "id", F.concat(head, body, F.lit("\n</page>")).alias("prompt"), (F.length("text") > chars).alias("partial"))


def extracted(replies: DataFrame, topics: list[str], fallback: str, most: int = 12) -> DataFrame:
    """Claims from replies (seq, id, subject, reply {"facts": [{"text", "quote", "topic"}]}): id, text, quote, evidence_id, subject, topic.

    Of a page the first ``most`` facts count; a text that came before, on any page, is left out, and
    a topic that isn't one of ``topics`` becomes ``fallback``.
    """
    shape = "struct<facts:array<struct<text:string,quote:string,topic:string>>>"
    facts = replies.select("seq", F.col("id").alias("evidence_id"), "subject", F.posexplode(F.slice(F.from_json("reply", shape)["facts"], 1, most)).alias("k", "f"))
    facts = facts.withColumn("text", F.trim(F.coalesce("f.text", F.lit("")))).where("text <> ''").withColumn("__n", U.norm("text"))
    cols = ("seq", "k", "evidence_id", "subject", "text", "f")
    first = facts.groupBy("__n").agg(F.min_by(F.struct(*cols), F.struct("seq", "k")).alias("r")).select("r.*")
    topic = F.when(F.col("f.topic").isin(*topics), F.col("f.topic")).otherwise(F.lit(fallback))
    name = F.concat(F.lit("f"), F.col("seq").cast("string"), F.lit("."), (F.col("k") + 1).cast("string"))
    return first.select("seq", "k", name.alias("id"), "text", F.coalesce("f.quote", F.lit("")).alias("quote"), "evidence_id", "subject", topic.alias("topic"))


def advice(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """Kept lines (line_id, kept, reason) after a reader's answers (line_id, adds_fact, what): unread ones and those that add a fact go."""
    a = answers.select(F.col("line_id").alias("__id"), "adds_fact", "what")
    j = lines.join(a, lines["line_id"] == F.col("__id"), "left")
    why = F.when(~F.col("kept"), F.col("reason")).when(F.col("adds_fact").isNull(), "no reader read it").when(F.col("adds_fact"), F.concat(F.lit("it adds a fact: "), F.coalesce("what", F.lit("")))).otherwise(F.col("reason"))
    stays = F.col("kept") & F.coalesce(~F.col("adds_fact"), F.lit(False))
    return j.select(*({"kept": stays, "reason": why}.get(c, F.col(c)).alias(c) for c in lines.columns))


def panel(verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """The counts that stand beside a card, as one row with its text."""
    v = verdicts.agg(F.count(F.lit(1)).alias("facts"), F.count_if("supported").alias("kept_facts"), F.count_if(F.col("reason") == "unread").alias("unread"))
    n = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if("kept").alias("kept_lines"))
    both = v.join(n)  # two rows of one
    text = F.concat(X.percent(F.col("kept_facts"), F.col("facts")), F.lit(" facts stand, "), X.percent(F.col("kept_lines"), F.col("lines")), F.lit(" lines stand"), F.when(F.col("unread") > 0, F.concat(F.lit(", "), F.col("unread").cast("string"), F.lit(" unread"))).otherwise(""))
    return both.withColumn("text", text)


def reasons_text(verdicts: DataFrame) -> DataFrame:
    """One row, cut_by: the reasons of cut rows with their numbers, most frequent first, or "none"."""
    by = verdicts.where(~F.col("supported")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    # A row for each reason there is.
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason", "n")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["n"].cast("string"), F.lit(" "), F.replace(r["reason"], F.lit("_"), F.lit(" ")))), ", ")
    return by.agg(F.when(F.count(F.lit(1)) > 0, text).otherwise("none").alias("cut_by"))


def brief_panel(verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """The counts that stand beside a brief, as one row with its text: signals (verdicts), and lines (section, kept) by section."""
    v = verdicts.agg(F.count(F.lit(1)).alias("signals"), F.count_if("supported").alias("kept_signals"))
    of = lambda section, kept: F.count_if((F.col("section") == section) & (F.col("kept") if kept else ~F.col("kept")))
    n = lines.agg(*(of(s, k).alias(f"{s}_{'kept' if k else 'cut'}") for s in ("why_now", "message") for k in (True, False)))
    row = v.join(n).join(reasons_text(verdicts))  # three rows of one
    text = F.format_string(
        "signals   %d of %d supported, %d cut (%s)\nwhy now   %d kept, %d cut\nmessage   %d kept, %d cut",
        "kept_signals", "signals", F.col("signals") - F.col("kept_signals"), "cut_by", "why_now_kept", "why_now_cut", "message_kept", "message_cut",
    )
    return row.withColumn("text", text)


def by_topic(facts: DataFrame, topics: list[str]) -> DataFrame:
    """Supported facts (subject, topic, text and others) with ord, the place of their topic in a fixed order; other topics are left out."""
    order = facts.sparkSession.createDataFrame(list(enumerate(topics)), "ord int, topic string")
    return facts.where("supported").join(F.broadcast(order), "topic")


def section_html(title: str, rows: list[dict]) -> str:
    """A section of a card or brief: kept rows (text, quote, url), each with its receipt, then cut ones with their reason; all escaped."""
    esc = lambda x: html.escape(str(x or ""))
    kept = "".join(f'<li>{esc(r["text"])} <a href="{esc(r["url"])}">“{esc(r["quote"])}”</a></li>' for r in rows if r["supported"])
    cut = "".join(f"<li><s>{esc(r['text'])}</s> {esc(r['reason'])}</li>" for r in rows if not r["supported"])
    return f"<section><h2>{esc(title)}</h2><ul>{kept or '<li>none</li>'}</ul>{f'<details><ul>{cut}</ul></details>' if cut else ''}</section>"


def brief_json(claims: DataFrame, verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """JSON objects of a brief: a signal each, and a line each whose cites leave out the seller's own words; page texts stay out."""
    own = F.filter("cites", lambda c: c != "you")
    said = lines.select(F.col("line_id").alias("pos"), F.lit("line").alias("what"), F.to_json(F.struct("section", "text", own.alias("cites"), "kept", "reason")).alias("value"))
    return card_json(claims, verdicts).select("pos", F.lit("signal").alias("what"), "value").unionByName(said)


def card_json(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One JSON object per fact, kept or cut, with its reason; page texts stay out."""
    v = verdicts.select("pos", "supported", "reason", "detail", "url")
    return claims.join(v, "pos").select("pos", F.to_json(F.struct("id", "text", "quote", "evidence_id", "subject", "topic", "supported", "reason", "detail", "url")).alias("value"))
