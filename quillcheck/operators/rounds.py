"""Whole rounds of a model stage: reading, replay of stored answers, second quotes, lines; and what they cost.

A call of a model must happen once. What it answered is therefore written out (``files.kept``) before anything is
joined with it, so a lost executor computes joins again and never asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textexpr as X
from ..functions import udfs as U
from ..schemas import REASONS
from ..sources import files
from . import cards, check, reader

Call = Callable[[str], str]


def read_pairs(standing: DataFrame, call: Call, size: int = 10) -> DataFrame:
    """pos, stated, gap of every standing claim (pos, evidence_id, text, quote): ``size`` of one page to a call, each call tried twice.

    stated is null where no usable answer came; gap then tells the error, if there was one.
    """
    numbered = reader.batches(standing, size)
    replies = files.kept(reader.ask(reader.prompts(numbered), call), "replies")
    sizes = numbered.groupBy("evidence_id", "batch").agg(F.count(F.lit(1)).alias("size"))
    answers = reader.answers_once(reader.parse_answers(replies).join(sizes, ["evidence_id", "batch"]), ("evidence_id", "batch"))
    key = ["evidence_id", "batch"]
    own = numbered.select("pos", "n", *key).join(answers.select(*key, "n", "stated", "gap"), [*key, "n"], "left")
    return own.join(replies.select(*key, "error"), key, "left").select("pos", "stated", F.when(F.col("stated").isNull(), F.col("error")).otherwise(F.col("gap")).alias("gap"))


def check_with_reader(claims: DataFrame, evidence: DataFrame, call: Call, size: int = 10, **options) -> DataFrame:
    """Both stages: the code check, then a reader of what it kept; the reader only cuts."""
    verdicts = files.kept(check.check_claims(claims, evidence, **options), "verdicts")
    standing = claims.join(verdicts.where("supported").select("pos"), "pos", "left_semi")
    return reader.merge_readings(verdicts, read_pairs(standing, call, size))


def stored_readings(spark: SparkSession, path: str) -> DataFrame:
    """claim_id, stated, gap, reader, calls, cost of a file that holds a reader's answers by claim id, each [stated, gap]."""
    shape = "reader string, readings map<string,array<string>>, model_calls int, cost_usd_list_price double"
    rows = spark.read.schema(shape).json(path, multiLine=True)
    told = rows.select("reader", F.coalesce("model_calls", F.lit(0)).alias("calls"), F.coalesce("cost_usd_list_price", F.lit(0.0)).alias("cost"), F.explode("readings").alias("claim_id", "r"))
    return told.select("claim_id", (F.get("r", F.lit(0)) == "true").alias("stated"), F.coalesce(F.get("r", F.lit(1)), F.lit("")).alias("gap"), "reader", "calls", "cost")


def replay(verdicts: DataFrame, readings: DataFrame) -> DataFrame:
    """Verdicts of the code check after stored readings (claim_id, stated, gap); no model is called."""
    by_pos = verdicts.select("pos", "claim_id").join(readings.select("claim_id", "stated", "gap"), "claim_id").drop("claim_id")
    return reader.merge_readings(verdicts, by_pos)


def requote_prompts(cut: DataFrame, pages: DataFrame, chars: int = 40_000) -> DataFrame:
    """evidence_id, prompt and the positions behind its numbers: the cut claims of a page that a second quote may mend, beside the page."""
    page = pages.select(F.col("id").alias("evidence_id"), F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("page"))
    by_reason = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    why = F.concat(by_reason[F.col("reason")], F.when(F.col("detail") != "", F.concat(F.lit(" ("), F.col("detail"), F.lit(")"))).otherwise(""))
    rows = F.array_sort(F.collect_list(F.struct("pos", "subject", "text", "quote", why.alias("why"))))
    groups = cards.requotable(cut).groupBy("evidence_id").agg(rows.alias("rows"))
    one = lambda r, i: F.concat(F.lit('<cut n="'), (i + 1).cast("string"), F.lit('">\nSays: '), X.as_data(r["text"]), F.lit("\nQuoted: "), X.as_data(r["quote"]), F.lit("\nProblem: "), X.as_data(r["why"]), F.lit("\n</cut>"))
    prompt = F.concat(F.lit("About: "), X.as_data(F.col("rows")[0]["subject"]), F.lit("\nPage: "), X.as_data(F.col("title")), F.lit("\n<page>\n"), X.as_data(F.col("page")), F.lit("\n</page>\n"), F.array_join(F.transform("rows", one), "\n"))
    return groups.join(page, "evidence_id").select("evidence_id", prompt.alias("prompt"), F.transform("rows", lambda r: r["pos"]).alias("positions"))


def requote(claims: DataFrame, verdicts: DataFrame, pages: DataFrame, call: Call, read: Call | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(claims, verdicts) after one more quote for each claim whose quote did not carry it.

    A claim's words stay; a second quote counts if it came once and differs, and passes what a first one passes: the code check
    and, with ``read``, the reader. A claim that still fails keeps its first quote and its first reason.
    """
    cut = claims.join(verdicts.where(~F.col("supported")).select("pos", "reason", "detail"), "pos")
    asked = requote_prompts(cut, pages)
    replies = files.kept(reader.ask(asked.withColumn("batch", F.lit(0).cast("long")), call), "second-quotes")
    shape = "struct<quotes:array<struct<n:int,quote:string>>>"
    given = replies.join(asked.select("evidence_id", "positions"), "evidence_id").select("positions", F.explode(F.from_json("reply", shape)["quotes"]).alias("q"))
    answers = given.select(F.get("positions", F.col("q.n") - 1).alias("pos"), F.trim("q.quote").alias("quote")).where("pos is not null and quote is not null")
    new = cards.second_quotes(answers, claims.select("pos", "quote"))
    again = files.kept(claims.drop("quote").join(new, "pos").select(*claims.columns), "claims-again")
    second = check.check_claims(again, pages, **options)
    if read is not None:
        second = check_with_reader(again, pages, read, **options)
    second = files.kept(second, "verdicts-again")
    own = second.where("supported").select("pos").join(again.select("pos", F.col("quote").alias("better")), "pos")
    changed = claims.join(own, "pos", "left").select(*(F.coalesce("better", "quote").alias("quote") if c == "quote" else F.col(c) for c in claims.columns))
    return changed, cards.merge_second(verdicts, second.select(*verdicts.columns))


def line_prompt(facts: DataFrame, us: str, them: str, most: int = 500) -> DataFrame:
    """One prompt that lists the supported facts (id, subject, topic, text) of both products; none where a product has no facts.

    A card's facts are few: ``most`` of them at most are listed, and more raise.
    """
    line = F.concat(F.lit("["), F.col("id"), F.lit("] ("), F.col("subject"), F.lit(", "), F.col("topic"), F.lit(") "), X.as_data(F.col("text")))
    rows = facts.agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("rows"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("subject") == us).alias("ours"), F.count_if(F.col("subject") == them).alias("theirs"))
    within = F.when(F.col("n") > most, F.raise_error(F.lit(f"a card lists {most} facts at most"))).otherwise(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    prompt = F.concat(F.lit(f"Ours: {us}\nTheirs: {them}\n"), within)
    return rows.where("ours > 0 and theirs > 0").select(F.lit("").alias("evidence_id"), F.lit(0).cast("long").alias("batch"), prompt.alias("prompt"))


def write_lines(facts: DataFrame, us: str, them: str, call: Call, sections: Sequence[str] = ("they_win", "we_win", "questions", "objections")) -> DataFrame:
    """line_id, section, text, objection, cites, kept, reason of the lines a model writes from supported facts, each checked by code."""
    replies = files.kept(reader.ask(line_prompt(facts, us, them), call), "lines")
    one = "array<struct<text:string,response:string,objection:string,cites:array<string>>>"
    draft = F.from_json("reply", "struct<" + ",".join(f"{s}:{one}" for s in sections) + ">")
    none = F.array().cast("array<string>")

    def tagged(section: str) -> Column:
        text = "response" if section == "objections" else "text"
        row = lambda x: F.struct(F.lit(section).alias("section"), F.coalesce(x[text], F.lit("")).alias("text"), F.coalesce(x["objection"], F.lit("")).alias("objection"), F.coalesce(x["cites"], none).alias("cites"))
        return F.transform(F.coalesce(draft[section], F.array().cast(one)), row)

    lines = replies.select(F.posexplode(F.concat(*map(tagged, sections))).alias("line_id", "x")).select(F.col("line_id").cast("long").alias("line_id"), "x.*")
    return cards.check_lines(lines, facts.select("id", "text", "quote"), f"{us} {them}")


def totals(calls: DataFrame) -> DataFrame:
    """model_calls and cost_usd of the calls' table (backend, calls, cost): a backend that several stages share counts once, as it stands last."""
    last = calls.groupBy("backend").agg(F.max("calls").alias("calls"), F.max("cost").alias("cost"))
    return last.agg(F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("model_calls"), F.bround(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost_usd"))


def statements(blocks: DataFrame) -> DataFrame:
    """doc, k, text, quote, cited, citations of replies that come as text blocks (doc, blocks: array of text and cited texts)."""
    return blocks.select("doc", F.posexplode(U.statements("blocks")).alias("k", "s")).select("doc", "k", "s.*")
