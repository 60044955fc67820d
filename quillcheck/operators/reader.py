"""The second stage: a reader that may cut what the code check kept, and never brings anything back."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import udfs as U
from ..functions.textexpr import as_data


def batches(standing: DataFrame, size: int = 10, page: str | None = "evidence_id") -> DataFrame:
    """Claims with batch and n (from 1): at most ``size`` to a batch, and only one page's. Numbered by pos within the page.

    Without ``page``, all are numbered by pos as one run: in stretches of positions, each of which begins where those before it end,
    so that no task numbers them all.
    """
    if page:
        at = F.row_number().over(Window.partitionBy(page).orderBy("pos")) - 1
        return standing.withColumn("batch", F.floor(at / size)).withColumn("n", (at % size + 1).cast("int"))
    rows = standing.withColumn("__stretch", F.floor(F.col("pos") / 65_536))
    # One row for each stretch.
    sizes = rows.groupBy("__stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__stretch").orderBy("pos")) - 1
    rows = rows.withColumn("__own", own).join(sizes.select("__stretch", before.alias("__before")), "__stretch").withColumn("__at", F.col("__before") + F.col("__own"))
    return rows.select(*standing.columns, F.floor(F.col("__at") / size).alias("batch"), (F.col("__at") % size + 1).cast("int").alias("n"))


def prompts(batched: DataFrame) -> DataFrame:
    """One prompt per page and batch; no text in it can open or close a tag."""
    part = F.concat(F.lit("<pair n="), F.col("n").cast("string"), F.lit("><claim>"), as_data(F.col("text")), F.lit("</claim><quote>"), as_data(F.col("quote")), F.lit("</quote></pair>"))
    parts = F.array_sort(F.collect_list(F.struct("n", part.alias("part"))))
    return batched.groupBy("evidence_id", "batch").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("prompt"), F.count(F.lit(1)).alias("size"))


def ask(prompts_: DataFrame, call: Callable[[str], str | tuple[str, float]], tries: int = 2) -> DataFrame:
    """evidence_id, batch, reply, error, calls, cost: ``call`` on each prompt, tried again once.

    ``call`` gives a reply, or a reply and what it cost. Counts are columns and no counters of the session, as tasks that run again would
    count twice there. Write the result out: calls must not be repeated by lineage.
    """

    def one(prompt: str) -> tuple[str | None, str | None, int, float]:
        error, cost = None, 0.0
        for k in range(tries):
            try:
                got = call(prompt)
                reply, own = got if isinstance(got, tuple) else (got, 0.0)
                return reply, None, k + 1, cost + own
            except Exception as e:  # noqa: BLE001  kept as the reason of what stays unread
                error = error or str(e)[:300]
        return None, error, tries, cost

    def run(frames):
        for frame in frames:
            got = [one(p) for p in frame["prompt"]]
            columns = dict(zip(("reply", "error", "calls", "cost"), map(list, zip(*got, strict=True)), strict=True)) if got else {c: [] for c in ("reply", "error", "calls", "cost")}
            yield frame[["evidence_id", "batch"]].assign(**columns)

    return prompts_.mapInPandas(run, "evidence_id string, batch long, reply string, error string, calls int, cost double")


def scripted(replies: Mapping[str, str]) -> Callable[[str], str]:
    """A model that answers by rule: the reply of the first key that the prompt contains; a prompt with none raises."""

    def call(prompt: str) -> str:
        for key, reply in replies.items():
            if key in prompt:
                return reply
        raise LookupError("no reply for this prompt")

    return call


def decision_states(standing: DataFrame, pages: DataFrame) -> DataFrame:
    """pos and state (JSON) of standing claims: title, claim, passage and what stands around it; what is empty is left out."""
    page = pages.select(F.col("id").alias("evidence_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("page"))
    rows = standing.select("pos", "evidence_id", "text", "quote").join(page, "evidence_id")
    rows = rows.withColumn("c", U.context("quote", "page")).withColumn("passage", F.coalesce(U.passage("quote", "page"), F.col("quote")))
    shown = {"page_title": F.col("title"), "claim": F.col("text"), "quote": F.col("passage"), "before": F.col("c.before"), "between": F.col("c.between"), "after": F.col("c.after")}
    return rows.select("pos", F.to_json(F.struct(*(F.nullif(c, F.lit("")).alias(n) for n, c in shown.items()))).alias("state"))


def ask_probability(states: DataFrame, decide: Callable[[str], float], tries: int = 2) -> DataFrame:
    """pos, p (null where ``decide`` gave no number from 0 to 1) and error: one state to a call, each call tried twice."""

    def one(state: str) -> tuple[float | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                p = float(decide(state))
                if 0 <= p <= 1:
                    return p, None
                error = error or f"no probability: {p}"
            except Exception as e:  # noqa: BLE001  kept as the reason of what stays unread
                error = error or str(e)[:300]
        return None, error

    def run(frames):
        for frame in frames:
            got = [one(s) for s in frame["state"]]
            yield frame[["pos"]].assign(p=[g[0] for g in got], error=[g[1] for g in got])

    return states.mapInPandas(run, "pos long, p double, error string")


def answers_once(answers: DataFrame, keys: tuple[str, ...] = ("batch",), size: str = "size") -> DataFrame:
    """Answers (n, stated and the keys) whose number is in the batch and came exactly once with a yes or no."""
    w = Window.partitionBy(*keys, "n")
    once = answers.withColumn("__c", F.count(F.lit(1)).over(w))
    return once.where((F.col("__c") == 1) & F.col("stated").isNotNull() & F.col("n").between(1, F.col(size))).drop("__c")


def parse_answers(replies: DataFrame) -> DataFrame:
    """evidence_id, batch, n, stated, gap from replies {"answers": [{"n", "stated", "gap"}]}; malformed ones have no row."""
    shape = "struct<answers:array<struct<n:int,stated:boolean,gap:string>>>"
    return replies.select("evidence_id", "batch", F.explode(F.from_json("reply", shape)["answers"]).alias("a")).select("evidence_id", "batch", "a.*")


def merge_readings(verdicts: DataFrame, readings: DataFrame) -> DataFrame:
    """Verdicts (any with pos, supported, reason, detail) after the reader: of the supported, unread or not stated ones are cut."""
    r = readings.select(F.col("pos").alias("__pos"), "stated", "gap")
    j = verdicts.join(r, verdicts["pos"] == F.col("__pos"), "left")
    reason = F.when(~F.col("supported"), F.col("reason")).when(F.col("stated").isNull(), "unread").when(~F.col("stated"), "not_stated").otherwise(F.col("reason"))
    return _cut(j, verdicts, reason, F.coalesce("gap", F.lit("")))


def merge_probabilities(verdicts: DataFrame, probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same with a probability: kept at the threshold or above."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    r = probabilities.select(F.col("pos").alias("__pos"), "p")
    j = verdicts.join(r, verdicts["pos"] == F.col("__pos"), "left")
    reason = F.when(~F.col("supported"), F.col("reason")).when(F.col("p").isNull() | F.isnan("p"), "unread").when(F.col("p") < threshold, "not_stated").otherwise(F.col("reason"))
    return _cut(j, verdicts, reason, F.lit(""))


def _cut(joined: DataFrame, verdicts: DataFrame, reason: Column, gap: Column) -> DataFrame:
    new = joined.withColumn("__r", reason)
    changed = F.col("__r") != F.col("reason")
    cols = {"supported": F.col("supported") & ~changed, "reason": F.col("__r"), "detail": F.when(changed, gap).otherwise(F.col("detail"))}
    return new.select(*(cols.get(c, F.col(c)).alias(c) for c in verdicts.columns))
