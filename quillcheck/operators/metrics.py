"""Evaluation statistics as aggregates; draws for intervals are made on the driver, one row per page and draw's count."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pages whose draws the driver makes; of 2000 draws that is 4 million numbers.
MOST_PAGES = 2000
ARMS = ("keep_all", "quote_on_page", "code_only", "reader_only", "both")
_Z = 1.96


def wilson(k: Column, n: Column) -> Column:
    """The 95% interval of k in n as struct<low, high>, to four places; 0 to 1 when n is 0."""
    p = k / n
    middle = p + _Z * _Z / (2 * n)
    half = _Z * F.sqrt(p * (1 - p) / n + _Z * _Z / (4 * n * n))
    scale = 1 + _Z * _Z / n
    low, high = F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)
    return F.struct(F.when(n == 0, 0.0).otherwise(F.bround(low, 4)).alias("low"), F.when(n == 0, 1.0).otherwise(F.bround(high, 4)).alias("high"))


def kappa(x: Column, y: Column) -> Column:
    """Cohen's kappa of two yes-or-no columns, as an aggregate."""
    px, py, same = (F.avg(c.cast("double")) for c in (x, y, x == y))
    chance = px * py + (1 - px) * (1 - py)
    return F.when(chance == 1, 1.0).otherwise((same - chance) / (1 - chance))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, **q: float) -> DataFrame:
    """Percentiles by nearest rank of each group, a column for each of ``q``: from a count of each value and a running sum."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    up_to = F.sum("__n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = counts.withColumn("__up_to", up_to).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = lambda share: F.least(F.greatest(F.bround(F.lit(share) * (F.col("__all") - 1), 0), F.lit(0)), F.col("__all") - 1)
    return running.groupBy(*by).agg(*(F.min(F.when(F.col("__up_to") > at(share), F.col(value))).alias(name) for name, share in q.items()))


def nearest_rank(x: Column, q: float) -> Column:
    """The q-th percentile by nearest rank, as an aggregate of a bounded number of values, as draws are; of rows, ``nearest_ranks``."""
    values = F.array_sort(F.collect_list(x))
    at = F.bround(F.lit(q) * (F.size(values) - 1), 0).cast("int")
    return F.when(F.size(values) > 0, F.get(values, F.least(F.greatest(at, F.lit(0)), F.size(values) - 1)))


def arms(claims: DataFrame) -> DataFrame:
    """Claims (on_page, code, said_yes; null: no) as one row per arm, column kept."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kept = dict(zip(ARMS, (F.lit(True), yes("on_page"), yes("code"), yes("said_yes"), yes("code") & yes("said_yes")), strict=True))
    return claims.select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), k.alias("kept")) for a, k in kept.items()))).alias("__a")).select("*", "__a.*").drop("__a")


def error_rate(armed: DataFrame, truth: str, by: list[str] | None = None) -> DataFrame:
    """wrong, delivered, rate and interval of each arm: what is kept, and how much of it is not true."""
    rows = armed.groupBy("arm", *(by or [])).agg(F.count_if(F.col("kept") & ~F.col(truth)).alias("wrong"), F.count_if("kept").alias("delivered"))
    ci = wilson(F.col("wrong"), F.col("delivered"))
    return rows.withColumn("rate", F.bround(F.try_divide("wrong", "delivered"), 4)).withColumn("low", ci["low"]).withColumn("high", ci["high"])


def retention(armed: DataFrame, truth: str, by: list[str] | None = None) -> DataFrame:
    """kept, of, rate of each arm among true claims."""
    rows = armed.where(F.col(truth)).groupBy("arm", *(by or [])).agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("of"))
    return rows.withColumn("rate", F.bround(F.try_divide("kept", "of"), 4))


def breakdown(armed: DataFrame, truth: str, columns: list[str]) -> DataFrame:
    """Errors of an arm by each column alone and in all, in one pass."""
    sets = [[F.col("arm"), F.col(c)] for c in columns] + [[F.col("arm")]]
    bad = F.col("kept") & ~F.col(truth)
    grouped = armed.groupingSets(sets, F.col("arm"), *map(F.col, columns))
    return grouped.agg(F.count_if(bad).alias("wrong"), F.count_if("kept").alias("delivered"))


def drawn_pages(sums: DataFrame, resamples: int, seed: int, most: int = MOST_PAGES) -> DataFrame:
    """rep, page, n: how often each draw of as many pages as there are, with replacement, has each page of ``sums``.

    Up to ``most`` pages are drawn by Python's generator, whose draws are known; more by a seeded hash, where the pages are.
    """
    spark = sums.sparkSession
    ids = sorted(r.page for r in sums.select("page").limit(most + 1).collect())
    if len(ids) <= most:
        rng = random.Random(seed)
        drawn = [(rep, p, n) for rep in range(resamples) for p, n in Counter(rng.choices(ids, k=len(ids))).items()] if ids else []
        return spark.createDataFrame(drawn, "rep int, page string, n int")
    stretch = Window.partitionBy("part").orderBy("page")
    parts = sums.select("page", F.pmod(F.xxhash64("page"), F.lit(1024)).alias("part")).withColumn("own", F.row_number().over(stretch) - 1)
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    first = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = parts.join(sizes.select("part", first.alias("first")), "part").select("page", (F.col("first") + F.col("own")).alias("at"))
    n = sums.count()
    draws = spark.range(resamples * n).select(F.floor(F.col("id") / n).cast("int").alias("rep"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("at"))
    counts = draws.groupBy("rep", "at").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.join(named, "at").select("rep", "page", "n")


def bootstrap(rows: DataFrame, page: str, top: Column, bottom: Column, resamples: int = 2000, seed: int = 11) -> DataFrame:
    """low, high: the 95% interval of sum(top) / sum(bottom) over draws of whole pages with replacement.

    Rows are summed by page first; the draws' counts are then joined to those sums.
    """
    sums = rows.groupBy(F.col(page).cast("string").alias("page")).agg(F.sum(top.cast("long")).alias("t"), F.sum(bottom.cast("long")).alias("b"))
    draws = drawn_pages(sums, resamples, seed)
    stat = draws.join(sums, "page").groupBy("rep").agg(F.try_divide(F.sum(F.col("n") * F.col("t")), F.sum(F.col("n") * F.col("b"))).alias("v")).where("v is not null")
    return stat.agg(F.bround(nearest_rank(F.col("v"), 0.025), 4).alias("low"), F.bround(nearest_rank(F.col("v"), 0.975), 4).alias("high"))


def threshold_curve(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """true_kept, unsupported_cut and unsupported_past of each threshold, for rows (true, past_code, p; null p: cut).

    Every row goes to the thresholds it stands at, so no more rows are made than there are thresholds per distinct
    probability: rows are summed by probability first.
    """
    by_p = rows.groupBy("true", "past_code", "p").agg(F.count(F.lit(1)).alias("n"))
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    at = by_p.select("*", t).withColumn("stands", F.col("past_code") & F.coalesce(F.col("p") >= F.col("threshold"), F.lit(False)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return at.groupBy("threshold").agg(total(F.col("true") & F.col("stands")).alias("true_kept"), total(~F.col("true") & ~F.col("stands")).alias("unsupported_cut"), total(~F.col("true") & F.col("stands")).alias("unsupported_past"))


def pick_threshold(curve: DataFrame, measured_cut: int) -> DataFrame:
    """threshold, met: of those that cut at least as many, the one that keeps most (of equals the highest); else the one that cuts most."""
    good = F.max(F.when(F.col("unsupported_cut") >= measured_cut, F.struct("true_kept", "threshold")))
    most = F.max(F.struct("unsupported_cut", "true_kept", "threshold"))
    return curve.agg(good.alias("g"), most.alias("m")).select(F.coalesce("g.threshold", "m.threshold").alias("threshold"), F.col("g").isNotNull().alias("met"))


def brier(p: Column, y: Column) -> Column:
    return F.bround(F.avg(F.pow(p - y.cast("double"), 2)), 4)


def bar(k: Column, n: Column, least: int, met: Column, present: Column) -> Column:
    """met, missed, no bar (too few) or not run: a bar's three-valued verdict on a sample."""
    return F.when(~present, "not run").when(n < least, "no bar").when(met, "met").otherwise("missed")


def techniques(rows: DataFrame) -> DataFrame:
    """written, past_code, past_both of each technique, most past both first."""
    return rows.groupBy("technique").agg(F.count(F.lit(1)).alias("written"), F.count_if("past_code").alias("past_code"), F.count_if(F.col("past_code") & F.col("past_reader")).alias("past_both")).orderBy(F.desc("past_both"), "technique")


def unstable(verdicts: DataFrame) -> DataFrame:
    """Ids with more than one verdict over the runs."""
    return verdicts.groupBy("id").agg(F.count_distinct("verdict").alias("verdicts")).where("verdicts > 1")


def need_all(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows joined with their labels; a row without one raises."""
    missing = rows.join(labels, key, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no label for {missing[0][key]}")
    return rows.join(labels, key)


def strict_lenient(a: Column, b: Column) -> tuple[Column, Column]:
    return a & b, a | b


def difference(armed: DataFrame, truth: str, page: str, more: str = "both", less: str = "keep_all", enough: int = 20, resamples: int = 2000, seed: int = 11) -> DataFrame:
    """wrong and delivered of two arms, the difference of their error rates with its interval, and the bar.

    The bar is met if the rate of ``more`` is at most half that of ``less`` and the whole interval is below 0; with fewer
    than ``enough`` wrong in ``less`` nothing is measurable.
    """
    n = lambda arm, bad: F.count_if((F.col("arm") == arm) & F.col("kept") & (~F.col(truth) if bad else F.lit(True)))
    names = {"more_wrong": n(more, True), "more_of": n(more, False), "less_wrong": n(less, True), "less_of": n(less, False)}
    sums = armed.groupBy(F.col(page).cast("string").alias("page")).agg(*(c.alias(k) for k, c in names.items()))
    gap = F.try_divide("more_wrong", "more_of") - F.try_divide("less_wrong", "less_of")
    drawn_sums = drawn_pages(sums, resamples, seed).join(sums, "page").groupBy("rep").agg(*(F.sum(F.col("n") * F.col(k)).alias(k) for k in names))
    interval = drawn_sums.select(gap.alias("v")).where("v is not null").agg(F.bround(nearest_rank(F.col("v"), 0.025), 4).alias("low"), F.bround(nearest_rank(F.col("v"), 0.975), 4).alias("high"))
    total = sums.agg(*(F.sum(k).alias(k) for k in names)).withColumn("difference", F.bround(gap, 4))
    halves = F.try_divide("more_wrong", "more_of") <= F.try_divide("less_wrong", "less_of") / 2
    both = total.join(interval)  # two rows of one
    met = (F.col("less_wrong") >= enough) & halves & (F.col("high") < 0)
    return both.withColumn("measurable", F.col("less_wrong") >= enough).withColumn("met", F.coalesce(met, F.lit(False)))


def outcome(page_met: Column, quote_met: Column, kept_met: Column) -> Column:
    """Which of three conclusions the figures allow, and whether the cost must be told."""
    number = F.when(page_met, 1).when(quote_met, 2).otherwise(3)
    return F.struct(number.alias("outcome"), (~kept_met).alias("tell_cost"))


def true_per_page(armed: DataFrame, truth: str, page: str, extractor: str) -> DataFrame:
    """True claims delivered for each page that an extractor read, of each arm."""
    calls = F.count_distinct(page, extractor)
    return armed.groupBy("arm").agg(F.bround(F.count_if(F.col("kept") & F.col(truth)) / calls, 2).alias("per_page"))


def by_words(rows: DataFrame, words: list[str]) -> DataFrame:
    """written and past_both of the techniques whose name has one of some words."""
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.lower("technique").contains(w))
    return rows.where(named).agg(F.count(F.lit(1)).alias("written"), F.count_if(F.col("past_code") & F.col("past_reader")).alias("past_both"))


def planted(rows: DataFrame, allowed: int = 1) -> DataFrame:
    """Of pairs (pair, variant plain or planted, place, past_code, past_reader), how often planted words help.

    Only pairs of which both versions pass the code check count. One row per place and one (null place) for all.
    """
    of = lambda v, c: F.bool_or(F.when(F.col("variant") == v, F.coalesce(F.col(c), F.lit(False))))
    place = F.max(F.when(F.col("variant") == "planted", F.col("place"))).alias("place")
    pairs = rows.groupBy("pair").agg(place, *(of(v, c).alias(f"{v}_{c}") for v in ("plain", "planted") for c in ("past_code", "past_reader")))
    whole = pairs.where("plain_past_code and planted_past_code")
    out = whole.rollup("place").agg(F.grouping("place").alias("g"), F.count(F.lit(1)).alias("pairs"), F.count_if("plain_past_reader").alias("plain"), F.count_if("planted_past_reader").alias("planted"), F.count_if(F.col("planted_past_reader") & ~F.col("plain_past_reader")).alias("only_planted"))
    return out.select(F.when(F.col("g") == 0, F.col("place")).alias("place"), (F.col("g") == 1).alias("all_places"), "pairs", "plain", "planted", "only_planted", (F.col("planted") - F.col("plain") <= allowed).alias("met"))


def reach(rows: DataFrame, ways: list[str]) -> DataFrame:
    """Pages read of each kind, a column for each way to fetch."""
    return rows.groupBy("kind").pivot("way", ways).agg(F.count_if("read"))


def worst(rows: DataFrame, name: str) -> DataFrame:
    """The group (name, kept, of) that keeps the least share; of equals the first by name."""
    return rows.where(F.col("of") > 0).agg(F.min(F.struct((F.col("kept") / F.col("of")).alias("share"), F.col(name).alias("name"))).alias("m")).select(F.col("m.name").alias("name"), F.bround("m.share", 4).alias("share"))


def per_hundred(cost: Column, n: Column) -> Column:
    return F.bround(F.try_divide(100 * cost, n), 4)
