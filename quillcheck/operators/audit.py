"""Audits of prose: checkable specifics, whether they are linked, and which page carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import textexpr as X
from ..functions import udfs as U
from ..sources import files


def specifics(texts: DataFrame) -> DataFrame:
    """doc, unit, kind, text, line, linked of each specific in ``texts`` (doc, text)."""
    return texts.select("doc", F.explode(U.specifics("text")).alias("s")).select("doc", "s.*")


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("linked").alias("linked"))


def trace(found: DataFrame, sources: DataFrame, least: float = 0.4) -> DataFrame:
    """``found`` with traced_to: the first source (seq) with two neighbouring sentences that carry all figures of the specific and
    at least that share of its line's content words.

    A line is looked up by its rarer content words alone: its most frequent ones, as long as they make up less than the
    share, cannot reach it without another. What meets is then tested exactly.
    """
    # A line's and a passage's names are digests of all they are, so that no two that differ share one.
    name = lambda *cols: F.sha2(F.to_json(F.struct(*cols)), 256)
    keyed = found.withColumn("__id", name("text", "line"))
    lines = keyed.select("__id", "text", "line").distinct().withColumn("figs", F.transform(U.figures("text"), lambda f: f["value"])).withColumn("cw", X.content_words_n(U.norm("line")))
    lines = files.kept(lines.select("__id", "figs", "cw"), "traced-lines")
    runs = sources.select("seq", "url", F.explode(U.passages("text", F.lit(2))).alias("p"))
    runs = runs.select("seq", "url", name("seq", "url", "p").alias("run"), F.transform(U.figures("p"), lambda f: f["value"]).alias("nums"), F.array_distinct(X.content_words_n(U.norm("p"))).alias("have"))
    runs = files.kept(runs.dropDuplicates(["run"]), "passages")
    by_word = runs.select("run", F.explode("have").alias("w"))
    often = by_word.groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    words = lines.select("__id", F.size("cw").alias("size"), F.explode("cw").alias("w")).groupBy("__id", "size", "w").agg(F.count(F.lit(1)).alias("times"))
    common = Window.partitionBy("__id").orderBy(F.desc("often"), "w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.join(often, "w").withColumn("so_far", F.sum("times").over(common)).where(F.col("so_far") >= least * F.col("size"))
    # Only names meet here; what lines and passages say is fetched for the pairs that met.
    met = words.select("__id", "w").join(by_word, "w").select("__id", "run").distinct().join(lines, "__id").join(runs, "run")
    share = F.size(F.filter("cw", lambda w: F.array_contains("have", w))) / F.size("cw")
    best = met.where((F.size(F.array_except("figs", "nums")) == 0) & (share >= least)).groupBy("__id").agg(F.min_by("url", "seq").alias("traced_to"))
    return keyed.join(best, "__id", "left").drop("__id")


def summary(found: DataFrame, texts: DataFrame) -> DataFrame:
    """lines, lines_with_specifics, specifics, linked, traced (null when nothing was traced against)."""
    n_units = texts.agg(F.sum(U.units("text")).cast("long").alias("lines"))
    traced = F.count("traced_to") if "traced_to" in found.columns else F.lit(None).cast("long")
    rest = found.agg(F.count_distinct("doc", "unit").alias("lines_with_specifics"), F.count(F.lit(1)).alias("specifics"), F.count_if("linked").alias("linked"), traced.alias("traced"))
    return n_units.join(rest)
