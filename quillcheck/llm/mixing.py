"""Mixing sources to target weights by Poisson replication (operator 10), in DataFrame functions only.

A source's rate is its weight's share of the wanted total over its number of documents. A document is
repeated k times, k drawn from the Poisson distribution with that mean by inverting its
distribution function at a number in [0, 1) hashed from seed and doc_id; rows of one doc_id draw the same. A rate above
``MOST_RATE`` is cut into equal parts that are drawn one by one and added, which is the same distribution, so that a table of the
distribution function is small at any rate.
Copies get a hashed position and are dealt to partitions by it, so a source of any size
spreads evenly and the order is global: ascending ``position`` across partitions is a random order.

Defined results: a null source is a source of its own; a null doc_id draws like the text "null"; null and empty texts and texts of any
length are repeated like others; rows that repeat are repeated each; sources that ``weights`` doesn't name have weight 0 and go; an empty
table gives an empty result; other columns are passed through, whatever their names, but for those with the names of the two new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, unused

#: The largest rate that is drawn at once.
MOST_RATE = 64.0
#: Copies that are listed at once.
_RUN = 65_536


def uniform_hash(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 digest's first 48 bits."""
    return hashed(*parts) / F.lit(float(2**48))


def hashed(*parts: Column) -> Column:
    """The first 48 bits of an MD5 digest, as a long."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as far as it is told from 1, for a rate of ``MOST_RATE`` or less.

    Each term is exp(k ln(rate) - rate - ln k!), so no term underflows that counts.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_fact"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def term(acc: Column, k: Column) -> Column:
        log_fact = acc["log_fact"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(F.lit(0.0))
        total = acc["sum"] + F.exp(k * F.log(rate) - rate - log_fact)
        return F.struct(log_fact.alias("log_fact"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    grown = F.aggregate(F.sequence(F.lit(0), last), start, term, lambda acc: acc["cdf"])
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float = 1.0) -> DataFrame:
    """source, n, rate, parts (of the rate) and cdf (of a part) of every source; ``total`` is the wanted size as a multiple of the input's.

    Without ``weights`` every source weighs the same.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight: Column = F.lit(1.0)
    elif weights:
        weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(0.0)).cast("double")
    else:
        weight = F.lit(0.0)
    counts = stage(counts.withColumn("weight", weight), "source-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    if not sums.n or not sums.w:
        return counts.select("source", "n", F.lit(0.0).alias("rate"), F.lit(1).alias("parts"), F.array(F.lit(1.0)).alias("cdf"))
    rate = F.col("weight") / F.lit(float(sums.w)) * F.lit(float(total) * sums.n) / F.col("n")
    rates = counts.select("source", "n", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE).cast("int")))
    return stage(rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts"))), "source-rates")


def drawn(seed: int, doc_id: Column, parts: Column, cdf: Column) -> Column:
    """The sum of the parts' draws, each the number of values of the distribution function up to a hashed number."""

    def draw(u: Column) -> Column:
        # Bound by a lambda, so that the hash is taken once and not for every value.
        return F.get(F.transform(F.array(u), lambda x: F.size(F.filter(cdf, lambda c: c <= x))), F.lit(0)).cast("long")

    first = draw(uniform_hash(F.lit(seed), doc_id))
    others = F.aggregate(F.sequence(F.lit(1), parts - 1), F.lit(0).cast("long"), lambda acc, j: acc + draw(uniform_hash(F.lit(seed), F.lit("part"), j, doc_id)))
    return F.when(parts > 1, first + others).otherwise(first)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float = 1.0, seed: int = 42, shuffled: bool = True, names: tuple[str, str] = ("copy", "position")) -> DataFrame:
    """``docs`` with each row repeated by its draw; the new columns are a copy's number (from 0) and its position."""
    copy, position = names
    docs = docs.drop(copy, position)
    source, parts, cdf, times, run = unused([*docs.columns, copy, position], "of_source", "parts", "cdf", "times", "run")
    rates = source_rates(docs, weights, total).select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    rows = docs.join(rates, docs["source"].eqNullSafe(rates[source]))
    rows = rows.withColumn(times, drawn(seed, docs["doc_id"], F.col(parts), F.col(cdf))).where(F.col(times) > 0)
    own = [F.col(f"`{c}`") for c in docs.columns]
    # Many copies are listed in runs, as no list of them all need fit in a row.
    first = F.col(run) * _RUN
    rows = rows.select(*own, times, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / _RUN))).alias(run))
    rows = rows.select(*own, F.explode(F.sequence(first, F.least(first + _RUN, F.col(times)) - 1)).alias(copy)).withColumn(copy, F.col(copy).cast("int"))
    rows = rows.withColumn(position, hashed(F.lit(seed), F.lit("position"), F.col("doc_id"), F.col(copy)))
    return rows.repartition(partitions(docs), position).sortWithinPartitions(position) if shuffled else rows
