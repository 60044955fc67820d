"""The code check: each claim against the page it cites, by ordered tests of which the first failure is the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textexpr as X
from ..functions import udfs as U


def check_claims(claims: DataFrame, evidence: DataFrame, min_overlap: float = 0.5, max_age_days: int | None = None, now: str | None = None) -> DataFrame:
    """One verdict per claim row, by position. Null texts count as empty; a page that is not there cuts.

    Pages are brought to compared form once, before they meet their claims by id (Spark broadcasts them when they are small and
    splits skewed pages when they aren't); what a claim's tests need of its page is found by one Arrow UDF, and page texts go no further.
    """
    pages = evidence.select(F.col("id").alias("e_id"), F.coalesce("url", F.lit("")).alias("e_url"), F.coalesce("fetched_at", F.lit("")).alias("e_at"), U.page("text", "title", "url").alias("p"))
    pages = pages.select("e_id", "e_url", "e_at", F.col("p.page").alias("e_page"), F.col("p.title").alias("title_n"), F.col("p.address").alias("address"))
    c = claims.select("pos", F.coalesce("id", F.lit("")).alias("id"), *(F.coalesce(n, F.lit("")).alias(n) for n in ("text", "quote", "evidence_id", "subject")))
    joined = c.join(pages, c["evidence_id"] == pages["e_id"], "left")
    facts = U.facts("text", "quote", "subject", "title_n", "e_page")
    f = joined.withColumn("f", facts).select("pos", "id", "evidence_id", "subject", "e_id", "e_url", "e_at", "title_n", "address", "f.*")
    reason, detail = ladder(min_overlap)
    f = f.withColumn("reason", reason)
    supported = F.col("reason") == "ok"
    stale = supported & is_stale(F.col("e_at"), max_age_days, now)
    early = F.col("reason").isin("no_evidence", "no_quote", "quote_not_in_source")
    return f.select("pos", F.col("id").alias("claim_id"), supported.alias("supported"), "reason", detail.alias("detail"), F.when(~early, F.lit("exact")).alias("match"), stale.alias("stale"), F.coalesce("e_url", F.lit("")).alias("url"))


def missing_figures() -> Column:
    """Figures of the claim that quote or passage lack; a bare number of the subject's name is exempt where the page has that name."""
    lacks = lambda x: ~(F.array_contains("quote_figures", x) & F.array_contains("passage_figures", x))
    own = lambda x: (x["kind"] == "") & F.col("named") & F.array_contains("subject_numbers", x["value"])
    return F.transform(F.filter("claim_figures", lambda x: ~own(x) & lacks(x)), lambda x: x["value"])


def within(subject_n: Column, names: Column) -> Column:
    """Are all of a subject's names among some names?"""
    return F.size(F.array_except(X.names_n(subject_n), names)) == 0


def wrong_subject() -> Column:
    """Is the subject neither that of the page (its title, its address) nor in the quote? One without a name always is."""
    subject = F.col("subject_n")
    about = F.concat(X.names_n(F.col("title_n")), F.coalesce("address", F.array().cast("array<string>")))
    return (F.size(X.names_n(subject)) == 0) | ~(within(subject, about) | within(subject, X.names_n(F.col("quote_n"))))


def ladder(min_overlap: float) -> tuple[Column, Column]:
    """The reason of a claim's first failing test, and its detail."""
    share = X.overlap_n(F.col("claim_n"), F.col("quote_n"), F.col("subject_n"))
    reason = (
        F.when(F.col("e_id").isNull(), "no_evidence")
        .when((F.size(X.tokens_n(F.col("quote_n"))) < 3) & (F.size("quote_figures") == 0), "no_quote")
        .when(F.col("passage").isNull(), "quote_not_in_source")
        .when(wrong_subject(), "wrong_subject")
        .when(F.size(missing_figures()) > 0, "figure_not_in_quote")
        .when(X.polarity_mismatch_n(F.col("claim_n"), F.col("passage")), "polarity_mismatch")
        .when(share < min_overlap, "beyond_quote")
        .when(share >= min_overlap, "ok")
        .otherwise("unread")
    )
    r = F.col("reason")
    detail = (
        F.when(r == "no_evidence", F.col("evidence_id"))
        .when(r == "wrong_subject", F.when(F.size(X.names_n(F.col("subject_n"))) == 0, "the claim has no subject").otherwise(F.col("subject")))
        .when(r == "figure_not_in_quote", F.array_join(missing_figures(), ", "))
        .when(r == "beyond_quote", F.concat(F.format_string("%.0f", F.bround(share * 100, 0)), F.lit("% of its words are in the quote")))
        .otherwise("")
    )
    return reason, detail


def is_stale(fetched_at: Column, max_age_days: int | None, now: str | None) -> Column:
    """Was the page read more than so many days before ``now``? Times without a zone are UTC."""
    if max_age_days is None:
        return F.lit(False)
    moment = F.current_timestamp() if now is None else F.to_timestamp(F.lit(now))
    at = F.try_to_timestamp(F.regexp_replace(fetched_at, "Z$", "+00:00"))
    return F.coalesce(at < moment - F.make_dt_interval(F.lit(max_age_days)), F.lit(False))


def by_reason(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def report(verdicts: DataFrame) -> DataFrame:
    """Totals: total, supported, cut, stale, and the exit code (3: something unread; 1: something cut; else 0)."""
    n = lambda c: F.count_if(c)
    rows = verdicts.agg(F.count(F.lit(1)).alias("total"), n(F.col("supported")).alias("supported"), n(~F.col("supported")).alias("cut"), n(F.col("stale")).alias("stale"), n(F.col("reason") == "unread").alias("unread"))
    return rows.withColumn("exit_code", F.when(F.col("unread") > 0, 3).when(F.col("cut") > 0, 1).otherwise(0)).drop("unread")
