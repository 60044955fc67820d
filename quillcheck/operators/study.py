"""A study's labels and results: blind sheets, two labellers, settlement, the gate, and tables of what was caught."""

from __future__ import annotations

import hashlib
import inspect
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

#: The two questions that a labeller answers of each claim.
QUESTIONS = ("page_states", "quote_states")
#: Agreed labels that a person reads as a check, and how many of those may fall.
SAMPLE, MOST_OVERTURNED = 50, 5


def seeded(key: Column, seed: int = 11) -> Column:
    """An order that looks random, the same on every cluster: a seeded hash."""
    return F.sha2(F.concat(F.lit(str(seed)), key.cast("string")), 256)


def all_claims(shared: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """Claims of both kinds, each with its arm_set."""
    rows = shared.withColumn("arm_set", F.lit("shared"))
    return rows if citations is None else rows.unionByName(citations.withColumn("arm_set", F.lit("citations")), allowMissingColumns=True)


def sheet(claims: DataFrame, key: str = "id", shown: tuple[str, ...] = ("id", "subject", "evidence_id", "text", "quote"), seed: int = 11) -> DataFrame:
    """What labellers see: nothing that tells who wrote a claim or what was decided, in a seeded order."""
    return claims.orderBy(seeded(F.col(key), seed), key).select(*shown)


def two_labellers(claims: DataFrame, one: DataFrame, two: DataFrame, key: str = "id", questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """Each claim's key with both labellers' answers (one_<question>, two_<question>); a claim that one hasn't labelled raises."""
    rows = claims.select(key)
    for name, labels in (("one", one), ("two", two)):
        rows = metrics.need_all(rows, labels.select(key, *(F.col(q).alias(f"{name}_{q}") for q in questions)), key)
    return rows


def to_settle(both: DataFrame, key: str = "id", questions: tuple[str, ...] = QUESTIONS, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """key and why (disputed or sampled): what a person reads.

    All claims on which the labellers differ or which one says the page does not state, and of the others
    ``sample``, drawn by a seeded hash.
    """
    differ = F.lit(False)
    for q in questions:
        differ = differ | (F.col(f"one_{q}") != F.col(f"two_{q}"))
    must = differ | ~F.col(f"one_{questions[0]}") | ~F.col(f"two_{questions[0]}")
    drawn = both.where(~must).orderBy(seeded(F.col(key), seed), key).limit(sample)
    return both.where(must).select(key, F.lit("disputed").alias("why")).unionByName(drawn.select(key, F.lit("sampled").alias("why")))


def label_stats(both: DataFrame, settling: DataFrame, person: DataFrame, key: str = "id", questions: tuple[str, ...] = QUESTIONS, most: int = MOST_OVERTURNED) -> DataFrame:
    """One row: claims, disputed, sampled, overturned (agreed labels that the person changed), agreement and kappa of each question, stands.

    The labels stand if no more than ``most`` of the sampled ones fell, or if the person read every claim. A claim to settle that
    the person hasn't labelled raises.
    """
    read = person.select(F.col(key), *(F.col(q).alias(f"own_{q}") for q in questions))
    metrics.need_all(settling, read, key)
    rows = both.join(settling, key, "left").join(read, key, "left")
    fell = F.lit(False)
    for q in questions:
        fell = fell | (F.col(f"own_{q}") != F.col(f"one_{q}"))
    counts = [
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("why") == "disputed").alias("disputed"),
        F.count_if(F.col("why") == "sampled").alias("sampled"),
        F.count_if((F.col("why") == "sampled") & fell).alias("overturned"),
        F.bool_and(F.col(f"own_{questions[0]}").isNotNull()).alias("all_read"),
    ]
    for q in questions:
        x, y = F.col(f"one_{q}"), F.col(f"two_{q}")
        counts += [F.count_if(x == y).alias(f"{q}_agree"), F.bround(metrics.kappa(x, y), 3).alias(f"{q}_kappa")]
    return rows.agg(*counts).withColumn("stands", (F.col("overturned") <= most) | F.col("all_read"))


def final_labels(both: DataFrame, person: DataFrame, stats: DataFrame | None = None, key: str = "id", questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """Each claim's labels: the person's where there is one, the agreed ones elsewhere. With ``stats`` that don't stand, it raises."""
    if stats is not None and not stats.first().stands:
        raise ValueError("too many agreed labels were overturned; every claim must be read")
    own = person.select(F.col(key), *(F.col(q).alias(f"own_{q}") for q in questions))
    return both.join(own, key, "left").select(key, *(F.coalesce(f"own_{q}", f"one_{q}").alias(q) for q in questions))


def bounds(both: DataFrame, key: str = "id", questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """strict_<question> and lenient_<question>: yes by both labellers, and by either; every settlement lies between."""
    pairs = {q: metrics.strict_lenient(F.col(f"one_{q}"), F.col(f"two_{q}")) for q in questions}
    return both.select(key, *(c.alias(f"{n}_{q}") for q, both_ in pairs.items() for n, c in zip(("strict", "lenient"), both_, strict=True)))


def frozen(*modules: ModuleType) -> dict[str, str]:
    """A hash of the source of each module that decides a claim, to be kept with results."""
    return {m.__name__: hashlib.sha256(inspect.getsource(m).encode()).hexdigest()[:16] for m in modules}


def caught_by_type(rows: DataFrame, most_listed: int = 100) -> DataFrame:
    """type, n, caught, caught_by (reason to number) and missed (ids, the first ``most_listed``) of planted claims (id, type, supported, reason)."""
    by = rows.groupBy("type", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("supported")).alias("caught"))
    tables = by.groupBy("type").agg(F.sum("n").alias("n"), F.sum("caught").alias("caught"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("caught") > 0, F.struct("reason", "caught"))))).alias("caught_by"))
    place = F.row_number().over(metrics.Window.partitionBy("type").orderBy("id"))
    listed = rows.where("supported").select("type", "id", place.alias("k")).where(F.col("k") <= most_listed)
    missed = listed.groupBy("type").agg(F.array_sort(F.collect_list("id")).alias("missed"))
    return tables.join(missed, "type", "left").select("type", "n", "caught", "caught_by", F.coalesce("missed", F.array().cast(rows.schema["id"].dataType.simpleString().join(("array<", ">")))).alias("missed"))


def per_labeller(rows: DataFrame) -> DataFrame:
    """What each labeller's answers say of the decisions (labeller, kept, page_states, quote_states): four pairs of k and n."""
    kept, page, quote = F.col("kept"), F.col("page_states"), F.col("quote_states")
    pairs = {"kept_page_states": (kept & page, kept), "page_true_kept": (page & kept, page), "quote_yes_kept": (quote & kept, quote), "quote_no_cut": (~quote & ~kept, ~quote)}
    return rows.groupBy("labeller").agg(*(F.count_if(c).alias(f"{name}_{part}") for name, (k, n) in pairs.items() for part, c in (("k", k), ("n", n))))


def brief_bars(items: DataFrame, labels: DataFrame) -> DataFrame:
    """bar, k, n, met of a brief's items (id, what: signal or line, kept) under labels (id, page_states, adds_fact, names_a_person).

    Of the kept signals 95% must be stated by their page, of the true ones 70% kept; no kept line may add a fact, and no kept item may
    name a person. An item without a label raises.
    """
    rows = metrics.need_all(items, labels, "id")
    signal, kept, true = F.col("what") == "signal", F.col("kept"), F.coalesce("page_states", F.lit(False))
    adds, person = F.coalesce("adds_fact", F.lit(False)), F.coalesce("names_a_person", F.lit(False))
    asked = {
        "kept signals the page states": (signal & kept & true, signal & kept, 0.95),
        "true signals kept": (signal & true & kept, signal & true, 0.70),
        "kept lines that add a fact": (~signal & kept & adds, ~signal & kept, None),
        "kept items that name a person": (kept & person, kept, None),
    }
    counts = rows.agg(*(F.count_if(c).alias(f"{part}{i}") for i, (k, n, _) in enumerate(asked.values()) for part, c in (("k", k), ("n", n))))
    table = []
    for i, (name, (_, _, least)) in enumerate(asked.items()):
        k, n = F.col(f"k{i}"), F.col(f"n{i}")
        met = k == 0 if least is None else (n > 0) & (k / n >= least)
        table.append(F.struct(F.lit(name).alias("bar"), k.alias("k"), n.alias("n"), F.coalesce(met, F.lit(False)).alias("met")))
    return counts.select(F.explode(F.array(*table)).alias("r")).select("r.*")


def red_team_bar(rows: DataFrame, words: list[str], most: int = 2, least: int = 6) -> DataFrame:
    """past_both, written and met of the techniques that some words name: ``most`` may get past both, and ``least`` must have been written."""
    return metrics.by_words(rows, words).select("past_both", "written", ((F.col("past_both") <= most) & (F.col("written") >= least)).alias("met"))


def card_bar(facts: DataFrame, labels: DataFrame, least: float = 0.8) -> DataFrame:
    """kept, true, bad_second and met of a card's facts (id, supported, second_quote) under labels (id, page_states).

    At least that share of the true facts is kept, and no second quote stands on a fact that the page does not state.
    """
    rows = metrics.need_all(facts, labels, "id")
    true, second = F.col("page_states"), F.coalesce("second_quote", F.lit(False))
    counts = rows.agg(F.count_if(true & F.col("supported")).alias("kept"), F.count_if(true).alias("true"), F.count_if(second & ~true).alias("bad_second"))
    met = (F.col("true") > 0) & (F.col("kept") / F.col("true") >= least) & (F.col("bad_second") == 0)
    return counts.withColumn("met", F.coalesce(met, F.lit(False)))
