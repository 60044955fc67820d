"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.llm import line_dedup, mixing, packing, quality, simhash
from quillcheck.llm.common import drop_written, stage, unused, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go.

    A null text is scored as an empty one; a text of any length is scored whole; rows that repeat share their score, and a score of
    0.5 stays; an empty table stays empty; all columns are passed through, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (score,) = unused(docs.columns, "score")
    return quality.classify(docs, labels, name=score).where(F.col(score) >= 0.5).drop(score)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all; the other lines stay, in their order.

    A text without such lines, null or empty ones too, stays as it is; rows that repeat count as documents of their own; an empty table
    stays empty. Where lines go, n_chars is counted anew; all other columns are passed through, whatever their names.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    # Under names of its own, so that a column named like one of the results isn't replaced.
    named = docs.select(*(F.col(f"`{c}`").alias("text" if c == "text" else n) for c, n in own.items()))
    done = line_dedup.line_dedup(named, min_docs=10, min_chars=1)
    text = F.when(F.col("line_drops") > 0, F.col("kept_text").cast("string")).otherwise(F.col("text"))
    cols = {"text": text}
    if "n_chars" in own:
        cols["n_chars"] = F.when(F.col("line_drops") > 0, F.length(text)).otherwise(F.col(own["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return done.select(*(cols.get(c, F.col(n)).alias(c) for c, n in own.items()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id (null last, then by the text's hash).

    Near copies share 0.8 or more of their five-word shingles. Null, empty and blank texts are copies of each other; a text of any length
    is read whole; of rows that repeat one stays; an empty table stays empty; all columns are passed through, whatever their names.
    """
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources come to equal shares, and are shuffled.

    A null source is one of its own; null and empty texts and texts of any length are repeated like others; rows of one doc_id draw the
    same; an empty table stays empty; all columns are passed through, whatever their names.
    """
    copy, position = unused(docs.columns, "copy", "position")
    return mixing.mix(docs, weights=None, total=1.0, seed=42, names=(copy, position)).drop(copy, position)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece of a document.

    A null or empty text is the end id alone; a longer one than a sequence is cut into pieces; copies are documents of their own; an empty
    table gives an empty result; columns other than doc_id and text are ignored, whatever their names.
    """
    return packing.pack(docs, size=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no fit of a classifier, no XXH64 and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; what a stage wrote on its way is deleted when its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        before = list(written(spark))
        docs = stage(function(spark, docs, sf_dir), name)
        since = [path for path in written(spark) if path not in before]
        drop_written(spark, since[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
