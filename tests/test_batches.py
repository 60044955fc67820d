"""Batches for Python: equal texts are read once, and a part of a batch at a time stands as Python objects."""

import sys
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quillcheck.functions import pytext, udfs
from quillcheck.functions.figures import figures
from quillcheck.sources import files

WORDS = pa.list_(pa.string())


def test_equal_texts_of_a_batch_are_read_once():
    read = []

    def upper(text):
        read.append(text)
        return (text or "none").upper()

    column = pa.array(["a", None, "b", "a", "b", None] * 50)
    assert udfs.of_batch(upper, pa.string(), column).to_pylist() == ["A", "NONE", "B", "A", "B", "NONE"] * 50
    assert sorted(read, key=str) == [None, "a", "b"]
    assert udfs.of_batch(upper, pa.string(), pa.array(["a", "b", "c"])).to_pylist() == ["A", "B", "C"]
    assert udfs.of_batch(upper, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_a_part_of_a_batch_at_a_time_is_python(monkeypatch):
    monkeypatch.setattr(udfs, "PART_BYTES", 1 << 16)
    texts = [f"text {n} " + "one two three " * 1500 for n in range(200)]
    column = pa.array(texts)
    tracemalloc.start()
    got = udfs.of_batch(pytext.words, WORDS, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 < column.nbytes
    assert got.to_pylist() == list(map(pytext.words, texts))


def test_rows_of_several_columns_and_nested_results():
    made = pa.list_(pa.struct([("value", pa.string()), ("kind", pa.string())]))
    got = udfs.of_batch(lambda a, b: figures(f"{a} and {b}"), made, pa.array(["$5", "6%"]), pa.array(["7", None]))
    assert got.to_pylist() == [[{"value": "5", "kind": "$"}, {"value": "7", "kind": ""}], [{"value": "6", "kind": "%"}]]


def test_words_without_figures_cost_no_steps():
    """The scanner's Python steps go by figures, not by words."""
    steps = []
    sys.setprofile(lambda frame, event, arg: steps.append(event))
    try:
        got = figures("us " + "word " * 5000 + "US$5, rs. 6 and Rs7.5")
    finally:
        sys.setprofile(None)
    assert got == [("5", "$"), ("6", "₹"), ("7.5", "₹")]
    assert len(steps) < 200


def test_batches_of_long_texts_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        rows = spark.range(0, 300, 1, 1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" and ")), 20_000).alias("t")).select("t", udfs.norm("t").alias("n"))
        size = F.arrow_udf(lambda c: pa.array([c.nbytes] * len(c), pa.int64()), "long")
        assert max(r.b for r in rows.select(size("n").alias("b")).distinct().collect()) < 12 << 20
    finally:
        spark.conf.set(key, was)


def test_lines_without_marks_of_a_kind_pass_its_pattern(monkeypatch):
    """Patterns run where a line has what they need, and lines of other characters than ASCII meet them all."""
    run = []

    class Seen:
        def __init__(self, kind, pattern):
            self.kind, self.pattern = kind, pattern

        def finditer(self, line):
            run.append(self.kind)
            return self.pattern.finditer(line)

    monkeypatch.setattr(pytext, "_SPECIFICS", {k: Seen(k, p) for k, p in pytext._SPECIFICS.items()})
    assert pytext.tagged("Order 7 costs $8 in all") == [("MONEY", "$8")] and run == ["MONEY"]
    assert pytext.tagged("Ten PERCENT, or 12 Percent") == [("PERCENT", "12 Percent")] and run[1:] == ["PERCENT"]
    assert pytext.tagged("4 ſtars") == [("RATING", "4 ſtars")] and len(run) == 9


def test_every_kind_has_its_marks():
    examples = {"MONEY": "5 USD", "PERCENT": "5 Percent", "RATING": "4 of 5, or 4 out of 5", "COUNT": "1,200 Customers", "DATE": "May 5", "QUOTE": '"' + "word " * 6 + '"', "ATTRIBUTION": "Studies say"}
    for kind, line in examples.items():
        assert kind in {k for k, _ in pytext.tagged(line)}


def test_tasks_of_narrow_rows_do_not_grow_with_the_table(spark, tmp_path):
    spark.range(0, 400_000, 1, 1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    cores = spark.sparkContext.defaultParallelism
    assert files.wide(rows).rdd.getNumPartitions() == cores
    dealt = files.wide(rows, 1 << 16)
    assert dealt.rdd.getNumPartitions() > 4 * cores and dealt.count() == 400_000
    assert files.wide(rows, 1 << 40).rdd.getNumPartitions() == cores
