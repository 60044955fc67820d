"""Claims, ledgers, JSON lines and pages from files, and their sinks."""

from __future__ import annotations

import html as _html
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textexpr as X
from ..functions import udfs as U
from ..schemas import REASONS

_CLAIM = "struct<id:string,text:string,quote:string,evidence_id:string,subject:string,topic:string>"
_LEDGER = "id string, url string, text string, title string, fetched_at string, sha256 string, via string"
_FIELDS = ("id", "text", "quote", "evidence_id", "subject", "topic")


def wide(rows: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """A scan's rows, dealt anew where it has fewer partitions than there are cores: small files and much work a row.

    Large tables have more partitions than cores and stay as they are. For scans only: a plan with exchanges would run them.
    ``task_bytes``: of narrow rows that become many, no task has more of a scan's (estimated) bytes, so that its seconds don't grow with the table.
    """
    # The frame's own plan tells its partitions and its size; nothing runs.
    plan = rows._jdf.queryExecution()
    least = rows.sparkSession.sparkContext.defaultParallelism
    if task_bytes is not None:
        least = max(least, math.ceil(int(plan.optimizedPlan().stats().sizeInBytes()) / task_bytes))
    return rows if plan.toRdd().getNumPartitions() >= least else rows.repartition(least)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may run without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="quillcheck-")


def kept(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written out as Parquet under the shared folder and read back, so that nothing computes them again."""
    path = f"{shared_folder(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of JSON files that hold a list of objects or {"claims": [...]}; anything else raises.

    A missing field is empty; a missing id becomes "c" and the place in the list, from 1.
    """
    raw = spark.read.text(path, wholetext=True)
    listed = F.ltrim("value").startswith("[")
    rows = F.when(listed, F.from_json("value", f"array<{_CLAIM}>")).otherwise(F.from_json("value", f"struct<claims:array<{_CLAIM}>>")["claims"])
    checked = raw.select(F.when(rows.isNull(), F.raise_error(F.lit("claims must be a list of objects"))).otherwise(rows).alias("rows"))
    out = checked.select(F.posexplode("rows").alias("pos", "c")).select(F.col("pos").cast("long").alias("pos"), "c.*")
    ids = F.when(F.coalesce("id", F.lit("")) == "", F.concat(F.lit("c"), (F.col("pos") + 1).cast("string"))).otherwise(F.col("id"))
    return out.select("pos", ids.alias("id"), *(F.coalesce(n, F.lit("")).alias(n) for n in _FIELDS[1:]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger's pages; a row without id, text or a fitting hash raises. Fields it does not know are passed over."""
    rows = spark.read.schema(_LEDGER).option("mode", "FAILFAST").json(path, multiLine=True)
    return validated(rows)


def hash_fits() -> F.col:
    return F.coalesce((F.coalesce("id", F.lit("")) != "") & F.col("text").isNotNull() & (F.sha2("text", 256) == F.col("sha256")), F.lit(False))


def validated(rows: DataFrame) -> DataFrame:
    problem = F.concat(F.lit("ledger row does not fit its hash: "), F.coalesce("id", F.lit("(no id)")))
    return rows.withColumn("text", F.when(hash_fits(), F.col("text")).otherwise(F.raise_error(problem)))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, and a path without files has no rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def ledger_json(evidence: DataFrame) -> DataFrame:
    """The ledger as JSON objects, one a row; partitions can be written as they are."""
    return evidence.select(F.to_json(F.struct(*_LEDGER.replace(" string", "").split(", "))).alias("value"))


def add_text(rows: DataFrame) -> DataFrame:
    """Ledger rows of (seq, url, title, text, fetched_at, via): hash, id, version.

    A base id's first text has that id; each other text, of the same url or of one whose base id is the same, has a suffix of its
    hash. A text that comes again keeps its id, and its last row is the one that stays.
    """
    hashed = rows.withColumn("sha256", F.sha2("text", 256)).withColumn("base", X.evidence_id(F.col("url")))
    first = hashed.groupBy("base").agg(F.min_by("sha256", "seq").alias("first_sha"))
    last = hashed.groupBy("base", "sha256").agg(F.max_by(F.struct(*(c for c in hashed.columns if c not in ("base", "sha256"))), "seq").alias("r"))
    own = last.join(first, "base")
    ids = F.when(F.col("sha256") == F.col("first_sha"), F.col("base")).otherwise(F.concat("base", F.lit("."), F.substring("sha256", 1, 6)))
    return own.select("r.seq", ids.alias("id"), "r.url", "r.text", "r.title", "r.fetched_at", "sha256", "r.via")


def latest(evidence: DataFrame) -> DataFrame:
    """The last page read of each url."""
    return evidence.groupBy("url").agg(F.max_by("id", "seq").alias("id"), F.max("seq").alias("seq"))


def pages_from_files(spark: SparkSession, path: str) -> DataFrame:
    """path, title, text of text or HTML files; ``usable`` tells pages of 200 characters or more that are no wall."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    is_html = F.lower("path").rlike(r"\.html?$") | F.ltrim("value").startswith("<")
    read = raw.withColumn("h", F.when(is_html, U.html_text("value")).otherwise(F.struct(F.lit("").alias("title"), F.trim("value").alias("text"))))
    return read.select("path", "h.title", "h.text", (~X.is_wall(F.col("h.title"), F.col("h.text")) & X.is_long_enough(F.col("h.text"))).alias("usable"))


def expected_runs(results: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """name, result: "not run" where there is no result; absence is never taken for a figure. ``names``: a list, or a table with a column name."""
    wanted = names.select("name") if isinstance(names, DataFrame) else results.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return wanted.join(results, "name", "left").select("name", F.coalesce("result", F.lit("not run")).alias("result"))


def console_lines(verdicts: DataFrame) -> DataFrame:
    why = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("reason")]
    text = F.concat(F.when(F.col("supported"), "PASS ").otherwise("CUT  "), "claim_id", F.lit(": "), why, F.when(F.col("detail") != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise(""))
    return verdicts.select("pos", text.alias("line"))


def html_rows(verdicts: DataFrame) -> DataFrame:
    """A table row of HTML for each verdict, all text escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = (F.when(F.col("supported"), "kept").otherwise("cut"), F.col("claim_id"), F.col("reason"), F.col("detail"), F.col("url"))
    return verdicts.select("pos", F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in cells), F.lit("</tr>")).alias("html"))


def html_page(title: str, rows: list[str]) -> str:
    """A small report's page, from rows that were collected within a limit of the caller's."""
    return f"<!doctype html><title>{_html.escape(title)}</title><table>{''.join(rows)}</table>"


def dedupe_first(rows: DataFrame, key: F.col, *order: str) -> DataFrame:
    """The first row of each key in the given order, by an aggregate: a key with any number of rows sends one per task."""
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(*order)).alias("row")
    return rows.groupBy(key.alias("key")).agg(first).select("row.*")


def read_corpus(spark: SparkSession, index: str, folder: str) -> DataFrame:
    """seq, company, url, title, text of an encyclopedia corpus: an index (company, url, file) beside text files."""
    rows = spark.read.schema("company string, url string, file string").json(index, multiLine=True)
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("file"), F.col("value").alias("text"))
    name = F.replace(F.url_decode(F.element_at(F.split("url", "/"), -1)), F.lit("_"), F.lit(" "))
    return rows.join(texts, "file").select("company", "url", F.concat(name, F.lit(" - Wikipedia")).alias("title"), "text")


def report_json(verdicts: DataFrame) -> DataFrame:
    """One JSON object per verdict, for files; totals are in ``check.report``."""
    return verdicts.select("pos", F.to_json(F.struct("claim_id", "supported", "reason", "detail", "match", "stale", "url")).alias("value"))
