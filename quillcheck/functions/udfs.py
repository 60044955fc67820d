"""Arrow UDFs over the plain functions; a null text counts as empty."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import pages, pytext
from .figures import figures as figures_of

_FIGURES = "array<struct<value:string,kind:string>>"
#: What a part of a batch, which is all that stands as Python objects at a time, holds at most.
PART_BYTES, PART_ROWS = 1 << 20, 4096
#: What a batch sent to Python holds at most, where the session leaves Spark's 64 MB as it is.
BATCH_BYTES = "8m"


def lighten(spark: SparkSession) -> None:
    """Send Python smaller batches: a worker holds a batch and its results several times over, and long texts fill it.

    Frames are run after the call that made them, so the setting stays; one that was chosen is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def _in_parts(fn, made: pa.DataType, columns: list[pa.Array]) -> pa.Array:
    """``fn`` of each row, a part of the batch after another."""
    rows = len(columns[0])
    step = max(1, min(PART_ROWS, rows * PART_BYTES // max(1, sum(c.nbytes for c in columns))))
    parts = [pa.array(list(map(fn, *(c.slice(k, step).to_pylist() for c in columns))), made) for k in range(0, rows, step)]
    return pa.concat_arrays(parts) if parts else pa.array([], made)


def of_batch(fn, made: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``fn`` of each row of a batch; of one text that comes many times in a batch, once."""
    if len(columns) == 1 and pa.types.is_string(columns[0].type):
        own = columns[0].dictionary_encode(null_encoding="encode")
        if 2 * len(own.dictionary) < len(own):
            return _in_parts(fn, made, [own.dictionary]).take(own.indices)
    return _in_parts(fn, made, list(columns))


def _of(fn, kind: str, once: bool = False):
    """A UDF that is made when it is first used in a session; ``once``: the optimizer must not repeat it."""

    def call(*cols) -> Column:
        lighten(SparkSession.active())
        made = to_arrow_type(DataType.fromDDL(kind))
        run = arrow_udf(lambda *columns: of_batch(fn, made, *columns), kind)
        return (run.asNondeterministic() if once else run)(*cols)

    return call


norm = _of(lambda s: pytext.norm(s or ""), "string")
norm_lines = _of(lambda s: pytext.norm_lines(s or ""), "string")
figures = _of(lambda s: figures_of(s or ""), _FIGURES)
words = _of(lambda s: pytext.words(s or ""), "array<string>")
quote_run = _of(lambda q: pytext.quote_run(q or ""), "array<string>")
passage = _of(lambda q, s: pytext.passage(q or "", s or ""), "string")
context = _of(lambda q, s: pytext.context(q or "", s or ""), "struct<before:string,between:string,after:string>")
html_text = _of(lambda s: pages.html_text(s or ""), "struct<title:string,text:string>")
links = _of(lambda s, u: pages.links(s or "", u or ""), "array<struct<url:string,words:string>>")
passages = _of(lambda s, n: pytext.passages(s or "", n), "array<string>")
specifics = _of(lambda s: pytext.specifics(s or ""), "array<struct<unit:int,kind:string,text:string,line:string,linked:boolean>>")
units = _of(lambda s: len(pytext.units(s or "")), "int")
person = _of(lambda s, a: pytext.person(s or "", a or ""), "string")
statements = _of(
    lambda blocks: pytext.statements([(b["text"] or "", list(b["cited"] or ())) for b in blocks if b is not None] if blocks is not None else []),
    "array<struct<text:string,quote:string,cited:boolean,citations:int>>",
)
near_lines = _of(lambda parts, lines: pytext.near_lines(list(parts), list(lines)) if parts is not None and len(parts) and lines is not None else None, "array<int>")
breaks = _of(lambda s: list(pytext.breaks(s or "")), "array<int>")


def _page(text, title, url):
    """What the tests of any claim need of a page, made once for all of its claims."""
    parts = pages.address_parts(url or "")
    names = None if parts is None else parts[0] + pytext.words(parts[1])
    return pytext.norm_lines(text or ""), pytext.norm(title or ""), names


page = _of(_page, "struct<page:string,title:string,address:array<string>>", once=True)

FACTS = (
    f"struct<passage:string,claim_figures:{_FIGURES},quote_figures:{_FIGURES},passage_figures:{_FIGURES},subject_numbers:array<string>,"
    "named:boolean,claim_n:string,quote_n:string,subject_n:string>"
)


def _facts(text, quote, subject, title, seen):
    """What one claim's tests need of itself and of its page (title and text in compared form). Without a page: nulls."""
    if seen is None:
        return None
    quote = (quote or "").strip()
    found = pytext.place_in(quote, seen)
    subject_n = pytext.norm(subject or "")
    flat = seen.replace("\n", " ")
    named = subject_n in (f"{title} {flat}" if title else flat)
    folded = figures_of(found.passage, True) if found else []
    numbers = [value for value, _ in figures_of(subject or "")]
    return found and found.passage, figures_of(text or ""), figures_of(quote), folded, numbers, named, pytext.norm(text or ""), pytext.norm(quote), subject_n


facts = _of(_facts, FACTS, once=True)


LINE = f"struct<said:{_FIGURES},known:{_FIGURES},own:array<string>,text_n:string,basis_n:string,said_by_n:string>"


def _line(text, objection, basis, said_by, names):
    """What the tests of one line need of itself and of the facts it cites."""
    said = figures_of(f"{objection or ''} {text or ''}")
    own = [value for value, _ in figures_of(names or "")]
    return said, figures_of(basis or ""), own, pytext.norm(text or ""), pytext.norm(basis or ""), pytext.norm(said_by or "")


line = _of(_line, LINE, once=True)
