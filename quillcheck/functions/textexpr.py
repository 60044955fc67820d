"""Text functions as Column expressions; those that end in ``_n`` take text in compared form (``udfs.norm``)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HOW, LEAST_CHARS, NEGATORS, STOP, WALL_CHARS, WALL_MARKS

_QUOTES_FROM, _QUOTES_TO = "\u2018\u2019\u201c\u201d\u2013\u2011\u00a0\u200b\u200c\u200d\u2060\ufeff", "''\"\"-- "


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside lambdas an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_composed(text: Column) -> Column:
    """``udfs.norm`` for text that is composed (NFC) already, as ASCII is; no Python."""
    plain = F.replace(F.translate(text, _QUOTES_FROM, _QUOTES_TO), F.lit("\u2014"), F.lit(" - "))
    no_commas = F.regexp_replace(F.lower(plain), r"(\d),(?=\d{3}(?U:\b))", "$1")
    # A single blank, as most are, is left as it is.
    return F.trim(F.regexp_replace(no_commas, r"(?U)[\s\x1c-\x1f\x85&&[^ ]][\s\x1c-\x1f\x85]*| [\s\x1c-\x1f\x85]+", " "))


def stem(word: Column) -> Column:
    """A meeting point of word forms: plural, then -ing or -ed, then -e."""
    n = F.length(word)
    y = F.concat(F.left(word, n - 3), F.lit("y"))
    s = F.when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1)).otherwise(word)
    # Lengths of the steps are told by regular expressions, which keep each step an expression of one column; few words need one.
    ing = F.when(word.contains("ing") | word.contains("ed"), F.regexp_replace(s, r"^(.{3,})ing$|^(.{4,})ed$", "$1$2")).otherwise(s)
    e = F.when(word.contains("e"), F.regexp_replace(ing, r"^(.{4,})e$", "$1")).otherwise(ing)
    return F.when((n > 4) & word.endswith("ies"), y).otherwise(e)


def tokens_n(text: Column) -> Column:
    spread = F.regexp_replace(F.replace(text, F.lit("cannot"), F.lit("can not")), r"(?U)n't\b", " not")
    return F.regexp_extract_all(spread, F.lit(r"(?U)([\w&&[^\d_]][\w+#]*)"), 1)


def bears_content(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(*STOP)


def content_words_n(text: Column) -> Column:
    return F.transform(F.filter(tokens_n(text), bears_content), stem)


def overlap_n(text: Column, support: Column, ignore: Column | None = None) -> Column:
    """The share of the text's content words, repeats counted, that the support has; 1 without any."""
    words = content_words_n(text)
    if ignore is not None:
        words = let(content_words_n(ignore), lambda skip: F.filter(content_words_n(text), lambda w: ~F.array_contains(skip, w)))

    def share(ws: Column, have: Column) -> Column:
        hit = F.size(F.filter(ws, lambda w: F.array_contains(have, w)))
        return F.when(F.size(ws) == 0, F.lit(1.0)).otherwise(hit / F.size(ws))

    return let(content_words_n(support), lambda have: let(words, lambda ws: share(ws, have)))


def negated_n(text: Column, shared: Column) -> Column:
    """Is one of the shared words within three tokens after a negator?"""
    def near(toks: Column) -> Column:
        after = F.transform(toks, lambda t, i: F.when(t.isin(*NEGATORS), F.slice(toks, i + 2, 3)).otherwise(F.array().cast("array<string>")))
        return F.transform(F.flatten(after), stem)

    return F.arrays_overlap(let(tokens_n(text), near), shared)


#: Of what a text has one if it has a negator; "n't" and "cannot" hold one too.
_NEGATOR_PARTS = [p for p in [*NEGATORS, "n't"] if not any(q != p and q in p for q in [*NEGATORS, "n't"])]


def may_negate_n(text: Column) -> Column:
    return reduce(or_, (text.contains(p) for p in _NEGATOR_PARTS))


def polarity_mismatch_n(a: Column, b: Column) -> Column:
    """Does one of two texts negate a content word that both have and the other doesn't? Texts without a negator are told at a glance."""
    def differ(shared: Column) -> Column:
        no = F.lit(False)
        return F.when(F.size(shared) == 0, no).otherwise(F.coalesce(negated_n(a, shared), no) != F.coalesce(negated_n(b, shared), no))

    return F.when(may_negate_n(a) | may_negate_n(b), let(F.array_intersect(content_words_n(a), content_words_n(b)), differ)).otherwise(F.lit(False))


def names_n(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)([\w&&[^_]]+)"), 1))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])(?U:\s)+|\n+"), lambda s: F.length(F.trim(F.regexp_replace(s, r"(?U)\s", ""))) > 0)


def windows(items: Column, span: int) -> Column:
    """Runs of ``span`` neighbours, one from each item on, joined by blanks."""
    return let(items, lambda own: F.transform(own, lambda _, i: F.array_join(F.slice(own, i + 1, span), " ")))


def canonical(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")


def evidence_id(url: Column) -> Column:
    return F.concat(F.lit("e"), F.substring(F.sha2(url, 256), 1, 8))


def as_data(text: Column) -> Column:
    """Text that a prompt can hold: no angle bracket can open or close a tag."""
    return F.translate(text, "<>", "‹›")


def how(via: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in HOW.items() for x in kv))[via], via)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def company_name(url: Column) -> Column:
    labels = F.split(host(url), r"\.")
    return F.initcap(F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1)))


def is_wall(title: Column, text: Column) -> Column:
    seen = F.lower(F.concat_ws(" ", title, text))
    hit = F.lit(False)
    for mark in WALL_MARKS:
        hit = hit | seen.contains(mark)
    return (F.length(text) <= WALL_CHARS) & hit


def is_long_enough(text: Column) -> Column:
    """A page's text counts from 200 characters on."""
    return F.length(text) >= LEAST_CHARS


def percent(k: Column, n: Column) -> Column:
    """ "k of n (p%)", with halves rounded to even."""
    return F.when(n == 0, F.format_string("%d of %d", k, n)).otherwise(F.format_string("%d of %d (%.0f%%)", k, n, F.bround(100.0 * k / n, 0)))


def page_part(text: Column, offset: int | Column, size: int = 40_000) -> Column:
    """A part of a page and, if there is more, where the next begins."""
    at = F.greatest(F.lit(0), F.lit(offset) if isinstance(offset, int) else offset)
    more = F.length(text) > at + size
    return F.struct(F.substring(text, at + 1, F.lit(size)).alias("part"), F.when(more, at + size).alias("next_offset"))
