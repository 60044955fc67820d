"""Figures of a text: one pattern finds each run of digits with what stands beside it.

A figure is a value and a kind: a currency, "%" or nothing. What a figure takes along (a sign before it, digit groups, a
decimal, a scale, a plus, a kind behind it) are the parts of that pattern, in their order. Numbers in words are read word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from itertools import groupby, pairwise
from typing import NamedTuple

from ..schemas import CURRENCY_CODES, CURRENCY_SIGNS, MONEY_WORDS, SCALE_LETTERS, SCALE_WORDS, STYLE, TENS, UNITS

_WORD = re.compile(r"\w+")
_GAP, _BLANKS = re.compile(r"[\s-]+"), re.compile(r"\s+")
_STYLE = str.maketrans(STYLE)
_SMALL = {w: float(n) for n, w in enumerate(UNITS)} | {w: 10.0 * n for n, w in enumerate(TENS, 2)}
_LARGE = {"hundred": 100.0} | SCALE_WORDS
_JOINT = re.compile(r"\s?(?:-|to)\s?", re.I)
# Most texts have no number in words; a search in small letters tells sooner than a scan.
_BY_FIRST = groupby(sorted([*_SMALL, *_LARGE]), key=lambda w: w[0])
_MAY_HAVE_WORDS = re.compile(rf"(?<!\w)(?:{'|'.join(c + '(?:' + '|'.join(w[1:] for w in own) + ')' for c, own in _BY_FIRST)})(?!\w)")


def _either_case(words: Iterable[str]) -> str:
    """A pattern for words in letters whose small form is that; re.I would also take letters that only fold to it."""
    forms = lambda c: {x for x in (c, c.upper(), "\u212a" if c == "k" else c)}
    letter = lambda c: "[" + "".join(sorted(forms(c))) + "]" if c.isalpha() else re.escape(c)
    return "|".join("".join(map(letter, w)) for w in sorted(words, key=len, reverse=True))


_CODE = re.compile(rf"(?<!\w)({_either_case(CURRENCY_CODES)})(?![^\W\d])(?=\s?[.\d])\s?")
_BARE_POINT = re.compile(r"(?<![\w.])\.(?=\d)")
_SCALES = SCALE_LETTERS | SCALE_WORDS
#: A sign, a number in groups or not, and behind one that isn't within another run of digits: decimals, a scale, a plus, a kind.
_FIGURE = re.compile(
    rf"(?:(?<![\w.])([{CURRENCY_SIGNS}])\s?)?(?<![\w.])(\d{{1,3}}(?:,\d{{3}})+|\d+)"
    rf"(?:(?=\d)|((?:\.\d+)*)(?:({_either_case(_SCALES)})(?!\w)|[\s-]({_either_case(SCALE_WORDS)})(?!\w))?\+?"
    rf"(?:\s?(%|{_either_case(['percent'])}(?!\w))|\s({_either_case(MONEY_WORDS)})(?!\w))?)"
)


class Figure(NamedTuple):
    start: int
    end: int
    value: float
    kind: str
    scale: float | None


def _word(text: str, at: int) -> tuple[str, int]:
    """The word (letters, digits, underscores) from ``at`` on, in lower case, and where it ends."""
    m = _WORD.match(text, at)
    return (m[0].lower(), m.end()) if m else ("", at)


def _blank(text: str, at: int) -> int:
    """1 if a blank is there, else 0."""
    return text[at : at + 1].isspace()


def _kind_behind(text: str, at: int) -> tuple[str, int]:
    """What a figure that ends at ``at`` is made by what follows, and where that ends; nothing ends at ``at``."""
    gap = _blank(text, at)
    if text[at + gap : at + gap + 1] == "%":
        return "%", at + gap + 1
    word, end = _word(text, at + gap)
    if word == "percent":
        return "%", end
    return (MONEY_WORDS[word], end) if gap and word in MONEY_WORDS else ("", at)


def canonical(value: float) -> str:
    """A number's text: six places at most, no trailing zeros."""
    return f"{value:.6f}".rstrip("0").rstrip(".")


def with_signs(text: str) -> str:
    """Currency codes before a number become signs, and a decimal without a zero gets one."""
    signed = _CODE.sub(lambda m: CURRENCY_CODES[m[1].lower()], text)
    return _BARE_POINT.sub("0.", signed) if "." in signed else signed


def _numerals(text: str, folded: bool) -> Iterable[Figure]:
    """Figures in digits; those with two points or more are versions."""
    for m in _FIGURE.finditer(text):
        sign, number, decimals, letter, word, percent, money = m.groups()
        if decimals and decimals.count(".") > 1:
            continue
        kind = "%" if percent else MONEY_WORDS[money.lower()] if money else ""
        scale = letter or word
        # A small letter that may be a unit, as metres and bytes are, counts where letters were folded or money is meant.
        if letter and not folded and not sign and kind in ("", "%") and letter.islower() and letter != "k" and letter in SCALE_LETTERS:
            scale = None
        value = float((number.replace(",", "") if "," in number else number) + (decimals or ""))
        yield Figure(m.start(), m.end(), value, sign or kind, _SCALES[scale.lower()] if scale else None)


def _shared(found: list[Figure], text: str) -> list[Figure]:
    """Figures of a range have one kind, the first that is known from the left, and a scale on the right counts for the left."""
    if len(found) < 2:
        return found
    joined = [b.start - a.end <= 4 and bool(_JOINT.fullmatch(text, a.end, b.start)) for a, b in pairwise(found)] + [False]
    if not any(joined):
        return found
    out, carried, linked = [], "", False
    for n, (figure, more) in enumerate(zip(found, joined, strict=True)):
        carried = (carried if linked else "") or figure.kind
        scale = figure.scale
        if more:
            right = found[n + 1]
            carried, scale = carried or right.kind, scale or right.scale
        out.append(figure._replace(kind=carried, scale=scale))
        linked = more
    return out


def _hundreds(words: list[str]) -> float:
    """Small numbers with "hundred" between them."""
    parts = " ".join(words).split("hundred")
    sums = [sum(_SMALL[w] for w in p.split()) for p in parts]
    return reduce(lambda so_far, more: 100 * (so_far or 1) + more, sums)


def amount(words: list[str]) -> float:
    """What number words come to: each large scale closes the words since the one before."""
    total, since = 0.0, list[str]()
    for w in words:
        if w in SCALE_WORDS:
            total += SCALE_WORDS[w] * (_hundreds(since) or 1)
            since = []
        else:
            since.append(w)
    return total + _hundreds(since)


def _numbers_in_words(text: str, taken: list[Figure]) -> Iterable[tuple[str, str]]:
    at = 0
    while m := _WORD.search(text, at):
        at = m.end()
        if (first := m[0].lower()) not in _SMALL and first not in _LARGE:
            continue
        words = [first]
        while (more := _next_number_word(text, at)) is not None:
            words.append(more[0])
            at = more[1]
        kind, at = _kind_behind(text, at)
        idiom = words == ["one"] or not any(w in _SMALL for w in words)
        if not idiom and not any(f.start <= m.start() < f.end for f in taken):
            yield canonical(amount(words)), kind


def _next_number_word(text: str, at: int) -> tuple[str, int] | None:
    """The number word that blanks, hyphens and an "and" part from ``at``, and where it ends, if there is one."""
    if not (gap := _GAP.match(text, at)):
        return None
    word, end = _word(text, gap.end())
    if word == "and" and (blanks := _BLANKS.match(text, end)):
        word, end = _word(text, blanks.end())
    return (word, end) if word in _SMALL or word in _LARGE else None


def figures(text: str, folded: bool = False) -> list[tuple[str, str]]:
    """(value, kind) of each figure, those in digits first. ``folded``: the text was lower-cased."""
    if not text:
        return []
    plain = with_signs(text if text.isascii() else text.translate(_STYLE))
    has_words = _MAY_HAVE_WORDS.search(plain.lower())
    digits = _shared(list(_numerals(plain, folded)), plain)
    found = [(canonical(f.value * (f.scale or 1.0)), f.kind) for f in digits]
    return [*found, *_numbers_in_words(plain, digits)] if has_words else found
