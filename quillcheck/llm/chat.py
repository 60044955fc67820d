"""Chat formatting as packed prefix trees (operator 2).

A turn is written ``<s>[INST]role[/INST]text</s>``; inside roles and texts a backslash follows every ``<``,
``[`` and backslash, so no control string is left there and unescaping is exact. Conversations are
sorted by their turns' digests, so those that share initial turns stand together, and a task writes
them depth first: a turn that the conversation before has already is not written again. A
packed sequence holds a tree of turns: each has its place, its position id (the code points before it on
its own path) and the intervals of the sequence its code points attend to (its ancestors, with
neighbouring ones joined). With a tokenizer's file, the same stands in tokens beside them (``ids`` and the columns that
begin with ``token_``): a turn's marks and its text are encoded by themselves, so that turns that are shared have the same tokens and
the loss falls on whole ones. A sequence ends at ``most_chars``, and then begins anew from
the first turn, so no group of conversations is ever held whole. A conversation is a record and must
fit a task, as a document must.

Defined results: a null text or role is empty, and texts of any length are written whole; turns with equal numbers are in order of role and
text, null numbers first, and turns that repeat stay; a row with a null conv_id is a conversation of its own, so that no such rows
gather in one task; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MOST_CHARS, MOST_CONVERSATIONS = 262_144, 4096
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_INTS = pa.list_(pa.int64())
#: Of each turn, in code points and, after ``token_``, in tokens: where it is, how long, its position id, where its loss is and how long.
_PLACES = ("start", "length", "position", "loss_start", "loss_length")
SEQUENCE = pa.schema(
    [
        ("text", pa.string()),
        *((n, _INTS) for n in (*_PLACES, "parent", "conv_id", "leaf", "own", "ids", *(f"token_{n}" for n in _PLACES))),
        *((n, pa.list_(_INTS)) for n in ("attends", "token_attends")),
    ]
)
_DDL = ", ".join(f"{f.name} {'string' if f.name == 'text' else 'array<long>' if f.type == _INTS else 'array<array<long>>'}" for f in SEQUENCE)
_ENCODERS: dict[str, Tokenizer] = {}


def escape(text: str) -> str:
    return re.sub(r"([<\[\\])", r"\1\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text is."""
    head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
    return f"{head}{body}</s>", len(head), len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a turn at {at}")
    return turns


def encoder(path: str) -> Tokenizer:
    """This worker's tokenizer of a file; control strings of its own in a text are ordinary text."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _ENCODERS[path] = Tokenizer.from_file(path)
        _ENCODERS[path].encode_special_tokens = True
    return _ENCODERS[path]


class Sequence:
    """A packed sequence that grows by conversations; ``path``: of a tokenizer's file, for places in tokens too."""

    def __init__(self, path: str | None = None) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.cols: dict[str, list] = {n: [] for n in SEQUENCE.names if n != "text"}
        self.path: list[tuple[str, str]] = []
        self.nodes: list[int] = []
        self.tokenizer = encoder(path) if path else None

    def shared(self, turns: list[tuple[str, str]]) -> int:
        """Initial turns that the last conversation has too."""
        n = 0
        while n < min(len(turns), len(self.path)) and turns[n] == self.path[n]:
            n += 1
        return n

    def _place(self, unit: str, at: int, length: int, loss: tuple[int, int]) -> None:
        """The next turn's place, position and intervals, in code points (``unit`` empty) or in tokens."""
        c, parent = self.cols, self.nodes[-1] if self.nodes else -1
        attends: list[int] = []
        position = 0
        if parent >= 0:
            a = c[f"{unit}start"][parent]
            b = a + c[f"{unit}length"][parent]
            above = c[f"{unit}attends"][parent]
            attends = [*above[:-1], b] if above and above[-1] == a else [*above, a, b]
            position = c[f"{unit}position"][parent] + c[f"{unit}length"][parent]
        for name, x in zip((*_PLACES, "attends"), (at, length, position, *loss, attends), strict=True):
            c[unit + name].append(x)

    def add(self, conv: int | None, turns: list[tuple[str, str]], written: list[tuple[str, int, int]], shared: int) -> None:
        c, before = self.cols, self.size
        self.path, self.nodes = list(turns), self.nodes[:shared]
        for (role, _), (text, head, body) in zip(turns[shared:], written[shared:], strict=True):
            learned, at = role == "assistant", len(c["ids"])
            self._place("", self.size, len(text), (self.size + head, body) if learned else (-1, 0))
            if self.tokenizer is not None:
                pieces = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (text[:head], text[head : head + body], text[head + body :])]
                n = [len(p) for p in pieces]
                self._place("token_", at, sum(n), (at + n[0], n[1]) if learned else (-1, 0))
                c["ids"] += [i for p in pieces for i in p]
            c["parent"].append(self.nodes[-1] if self.nodes else -1)
            self.nodes.append(len(c["parent"]) - 1)
            self.parts.append(text)
            self.size += len(text)
        c["conv_id"].append(conv)
        c["leaf"].append(self.nodes[-1] if self.nodes else -1)
        c["own"].append(self.size - before)

    def batch(self) -> pa.RecordBatch:
        cols = {"text": "".join(self.parts)} | self.cols
        return pa.record_batch([pa.array([cols[f.name]], f.type) for f in SEQUENCE], schema=SEQUENCE)


def conversations_sorted(rows: DataFrame) -> DataFrame:
    """conv_id, turns, key: one row per conversation; those that share initial turns share the key's start."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.col("conv_id").cast("long").alias("conv_id")
    convs = rows.where("conv_id is not null").groupBy(own).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.unionByName(rows.where("conv_id is null").select(own, F.array(turn).alias("turns")))
    digest = lambda t: F.substring(F.sha2(F.concat(t["role"], F.lit("\n"), t["text"]), 256), 1, 12)
    return convs.withColumn("key", F.array_join(F.transform("turns", digest), ""))


def format_chats(rows: DataFrame, most_chars: int = MOST_CHARS, path: str | None = None) -> DataFrame:
    """Packed sequences (columns: ``SEQUENCE``) of conversation turns (conv_id, turn, role, text).

    ``path``: a tokenizer's file; without one the columns in tokens are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = Sequence(path)
        for batch in batches:
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                turns = [(t["role"], t["text"]) for t in raw.as_py()]
                written = [render(*t) for t in turns]
                n = seq.shared(turns)
                if seq.cols["conv_id"] and (len(seq.cols["conv_id"]) >= MOST_CONVERSATIONS or seq.size + sum(len(w[0]) for w in written[n:]) > most_chars):
                    yield seq.batch()
                    seq, n = Sequence(path), 0
                seq.add(conv, turns, written, n)
        if seq.cols["conv_id"]:
            yield seq.batch()

    convs = stage(conversations_sorted(rows), "conversations")
    dealt = convs.repartitionByRange(partitions(rows), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return dealt.select("conv_id", "turns").mapInArrow(run, _DDL)


def read_chats(sequences: DataFrame) -> DataFrame:
    """Each conversation read back from the sequences: by its leaf, ancestor intervals and loss spans."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "own_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                out: list[tuple] = []
                for conv, leaf, own in zip(s["conv_id"], s["leaf"], s["own"], strict=True):
                    spans = [*s["attends"][leaf], s["start"][leaf], s["start"][leaf] + s["length"][leaf]]
                    text = "".join(s["text"][a:b] for a, b in zip(spans[::2], spans[1::2], strict=True))
                    turns, path, at = parse(text), [], leaf
                    while at >= 0:
                        path.append(at)
                        at = s["parent"][at]
                    told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                    loss = "".join(unescape(s["text"][s["loss_start"][i] : s["loss_start"][i] + s["loss_length"][i]]) for i in reversed(path) if s["loss_start"][i] >= 0)
                    out.append((conv, len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), own))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return sequences.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, own_chars long")
