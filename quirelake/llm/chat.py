r"""Chat formatting with a grammar that reads back.

    conversation := turn*        turn := "### " role "\n" (line "\n")+ "</turn>\n"

A text is cut at line feeds only. A line of a text that starts with any number of backslashes and then "### " or "</turn>"
gets one more backslash; the parser takes one off. Each turn is first rendered as it is, parsed, and compared with its
source; while they differ, its conflicting lines are escaped. In a role, backslash and line feed are written \\ and \n.

Defined results for odd input: a null text or role is empty; turns stand by turn, then role, then text, nulls first; rows
that repeat are turns each; a null conv_id is a conversation of its own; further columns are ignored; an empty table gives
no rows. A conversation is never held as a whole: it is read turn by turn from a sorted partition."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean

HEAD, END = "### ", "</turn>"
_CONFLICT = re.compile(r"^(\\*(?:### |</turn>))", re.M)
_ESCAPED = re.compile(r"^\\(\\*(?:### |</turn>))", re.M)
# re.M sees a line start after \n only, as the grammar does


def escape(text: str) -> str:
    return _CONFLICT.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role_out(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


class Parser:
    """Reads formatted text as it comes and gives the turns that are complete. Raises ValueError where it doesn't follow the grammar."""

    def __init__(self) -> None:
        self.rest = ""
        self.role: str | None = None
        self.lines: list[str] = []

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        *lines, self.rest = (self.rest + text).split("\n")
        for line in lines:
            if self.role is None:
                if not line.startswith(HEAD):
                    raise ValueError("a turn must start here")
                self.role = _role_in(line[len(HEAD) :])
            elif line == END:
                if not self.lines:
                    raise ValueError("a turn has a line at least")
                yield self.role, unescape("\n".join(self.lines))
                self.role, self.lines = None, []
            elif line.startswith((HEAD, END)):
                raise ValueError("a control string inside a text")
            else:
                self.lines.append(line)

    def close(self) -> None:
        if self.rest or self.role is not None:
            raise ValueError("a turn isn't complete")


def parse(text: str) -> list[tuple[str, str]]:
    p = Parser()
    out = list(p.feed(text))
    p.close()
    return out


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered turn, and from where to where its text stands in it."""
    role, text = role or "", text or ""
    head, body = HEAD + _role_out(role) + "\n", text
    while True:
        out = f"{head}{body}\n{END}\n"
        try:
            if parse(out) == [(role, text)]:
                return out, len(head), len(head) + len(body)
        except ValueError:
            pass
        if body == (body := escape(text)):
            raise ValueError("the turn doesn't read back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, role, text, rendered, and the loss mask in it (loss_from, loss_to; empty if it isn't
    the assistant's). The conversation's formatted text is its rendered turns, one after the other."""
    names = ["conv_id", "turn", "role", "text", "rendered", "loss_from", "loss_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            got = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            mask = [(x, y) if r == "assistant" else (0, 0) for r, (_, x, y) in zip(roles, got, strict=True)]
            yield pa.record_batch([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([m[0] for m in mask], pa.int64()), pa.array([m[1] for m in mask], pa.int64())], names)

    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), "conv_id long, turn long, role string, text string, rendered string, loss_from long, loss_to long")


def read_back(turns: DataFrame) -> DataFrame:
    """A row for each conversation from its rendered turns: counts and digests of what the parser and the loss mask give."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    class Sums:
        def __init__(self) -> None:
            self.parser, self.n, self.turns, self.loss, self.loss_chars, self.chars = Parser(), 0, hashlib.sha256(), hashlib.sha256(), 0, 0

        def add(self, rendered: str, a: int, b: int) -> None:
            for role, text in self.parser.feed(rendered):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())
            masked = unescape(rendered[a:b])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
            self.chars += len(rendered)

        def row(self) -> tuple:
            self.parser.close()
            return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at, out = None, None, []
        for b in batches:
            for conv, rendered, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sums is None or conv != at:
                    if sums is not None:
                        out.append((at, *sums.row()))
                    sums, at = Sums(), conv
                sums.add(rendered, x, y)
            if len(out) > 5000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if sums is not None:
            out.append((at, *sums.row()))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "rendered", "loss_from", "loss_to").mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
