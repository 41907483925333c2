"""Token ids of whole texts by a public byte-level BPE vocabulary, with a bounded memory of word pieces.

The vocabulary's pattern never lets a token cross a point where a space stands before a character that isn't white
space, so a text is cut there and each piece is encoded once for as long as it is remembered."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from struct import pack

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces that are remembered, the first that are seen, and the longest of them; others are encoded each time.
PIECES, PIECE_CHARS = 120_000, 48
_CUT, _ODD = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit numbers, equal to those of tokenizers for the JSON file."""

    def __init__(self, vocabulary: str, ranks: str | None) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.vocabulary = vocabulary
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.marks = {m: self._plain(m) for m in ".,;:!?"}

    @cached_property
    def whole(self):
        """The tokenizer itself, for texts that its special tokens may cut; loaded when the first is met."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def _plain(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _piece(self, p: str) -> bytes:
        """The ids of a space and a piece. Letters alone are one run of the pattern, with a mark behind them two."""
        if p.isalpha():
            return self._run(p)
        if p[-1:] in self.marks and p[:-1].isalpha():
            stem = self.spaced.get(p[:-1])
            return (self._run(p[:-1]) if stem is None else stem) + self.marks[p[-1]]
        return self._plain(" " + p)

    def _run(self, letters: str) -> bytes:
        ids = self.fast._core_bpe.encode_single_piece((" " + letters).encode())
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        known = self.spaced
        out = [known.get(p) for p in parts]
        out[0] = self.bare.get(parts[0])
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    p = parts[i]
                    out[i] = got = self._piece(p) if i else self._plain(p)
                    to = self.spaced if i else self.bare
                    if len(to) < PIECES and len(p) <= PIECE_CHARS:
                        to[p] = got
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str | None = None) -> Encoder:
    """One for each worker process."""
    return Encoder(vocabulary, ranks)


def default_paths() -> tuple[str, str]:
    return vocabulary_path(VOCABULARY), vocabulary_path(RANKS)


def texts(column) -> Iterator[str | None]:
    """The strings of an Arrow column, one at a time."""
    for x in column:
        yield x.as_py()
