"""Encoding of a corpus with a public byte-level BPE tokenizer by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can lie inside no token of any encoding, so a
text may be cut between its two bytes.  The table of such pairs is computed from the vocabulary.
A cut is used where the tokenizer's own pattern is certain to start anew as well: between a
character that isn't white space and ASCII white space (no alternative of the pattern continues
past it, and none looks back), or between two letters.  Fragments are encoded independently, each
distinct one once a worker while its memo lasts, and the ids are concatenated.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import spread

TOKENIZER_DIR = "/opt/tokenizers"  #: default; the vocabulary stays where it is
VOCABULARY = "byte_bpe_50k.tiktoken"
LONG_WORD = 4096  #: a run without white space beyond this many characters is cut between letters too
MEMO = 200_000  #: fragments a worker remembers

# Fixed value: the pre-tokenizer pattern of the public byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: True where the byte pair occurs inside no token."""
    free = np.ones((256, 256), dtype=bool)
    for t in tokens:
        if len(t) > 1:
            b = np.frombuffer(t, dtype=np.uint8)
            free[b[:-1], b[1:]] = False
    return free


class ForcedEncoder:
    """Encoder of one worker; ``path`` names the rank file."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.free = forced_pairs(list(ranks))
        spaces = " \t\n\r\x0b\x0c"
        # bytes that end a character before a certain cut: the pair must be free with every such blank
        ends = {b for b in range(256) if all(self.free[b, ord(s)] for s in spaces)}
        # of a longer character the last byte is 128 + (code point mod 64)
        self.wide = frozenset(b for b in ends if 128 <= b < 192)
        self.ascii_ends = frozenset(chr(b) for b in ends if b < 128 and not chr(b).isspace())
        self.piece = regex.compile(rf"[{spaces}]*[^{spaces}]*")
        self.letter = regex.compile(r"\p{L}")
        self.memo: dict[str, list[int]] = {}

    def certain_end(self, ch: str) -> bool:
        """A cut between this character and following ASCII white space is certain."""
        if ord(ch) < 128:
            return ch in self.ascii_ends
        return not ch.isspace() and (0x80 | (ord(ch) & 0x3F)) in self.wide

    def fragments(self, text: str) -> Iterator[str]:
        held = ""
        for piece in self.piece.findall(text):
            if not piece:
                continue
            held = held + piece if held else piece
            if self.certain_end(held[-1]):
                yield from self._long(held) if len(held) > LONG_WORD else (held,)
                held = ""
        if held:
            yield from self._long(held) if len(held) > LONG_WORD else (held,)

    def _long(self, run: str) -> Iterator[str]:
        """Cuts a long run between letters whose adjoining bytes form a free pair."""
        start, at = 0, LONG_WORD
        while at < len(run):
            a, b = run[at - 1], run[at]
            if self.letter.match(a) and self.letter.match(b) and self.free[a.encode()[-1], b.encode()[0]]:
                yield run[start:at]
                start, at = at, at + LONG_WORD
            else:
                at += 1
        yield run[start:]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty give an empty list."""
        if not text:
            return []
        ids: list[int] = []
        memo = self.memo
        for fragment in self.fragments(text):
            known = memo.get(fragment)
            if known is None:
                known = self.encoding.encode_ordinary(fragment)
                if len(fragment) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[fragment] = known
            ids += known
        return ids


def encoder(path: str) -> ForcedEncoder:
    """The worker's encoder for ``path``; kept on the tokenizer's module, which outlives a task."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_forced_encoders", {})
    if path not in kept:
        kept[path] = ForcedEncoder(path)
    return kept[path]


def encode(df: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids array<int>``: one row for each input row, no shuffle.

    Null and empty texts give an empty list, blank texts their real ids; strings that look like
    special tokens are ordinary text; other columns of ``df`` are not read.
    """
    path = os.path.join(tokenizer_dir, vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # small batches: a batch of long texts stays small
                part = batch.slice(at, 1000)
                lists = [np.asarray(enc.encode(t), dtype=np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
