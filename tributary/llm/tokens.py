"""Encoding of a corpus with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that the encoding of this prefix ends with.  A token t
that ends at byte i is this token if t and the last token of the prefix before t are a valid pair: encoding their
joined bytes gives these two again.  The table of last tokens is all that has to be kept: following it backward gives the
encoding, bytes appended only add entries, and after an edit only entries from the edit on are made anew.  Texts
are first cut into pieces by the tokenizer's pattern, since no token crosses a piece; a bounded cache keeps the ids of pieces.

An empty or null text has no ids: an empty list.  Special tokens are ordinary text.  A text of any length is
encoded whole.  Texts that aren't valid Unicode don't occur in a string column.  Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank file; a parameter everywhere.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts texts into pieces for this vocabulary (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps, and bytes a kept piece has at most.
CACHE_PIECES, CACHE_BYTES = 400_000, 64
#: Pairs of tokens a worker keeps the validity of.
CACHE_PAIRS = 1_000_000


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str = BYTE_BPE_50K, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            joined, out, i = parts[at] + parts[at + 1], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == joined and self.ranks.get(joined) == best:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        got = self.pieces.get(piece)
        if got is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            got = (whole,) if whole is not None else tuple(Prefixes(self, data).ids())
            if len(data) <= CACHE_BYTES:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, new = self.pieces.get, self.encode_piece
        return list(chain.from_iterable([known(p) or new(p) for p in self.find(text)]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode()


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; entries of earlier prefixes stay as they are."""
        self.data += data
        self._fill()

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace the bytes from start to end; only entries after start are made anew."""
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start + 1:]
        self._fill()

    def _fill(self) -> None:
        data, last, ranks, valid, longest = self.data, self.last, self.v.ranks, self.v.valid, self.v.longest
        for i in range(len(last), len(data) + 1):
            for j in range(max(0, i - longest), i):  # longer tokens first
                t = ranks.get(data[j:i])
                if t is not None and (j == 0 or valid(last[j], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            t = self.last[i]
            out.append(t)
            i -= len(self.v.bytes[t])
        return out[::-1]


class Document:
    """The encoding of a text that grows or is edited, re-encoded near the change only."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.v, self.text = vocabulary, text
        self.pieces = [(p, vocabulary.encode_piece(p)) for p in vocabulary.find(text)]

    def ids(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace characters; pieces well before and after the change keep their ids.

        Where a piece ends depends on the characters in it and on whether white space follows, so the pieces before the
        last two that end before the change stay; behind it, old pieces return once a new cut falls on an old one in
        what the edit left alone, past a piece that isn't white space.
        """
        new = self.text[:start] + text + self.text[end:]
        kept, at = 0, 0
        for p, _ in self.pieces:
            if at + len(p) > start:
                break
            kept, at = kept + 1, at + len(p)
        back = self.pieces[max(0, kept - 2):kept]
        kept, at = max(0, kept - 2), at - sum(len(p) for p, _ in back)
        shift, old, cuts = len(new) - len(self.text), 0, {}
        for n, (p, _) in enumerate(self.pieces):
            cuts[old] = n
            old += len(p)
        out = self.pieces[:kept]
        for m in self.v_finditer(new, at):
            if m.start() > start + len(text) and m.start() - shift in cuts and not new[m.start() - 1].isspace():
                out += self.pieces[cuts[m.start() - shift]:]
                break
            out.append((m.group(), self.v.encode_piece(m.group())))
        self.text, self.pieces = new, out

    def v_finditer(self, text: str, at: int) -> Iterator[regex.Match]:
        return self.v.find.__self__.finditer(text, at)


@lru_cache(maxsize=4)
def vocabulary(path: str = BYTE_BPE_50K, pattern: str = PATTERN) -> Vocabulary:
    """One vocabulary a worker process."""
    return Vocabulary(path, pattern)


def _ship(docs: DataFrame, path: str) -> str:
    """Give the rank file to all executors, and its name there; workers don't need the driver's folders."""
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = BYTE_BPE_50K, pattern: str = PATTERN) -> DataFrame:
    """(id, ids): the list of ids of each text."""

    name = _ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(name), pattern)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = [v.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    src = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return src.mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_column)


def count(docs: DataFrame, columns: list[str], text_column: str = "text", path: str = BYTE_BPE_50K, pattern: str = PATTERN) -> DataFrame:
    """The columns and n_tokens, the number of ids of each text."""

    name = _ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(v.encode(t)) for t in b.column("text__").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(n, pa.int64())], [*columns, "n_tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col(text_column).alias("text__")).mapInArrow(run, f"{fields}, n_tokens bigint")
