"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are mapped to Latin-1 so that the automaton sees strings. All
vocabulary matches of a piece are found in one pass; the encoder then takes
the longest match at each place and backtracks to shorter ones where two
adjacent tokens could not stand side by side after merging. A piece has just
one sequence of pairwise compatible tokens, which is what the merges give,
and a place that failed once is never tried again, so the work is linear.
Compatibility of a pair is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces up to this many characters are remembered; the memory holds so many pieces or pairs.
CACHED_CHARS, CACHED = 48, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are the ids, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes ``token``; None if merging its bytes doesn't lead there."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            return None
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    if len(parts) < 2 or parts[0] not in ranks or parts[1] not in ranks:
        return None
    return ranks[parts[0]], ranks[parts[1]]


class Pieces(dict):
    """Ids of a piece as bytes, worked out when first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_bytes(piece.encode("utf-8", "surrogatepass"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in ranks.items():
            self.tokens[rank] = token
            if len(token) > 1:
                halves = last_merge(token, ranks)
                if halves is None:
                    continue  # only whole pieces give such a token
                self.left[rank], self.right[rank] = halves
                self.pairs[halves] = rank
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.pieces = Pieces(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens leaves the border between them.

        Undoes merges on both sides of the border, latest first. A pair at the
        border that merges before the merge just undone would have joined
        first; of equal merges the one further left comes first.
        """
        key = a * len(self.tokens) + b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = self.known[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        left, right, ranks, tokens = self.left, self.right, self.ranks, self.tokens
        before = 1 << 60
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < before:
                return False
            made_a = a if right[a] >= 0 else -1
            made_b = b if left[b] >= 0 else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - size + 1].append(rank)  # shorter ones first, as ends only grow
        tokens, open_at = self.tokens, bytearray(b"\1") * (n + 1)
        out: list[int] = []
        tried: list[int] = []
        at, k = 0, len(starting[0]) - 1 if n else -1
        while at < n:
            here = starting[at]
            while k >= 0:
                token = here[k]
                end = at + len(tokens[token])
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                at = end
                k = len(starting[at]) - 1 if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                open_at[at] = 0
                at -= len(tokens[out.pop()])
                k = tried.pop() - 1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker and vocabulary."""
    return Codec(load_ranks(path), pattern)


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text; path names the ranks, a file on every worker.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, one row for each
    row of ``docs``. A null text is empty: no tokens, and the hashes of
    nothing. Repeated rows each get their row; equal texts have equal ids.
    Other columns are not looked at. An empty table gives an empty result.
    Nothing is shuffled, and a worker holds one text's ids at a time, however
    long it is.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest())
                rows[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(rows, list(out)[1:], strict=True))], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
