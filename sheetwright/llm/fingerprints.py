"""Document fingerprints from prefix polynomial hashes.

A text's modular prefix array gives the hash of any span by one subtraction
and one product, so spans of two texts are compared in constant time and
their longest common extension is found by binary search. A fingerprint is
the hash of the whole text under two moduli, its length, and values of the
prefix array at two kinds of places: at even steps, where binary search finds
the common opening of two texts, and at cuts that the text around them
chooses, so that spans between cuts are equal wherever a passage stands.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: Primes below 2**31, so that products fit 64 bits, and the bases.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)
#: Code points that choose a cut; zero bits that their hash ends in at least: spans are 16 code points long or more on average.
WINDOW, ZEROS = 8, 4
#: Cuts and even steps in a fingerprint at most; longer texts have cuts further apart.
CUTS, STEPS = 48, 32
#: Chunks of neighbouring ids for each shuffle partition.
CHUNKS = 3


class Powers:
    """Powers of a base and of its inverse under a modulus, grown when needed."""

    def __init__(self, base: int, modulus: int):
        self.modulus = modulus
        self.base, self.inverse = base, pow(base, -1, modulus)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grown(have: np.ndarray, base: int, modulus: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), modulus)) % np.uint64(modulus)])
        return have

    def need(self, n: int) -> None:
        self.up = self._grown(self.up, self.base, self.modulus, n)
        self.down = self._grown(self.down, self.inverse, self.modulus, n)


POWERS = [Powers(b, m) for b, m in zip(BASES, MODULI, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix array of a sequence of code points under one modulus."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        self.n, self.powers = len(codes), POWERS[which]
        p = self.powers
        p.need(self.n + 1)
        terms = (codes.astype(np.uint64) + np.uint64(1)) * p.up[: self.n] % np.uint64(p.modulus)
        self.at = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.at[1:])
        self.at %= np.uint64(p.modulus)

    def span(self, start: int, stop: int) -> int:
        """Hash of a span; equal spans have equal hashes wherever they stand."""
        m = self.powers.modulus
        return (int(self.at[stop]) - int(self.at[start])) % m * int(self.powers.down[start]) % m

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size`` code points."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        m = np.uint64(self.powers.modulus)
        return (self.at[size:] + m - self.at[:-size]) % m * self.powers.down[: self.n - size + 1] % m


def spans_equal(a: tuple[PrefixHash, ...], i: int, b: tuple[PrefixHash, ...], j: int, size: int) -> bool:
    """Whether two spans are equal under every modulus."""
    return all(x.span(i, i + size) == y.span(j, j + size) for x, y in zip(a, b, strict=True))


def common_extension(a: tuple[PrefixHash, ...], i: int, b: tuple[PrefixHash, ...], j: int) -> int:
    """Length of the longest equal spans that start at i and j."""
    low, high = 0, min(a[0].n - i, b[0].n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def cut_places(prefix: PrefixHash) -> tuple[int, np.ndarray, np.ndarray]:
    """(level, place, zeros): where the text is cut, at most CUTS places, each with ``level`` zero bits at least.

    A cut stands where the hash of the next WINDOW code points ends in enough
    zero bits: in as many as it takes to have few enough cuts. Equal windows
    in a row make one cut, so runs of one character make no crowd of them.
    """
    mixed = prefix.windows(WINDOW) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed >>= np.uint64(30)
    found = (mixed & np.uint64((1 << ZEROS) - 1)) == 0
    found[1:] &= mixed[1:] != mixed[:-1]
    found[:1] = False
    place = np.flatnonzero(found)
    low = mixed[place]
    zeros = np.full(len(place), 34, np.int64)
    some = low != 0
    zeros[some] = np.log2((low[some] & (~low[some] + np.uint64(1))).astype(np.float64)).astype(np.int64)
    level = ZEROS
    while len(place) > CUTS:
        level += 1
        place, zeros = place[zeros >= level], zeros[zeros >= level]
    return level, place, zeros


def step_of(n: int) -> int:
    """The least power of two that has at most STEPS multiples in ``n``."""
    step = 1
    while n // step > STEPS:
        step *= 2
    return step


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def prefixes(text: str) -> tuple[PrefixHash, PrefixHash]:
    """The prefix arrays of a text under both moduli."""
    codes = code_points(text)
    return PrefixHash(codes, 0), PrefixHash(codes, 1)


def printed(both: tuple[PrefixHash, PrefixHash]) -> str:
    """The fingerprint of a text, from its prefix arrays.

    Fields with points between: the hashes of the whole text in 16 hex
    digits, its length, the zero bits that its cuts have at least, the hashes
    of its openings at even steps, and its cuts, each as zero bits (one
    digit), hash of the opening, and place.
    """
    first, second = both
    level, place, zeros = cut_places(first)
    step = step_of(first.n)
    even = first.at[step::step].astype(">u4").tobytes().hex()
    cuts = ",".join(f"{_DIGITS[z]}{h:08x}{p:x}" for z, h, p in zip(zeros.tolist(), first.at[place].tolist(), place.tolist(), strict=True))
    return f"{int(first.at[-1]):08x}{int(second.at[-1]):08x}.{first.n}.{_DIGITS[level]}.{even}.{cuts}"


def fingerprint(text: str) -> str:
    """The fingerprint of a text; equal texts have equal ones."""
    return printed(prefixes(text))


class Print:
    """A fingerprint, read back."""

    def __init__(self, text: str):
        whole, n, level, even, cuts = text.split(".")
        self.n, self.level, self.whole = int(n), _DIGITS.index(level), int(whole[:8], 16)
        self.step = step_of(self.n)
        self.even = np.frombuffer(bytes.fromhex(even), ">u4")
        parts = cuts.split(",") if cuts else []
        self.zeros = np.array([_DIGITS.index(c[0]) for c in parts], np.int64)
        self.hashes = np.array([int(c[1:9], 16) for c in parts], np.uint64)
        self.places = np.array([int(c[9:], 16) for c in parts], np.int64)

    def opening(self, n: int) -> int:
        """Hash of the first ``n`` code points; n is a multiple of the step."""
        return int(self.even[n // self.step - 1])

    def spans(self, level: int) -> dict[tuple[int, int], int]:
        """How often each (hash, length) occurs among the spans between cuts of at least ``level`` zero bits."""
        mine = self.zeros >= level
        place = np.concatenate([[0], self.places[mine], [self.n]])
        at = np.concatenate([np.zeros(1, np.uint64), self.hashes[mine], np.array([self.whole], np.uint64)])
        p, m = POWERS[0], np.uint64(MODULI[0])
        p.need(self.n + 1)
        values = (at[1:] + m - at[:-1]) % m * p.down[place[:-1]] % m
        out: dict[tuple[int, int], int] = {}
        for key in zip(values.tolist(), np.diff(place).tolist(), strict=True):
            out[key] = out.get(key, 0) + 1
        return out


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints from 0 to 1; 1 for equal ones.

    Twice the code points that both texts hold, over the code points of both.
    What both hold is the larger of two findings: the spans between cuts that
    are equal by their hashes, at the level of the text that is cut more
    coarsely; and the common opening, found by binary search over even steps.
    Only spans of 16 code points and more (on average) are found, so the
    likeness of short texts that differ throughout is 0.
    """
    if a == b:
        return 1.0
    x, y = Print(a), Print(b)
    level, step = max(x.level, y.level), max(x.step, y.step)
    mine, other = x.spans(level), y.spans(level)
    shared = sum(min(k, other[key]) * key[1] for key, k in mine.items() if key in other)
    low, high = 0, min(x.n, y.n) // step
    while low < high:
        middle = (low + high + 1) // 2
        if x.opening(middle * step) == y.opening(middle * step):
            low = middle
        else:
            high = middle - 1
    return min(1.0, 2 * max(shared, low * step) / (x.n + y.n))


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as many code points of ``other``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_chars long"


def _rank(x: Column, cuts: list[int]) -> Column:
    """How many of ``cuts``, in ascending order, are at most ``x``: a search in two steps."""
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads, rest = F.lit([g[0] for g in groups]), F.array(*[F.lit(g) for g in groups])
    before = F.size(F.filter(heads, lambda c: c <= x))
    inside = F.size(F.filter(F.get(rest, before - 1), lambda c: c <= x))
    return F.when(before == 0, F.lit(0)).otherwise((before - 1) * F.lit(width) + inside)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows in chunks of neighbouring ids: chunk, look, doc_id, h, text.

    Quantiles of doc_id, as whole numbers, cut the rows into chunks, some for
    each shuffle partition, highest ids first, null ids last. Each chunk also
    gets the first row of the next one (look = 1), the last chunk that of the
    first one. The driver holds one id a chunk, never more.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    n = CHUNKS * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = d.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n)
    cuts = sorted({min(int(x), (1 << 63) - 1) for x in found})
    chunk = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _rank(F.col("doc_id"), cuts)).cast("int")
    d = d.withColumn("chunk", chunk)
    heads = d.groupBy("chunk").agg(F.max(F.struct("doc_id", "h")).alias("m")).select("chunk", "m.doc_id", "m.h").collect()
    heads = sorted(heads, key=lambda r: r.chunk)
    wanted = [(heads[(i + 1) % len(heads)].doc_id, heads[(i + 1) % len(heads)].h, r.chunk) for i, r in enumerate(heads)]
    wanted = spark.createDataFrame(wanted, "_id long, _h long, also int")
    d = d.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("look"))
    places = F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("also").alias("chunk"), F.lit(1).alias("look"))))
    return (
        d.select(F.explode(places).alias("c"), "doc_id", "h", "text").select("c.chunk", "c.look", "doc_id", "h", "text")
        .repartition("chunk")
        .sortWithinPartitions("chunk", "look", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The next document is the one with the next smaller doc_id (null last, equal ones by
    a hash of the text), after the last the first; of a single row it is the
    row itself. kept_chars is the longest common extension of the text and
    its edited text from their first code points on. A null text is empty.
    Repeated rows each get their row, each the next one of the other. Very
    long texts are taken whole; columns of other names are not looked at. An
    empty table gives an empty result. Rows are streamed in order, two texts
    at a time; texts are shuffled once.
    """
    if docs.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        waiting, chunk = None, None
        for batch in batches:
            rows = []
            for c, look, doc_id, _, text in zip(*batch.columns, strict=True):
                c, look, doc_id, text = c.as_py(), look.as_py(), doc_id.as_py(), text.as_py()
                if c != chunk:
                    if waiting is not None:
                        raise ValueError(f"chunk {chunk} ends without the row after it")
                    chunk = c
                if look and waiting is None:
                    continue
                both = prefixes(text)
                now = (doc_id, text, both, printed(both))
                if waiting is not None:
                    before, old, old_both, old_print = waiting
                    new = edited(old, text)
                    new_both = prefixes(new)
                    new_print = printed(new_both)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((before, len(old), sha, old_print, new_print, likeness(old_print, new_print), likeness(old_print, now[3]), common_extension(old_both, 0, new_both, 0)))
                waiting = None if look else now
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        if waiting is not None:
            raise ValueError(f"chunk {chunk} ends without the row after it")
        release()

    return _neighbours(docs).mapInArrow(run, SCHEMA)
