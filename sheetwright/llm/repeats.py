"""Exact removal of byte strings that repeat across documents.

Depth-limited radix sort of suffixes: suffixes are ordered only through
``LENGTH`` bytes, most significant digit first, and groups that are equal so
far go on to the next digit, so the groups that remain are exactly the
repeated windows. Three digits are used.

1. The first digit is a 20-byte anchor. Of the anchors within a window the
   one with the least hash stands for it, so equal windows have equal
   anchors, and neighbouring windows share one. Ranges of anchor hashes,
   hashed once more as the least ones crowd together, are the buckets of the
   first pass, dealt out over the cluster. Within a bucket 32 bits tell
   anchors apart: two that agree by chance only send more windows to pass 3.
2. The second digit is the whole text around an anchor that its windows
   cover, by 64 bits of its hash beside the anchor's. Where it is equal, all
   windows are. Most repeats end here.
3. Anchors with several texts around go on to a pass over single windows,
   one document for each text.

Shards are ranges of doc_id, so an earlier shard's documents are smaller, and
keys need no doc_id. Each shard sends a key once, however often it occurs
there, so a string that a third of all rows holds makes one key a shard. An
anchor with many surroundings within a shard is hot: the shard sends one mark
in place of its keys, and every shard sends that anchor's windows to pass 3,
whose buckets are even whatever the anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

LENGTH, ANCHOR = 50, 20
#: Bytes of text in a shard, for each bucket, and for each partition of a shuffle, about.
SHARD_BYTES, BUCKET_BYTES, PART_BYTES = 1 << 20, 4 << 20, 12 << 20
#: Shards grow with the text beyond so many of them, by this factor at most, so that what all shards send of one string stays small.
SHARDS, SHARD_GROWTH = 50_000, 16
#: Surroundings of an anchor within a shard from which it is hot; what is sent in place of them.
HOT, MARK = 32, np.uint64(0)
#: Quantiles of doc_id that shards are laid out by; between two of them ids are taken to be even.
KNOTS = 1000
#: Windows looked at together; places take so many bits beside the hash.
SEGMENT, PLACE_BITS = 1 << 18, 21
#: A null doc_id is the greatest.
LAST = (1 << 63) - 1

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        have = _POWERS[name]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[name] = have
    return _POWERS["up"][:n], _POWERS["down"][:n]


def tidy(table: pa.Table) -> pa.Table:
    """The table, after memory that its group no longer needs is handed back."""
    release()
    return table


class Segment:
    """Prefix hashes of a stretch of bytes; arithmetic is modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.at = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.at[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.at[stop] - self.at[start]) * self.down[start]


class Shard:
    """The documents of a shard, in order of doc_id, and the keys of their windows.

    For each anchor in turn: doc (index), lo and hi (first and last window),
    anchor and around (hashes). ``key`` gives each its place among the
    distinct keys, which have anchors, arounds and first (index of the least
    document). sent_anchors and sent_arounds are what the shard sends, and
    ``place`` says which of it stands for a key.
    """

    def __init__(self, table: pa.Table):
        ids = [LAST if x is None else x for x in table.column("doc_id").to_pylist()]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.real = [table.column("doc_id")[i].as_py() for i in order]
        self.ids = np.array([ids[i] for i in order], np.int64)
        texts = [table.column("data")[i].as_py() or b"" for i in order]
        self.ends = np.cumsum([len(x) for x in texts]) if texts else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([len(x) for x in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self._anchors()
        order = np.lexsort((self.around, self.anchor))
        a, b = self.anchor[order], self.around[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.key = np.empty(len(order), np.int64)
        self.key[order] = np.cumsum(new) - 1
        self.anchors, self.arounds = a[new], b[new]
        self.first = self.doc[order][new]  # the sort is stable, and documents come in order
        # of a hot anchor's keys the first stands for all
        start = np.flatnonzero(np.diff(self.anchors, prepend=self.anchors[:1] + np.uint64(1)) != 0) if len(self.anchors) else np.zeros(0, int)
        n = np.diff(np.append(start, len(self.anchors)))
        hot = np.repeat(n >= HOT, n)
        sent = ~hot
        sent[start] = True
        self.sent_anchors = self.anchors[sent]
        self.sent_arounds = np.where(hot, MARK, np.maximum(self.arounds, np.uint64(1)))[sent]
        self.place = np.cumsum(sent) - 1 if len(sent) else np.zeros(0, np.int64)

    def _anchors(self) -> None:
        found: list[list[np.ndarray]] = []
        n, width = len(self.data), LENGTH - ANCHOR + 1
        for s in range(0, max(0, n - LENGTH + 1), SEGMENT):
            data = self.data[s : s + SEGMENT + LENGTH - 1]
            seg = Segment(data)
            starts = np.arange(len(data) - ANCHOR + 1)
            hashes = mix(seg.spans(starts, starts + ANCHOR))
            least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | starts.astype(np.uint64)
            size = 1
            while size * 2 <= width:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < width:
                least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
            at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            p = np.arange(len(at))
            doc = np.searchsorted(self.ends, p + s, side="right")
            inside = p + s + LENGTH <= self.ends[doc]
            p, at, doc = p[inside], at[inside], doc[inside]
            if not len(p):
                continue
            new = np.ones(len(p), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            lo = p[new]
            hi = np.append(p[np.flatnonzero(new)[1:] - 1], p[-1])
            at = at[new]
            around = mix(seg.spans(lo, hi + LENGTH) + (at - lo).astype(np.uint64) * _M1 + (hi - lo).astype(np.uint64) * _M2)
            found.append([doc[new], lo + s, hi + s, mix(hashes[at] + _GOLD), around])
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (int, int, int, np.uint64, np.uint64)]
        self.doc, self.lo, self.hi, self.anchor, self.around = parts

    def windows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, place) of the windows of the first document with each of ``keys``: runs of anchors, and places in the text."""
        run = np.flatnonzero(np.isin(self.key, keys) & (self.ids[self.doc] == self.ids[self.first[self.key]]) if len(self.key) else np.zeros(0, bool))
        n = self.hi[run] - self.lo[run] + 1
        place = np.repeat(self.lo[run] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(run) else np.zeros(0, np.int64)
        return np.repeat(run, n), place.astype(np.int64)

    def window_hashes(self, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place), np.uint64)
        part = place // SEGMENT
        for k in np.unique(part):
            mine = part == k
            p = place[mine] - k * SEGMENT
            out[mine] = mix(Segment(self.data[k * SEGMENT : (k + 1) * SEGMENT + LENGTH - 1]).spans(p, p + LENGTH) + _GOLD)
        return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


SENT = "bucket long, shard long, keys binary, more binary"
BACK = "shard long, bucket long, flags binary"


def _rows(shard: int, hashes: np.ndarray, more: np.ndarray | None, buckets: int) -> pa.Table:
    """One row for each bucket that sorted ``hashes`` reach; beside ``more``, the bucket and the low 32 bits stand for a hash."""
    bucket = _bucket(hashes, buckets)
    if more is not None:
        hashes = hashes.astype(np.uint32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(bucket))
    return pa.table({
        "bucket": pa.array(bucket[cuts], pa.int64()),
        "shard": pa.array([shard] * len(cuts), pa.int64()),
        "keys": pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()),
        "more": pa.array([b"" if more is None else more[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()),
    })


def _gathered(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, more and shards of a bucket's rows, and how many keys each row has."""
    keys = [np.frombuffer(x.as_buffer(), kind) for x in table.column("keys")]
    more = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("more")]
    sizes = np.array([len(k) for k in keys])
    return np.concatenate(keys), np.concatenate(more), np.repeat(table.column("shard").to_numpy(), sizes), sizes


def _least(group: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """The least shard of each row's group; groups are numbered in order."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return np.minimum.reduceat(shards, starts)[group]


def _returned(table: pa.Table, flags: np.ndarray, sizes: np.ndarray) -> pa.Table:
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    return tidy(pa.table({"shard": table.column("shard").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "flags": pa.array([x.tobytes() for x in parts], pa.binary())}))


def compare_keys(table: pa.Table) -> pa.Table:
    """Flags of the keys of a bucket: 2 if the anchor is hot in any shard, else 1 if an earlier shard has the key, else 2 if the anchor has other texts around."""
    keys, more, shards, sizes = _gathered(table, np.uint32)
    order = np.lexsort((more, keys))
    k, m, d = keys[order], more[order], shards[order]
    other = k != np.concatenate([k[:1], k[:-1]])
    anchor = np.cumsum(other)
    text = np.cumsum(other | (m != np.concatenate([m[:1], m[:-1]])))
    least = _least(text, d)
    several = np.bincount(anchor[np.flatnonzero(np.diff(text, prepend=-1))])[anchor] > 1
    hot = np.bincount(anchor, m == MARK)[anchor] > 0
    flags = np.empty(len(order), np.uint8)
    flags[order] = np.where(hot, 2, np.where(least < d, 1, np.where(several, 2, 0)))
    return _returned(table, flags, sizes)


def compare_windows(table: pa.Table) -> pa.Table:
    """Flags of the windows of a bucket: 1 if an earlier shard has the window."""
    keys, _, shards, sizes = _gathered(table, np.uint64)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], shards[order]
    flags = np.empty(len(order), np.uint8)
    flags[order] = _least(np.cumsum(np.diff(k, prepend=k[:1]) != 0), d) < d
    return _returned(table, flags, sizes)


def _flags(table: pa.Table, n: int) -> np.ndarray:
    """The flags that came back, in order of buckets, as they were sent."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("flags").to_pylist(), strict=True))
    out = np.frombuffer(b"".join(x for _, x in rows), np.uint8)
    if len(out) != n:
        raise ValueError(f"{len(out)} flags came back for {n} keys")
    return out


def _distinct_windows(s: Shard, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, place, which, hashes, docs): windows of the keys with flag 2, and the distinct ones in order with the shard's least document."""
    run, place = s.windows(np.flatnonzero(flags == 2))
    hashes = s.window_hashes(place)
    distinct, which = np.unique(hashes, return_inverse=True)
    docs = np.full(len(distinct), LAST, np.int64)
    np.minimum.at(docs, which, s.ids[s.doc[run]] if len(run) else np.zeros(0, np.int64))
    return run, place, which, distinct, docs


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_bytes(s: Shard, flags: np.ndarray, window_flags: np.ndarray | None) -> np.ndarray:
    """Which bytes of a shard go."""
    edge = np.zeros(len(s.data) + 1, np.int64)
    whole = (flags[s.key] == 1) | (s.ids[s.doc] > s.ids[s.first[s.key]]) if len(s.key) else np.zeros(0, bool)
    np.add.at(edge, s.lo[whole], 1)
    np.add.at(edge, s.hi[whole] + LENGTH, -1)
    run, place, which, _, docs = _distinct_windows(s, flags)
    if len(place):
        gone = (window_flags[which] == 1) | (s.ids[s.doc[run]] > docs[which])
        np.add.at(edge, place[gone], 1)
        np.add.at(edge, place[gone] + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def repeat_report(docs: DataFrame) -> DataFrame:
    """Remove what repeats from smaller documents; returns digests.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256, one row for each row of ``docs``. A byte goes if a window of
    50 bytes that covers it also starts in a document with a smaller doc_id.
    A null text is empty; texts below 50 bytes keep all. A null doc_id is
    greater than all others. Rows of equal doc_id, repeated rows too, don't
    remove from each other. Very long texts are taken whole, in segments.
    Other columns are not looked at. An empty table gives an empty result.

    Texts are shuffled once, in ranges of doc_id laid out by quantiles; the
    passes read that shuffle again. All rows of one doc_id share a shard.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("data"))
    total = d.select(F.sum(F.octet_length("data"))).first()[0]
    if total is None:
        return spark.createDataFrame([], OUT)
    shard_bytes = min(max(SHARD_BYTES, total // SHARDS), SHARD_GROWTH * SHARD_BYTES)
    shards, buckets = max(1, -(-total // shard_bytes)), max(1, -(-total // BUCKET_BYTES))
    n = min(KNOTS, shards)
    knots = np.array(d.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(n + 1)], 0.25 / n) or [0.0])
    at, last = np.unique(knots[::-1], return_index=True)
    level = (len(knots) - 1 - last) * (shards / max(1, len(knots) - 1))

    x, below = F.col("doc_id").cast("double"), F.lit(at.tolist())
    i = F.size(F.filter(below, lambda k: k <= x))
    part = lambda values, j: F.get(F.lit(values.tolist()), j)
    here = part(level, i - 1) + (part(level, i) - part(level, i - 1)) * (x - part(at, i - 1)) / (part(at, i) - part(at, i - 1))
    found = F.when(x.isNull(), F.lit(shards)).when(i == 0, F.lit(0)).when(i >= len(at), F.lit(shards - 1)).otherwise(F.least(F.floor(here), F.lit(shards - 1)))
    # as many partitions as the bytes ask for, so that tasks don't grow with the input
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    texts = d.withColumn("shard", found.cast("long")).repartition(parts, "shard")

    def send_keys(table: pa.Table) -> pa.Table:
        s = Shard(table)
        return tidy(_rows(table.column("shard")[0].as_py(), s.sent_anchors, s.sent_arounds, buckets))

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left)
        hashes = _distinct_windows(s, _flags(right, len(s.sent_anchors))[s.place])[3]
        return tidy(_rows(left.column("shard")[0].as_py(), hashes, None, buckets))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left)
        kind = np.array(right.column("kind").to_pylist(), int)
        flags = _flags(right.filter(pa.array(kind == 0)), len(s.sent_anchors))[s.place]
        back = np.frombuffer(b"".join(x for _, x in sorted(zip(right.filter(pa.array(kind == 1)).column("bucket").to_pylist(), right.filter(pa.array(kind == 1)).column("flags").to_pylist(), strict=True))), np.uint8)
        gone = removed_bytes(s, flags, back)
        rows = []
        for doc_id, a, b in zip(s.real, s.starts.tolist(), s.ends.tolist(), strict=True):
            g = gone[a:b]
            rows.append((doc_id, b - a, int(g.sum()), int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)), hashlib.sha256(s.data[a:b][~g].tobytes()).hexdigest()))
        names = [x.split()[0] for x in OUT.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()]
        return tidy(pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, types, strict=True))}))

    keys = texts.groupBy("shard").applyInArrow(send_keys, SENT)
    told = keys.repartition(parts, "bucket").groupBy("bucket").applyInArrow(compare_keys, BACK)
    windows = texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(send_windows, SENT)
    back = windows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(compare_windows, BACK)
    both = told.withColumn("kind", F.lit(0)).unionByName(back.withColumn("kind", F.lit(1)))
    return texts.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(finish, OUT)


#: The query's oracle: every window is a row, so it is for small tables.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
windows AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 100) AS x FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 49)) AS p FROM d)),
gone AS MATERIALIZED (SELECT w.doc_id, w.p FROM windows w JOIN (SELECT x, min(doc_id) AS first FROM windows GROUP BY x HAVING count(DISTINCT doc_id) > 1) f ON f.x = w.x AND f.first < w.doc_id),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT d.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS hx
  FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(d.hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.hx, d.hx))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
