"""N-gram Jaccard join by chosen paths.

Sets of 5-word shingles are embedded by minhashing. A run samples minhash
tokens by a hash of the path so far and the token; sets that share a sampled
token go down the same path. Paths that few sets reach are compared by brute
force, others are split again on further sampled tokens, and runs are
repeated until a pair at the threshold is met with the target recall.

What is met is linked loosely by estimate, and connected parts of these
links are then compared exactly, block against block, so each pair counts
once however many runs met it. Pairs are never emitted: a block yields sums
of links and a spanning forest. Sets are told apart by 63-bit hashes, and
shingles by 64-bit ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, maybe_broadcast, release, row_key
from .graphs import components

WORDS, THRESHOLD = 5, 0.8
#: Minhash tokens of a set; chance that a pair at the threshold is met at least.
TOKENS, RECALL = 128, 0.999
#: Sets on a path up to which they are compared by brute force; splits at most.
SMALL, DEPTH = 512, 2
#: After the last split, sets far from their path's leader beyond which the path is dealt by groups of tokens: WIDE
#: is where that makes fewer rows than blocks do. Groups, and tokens of each: a pair at the threshold shares none
#: of the groups with a chance of (1 - 0.8 ** 6) ** 40, about 5 in a million.
BANDS, BAND_TOKENS = 40, 6
WIDE = BANDS * SMALL
#: Sets, and shingles of all of them, that blocks of a part are laid out for; shingles compared at once.
BLOCK, BLOCK_ITEMS, SLICE_ITEMS = 1024, 400_000, 200_000
#: Sets of an item up to which its pairs are counted one by one.
RARE = 12
#: Estimates from which two sets are linked loosely, and from which a set needs no more splits. A set
#: at 0.7 from a leader has all sets at 0.8 from itself at 0.5 or more from the leader, as distances
#: 1 - J add up at most; the rest of the gap is for errors of the estimate (0.044 in deviation).
LOOSE, DONE = 0.4, 0.7

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ODD = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_ADD = mix(np.arange(1001, TOKENS + 1001, dtype=np.uint64) * _GOLD)
#: The tokens of each group.
_BANDS = mix(np.arange(1, BANDS * TOKENS + 1, dtype=np.uint64) * _M2).reshape(BANDS, TOKENS).argsort(axis=1)[:, :BAND_TOKENS]


def runs_for(recall: float, splits: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is met with this chance.

    The tokens that such a pair shares are sampled once on average, so it
    goes down the same path with a chance of 1 - 1/e, and after each split
    with 1 - e ** -(that so far). The worst case is taken: none of the
    shared tokens is rare enough to meet on a small path before the last split.
    """
    met = 1.0
    for _ in range(splits + 1):
        met = 1 - math.exp(-met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``words`` words.

    A text with fewer words is one shingle, one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * _GOLD + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def minhashes(found: np.ndarray) -> np.ndarray:
    """The minhash tokens of a set; zeros for the empty one."""
    if not len(found):
        return np.zeros(TOKENS, np.uint64)
    least = np.full(TOKENS, ~np.uint64(0), np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(least, (found[None, i : i + 1024] * _ODD[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return mix(least)


def sampled(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path below) of the tokens sampled on each row's path.

    A token is sampled if the hash of path, place and token is below
    1 / (threshold * tokens), whichever set it is in.
    """
    node = mix(path.astype(np.uint64)[:, None] * _GOLD + mix(tokens + np.arange(1, TOKENS + 1, dtype=np.uint64) * _M2))
    row, at = np.nonzero(node < np.uint64(2**64 / (THRESHOLD * TOKENS)))
    return row, mix(node[row, at] + _GOLD)


def alike(sig: np.ndarray) -> np.ndarray:
    """Estimated likeness of all rows of tokens with each other."""
    out = np.empty((len(sig), len(sig)), np.float32)
    step = max(1, 4096 // max(1, len(sig)))
    for i in range(0, len(sig), step):
        out[i : i + step] = (sig[i : i + step, None, :] == sig[None, :, :]).mean(axis=2)
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """The least index of each row's connected part in a symmetric matrix."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each group of rows with one value in the first column; batches come sorted by it.

    One group is held at a time, besides the batch that is read.
    """
    held: list[list] | None = None
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        columns = [c.to_pylist() for c in batch.columns]
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = [c[a:b] for c in columns]
            if held is not None and held[0][0] == part[0][0]:
                for have, more in zip(held, part, strict=True):
                    have.extend(more)
                continue
            if held is not None:
                yield held
            held = part
    if held is not None:
        yield held


def in_groups(rows: DataFrame, found: Callable[[list[list]], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """What ``found`` makes of each group of rows with one value in the first column; its columns are longs."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*made, strict=True)], names=names)

        for group in each_group(batches):
            made.append(found(group))
            n += len(made[-1][0])
            if n > 50_000:
                yield out()
                made, n = [], 0
        if made:
            yield out()
        release()

    key = rows.columns[0]
    return rows.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def _sets(docs: DataFrame, runs: int) -> DataFrame:
    """(k, doc_id, sid, n, sig, paths) of each document: its set's id, size, short tokens, and its paths in all runs."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    starts = np.arange(1, runs + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, size, sig, paths = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                tokens = minhashes(found)
                sid.append(xxhash.xxh3_64_intdigest(found.tobytes()) >> 1)
                size.append(len(found))
                sig.append(tokens.astype(np.uint16).tobytes())
                below = sampled(starts, np.broadcast_to(tokens, (runs, TOKENS)))[1] if len(found) else np.zeros(0, np.uint64)
                paths.append(below.view(np.int64))
            flat = np.concatenate(paths) if paths else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["k", "doc_id", "sid", "n", "sig", "paths"],
            )
        release()

    return rows.mapInArrow(run, "k long, doc_id long, sid long, n long, sig binary, paths array<long>")


def _signed(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), TOKENS)


def _loose_group(group: list[list]) -> tuple[np.ndarray, ...]:
    sid, at = np.unique(np.array(group[1], np.int64), return_index=True)
    sig = _signed([group[2][i] for i in at.tolist()])
    root = forest(alike(sig) >= LOOSE)
    mine = root != np.arange(len(root))
    return sid[mine], sid[root[mine]]


def _small_links(groups: DataFrame) -> DataFrame:
    """Links within groups of (gid, sid, sig): a forest of the pairs whose estimate is at least LOOSE."""
    return in_groups(groups.select("gid", "sid", "sig"), _loose_group, "a long, b long")


def tiled(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Each row of a block (``block`` of ``blocks``, both columns) once for each tile: its own block, and its with each other of ``key``.

    Adds ``tile`` and ``first``: 2 if the tile is one block, else 0 for the
    rows of its lower block and 1 for those of the other.
    """
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("tile", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).withColumn(
        "first", F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1))


def faced(rows: DataFrame) -> DataFrame:
    """Each row of (path, block, far, blocks) once for each tile (``gid``) in which its block meets another.

    The first ``far`` blocks meet all others, the rest only these. A block
    meets itself in every tile it is in; one alone has a tile of its own.
    """
    last = F.when(F.col("block") < F.col("far"), F.col("blocks")).otherwise(F.col("far")) - 1
    rows = rows.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), last), lambda o: (o != F.col("block")) | (F.col("blocks") == 1))))
    return rows.withColumn("gid", F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")))


def _with_tokens(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """(sid, sig, held) of each set in ``rows``; held has the other columns of its rows.

    Tokens are joined once a set, so that the join makes no more rows than
    there are sets, on however many paths these are.
    """
    held = rows.groupBy("sid").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "sid"])).alias("held"))
    return held.join(sigs, "sid").select("sid", "sig", "held")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    """(sids, tokens, row of each held struct, held structs) of rows of (sid, sig, held), some at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            row = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
            yield part.column(0).to_numpy(), _signed(part.column(1).to_pylist()), row, part.column(2).flatten()
    release()


def _leader_links(members: DataFrame) -> DataFrame:
    """(path, sid, leader, est) of rows of (sid, sig, held: path, leader, lsig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sid, sig, row, held in _held(batches):
            est = (sig[row] == _signed(held.field("lsig").to_pylist())).mean(axis=1)
            yield pa.RecordBatch.from_arrays([held.field("path"), pa.array(sid[row]), held.field("leader"), pa.array(est, pa.float64())], names=["path", "sid", "leader", "est"])

    return members.mapInArrow(run, "path long, sid long, leader long, est double")


def banded(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path below) of the groups of tokens on each row's path; equal groups on a path go down together."""
    below = mix(path.astype(np.uint64)[:, None] * _GOLD + np.arange(1, BANDS + 1, dtype=np.uint64) * _M2)
    for at in _BANDS.T:
        below = mix(below * _GOLD + tokens[:, at])
    return np.repeat(np.arange(len(path)), BANDS), below.ravel()


def _split(members: DataFrame, below: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(path, sid) one level below rows of (sid, sig, held: path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sid, sig, row, held in _held(batches):
            at, path = below(held.field("path").to_numpy().view(np.uint64), sig[row].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(sid[row][at])], names=["path", "sid"])

    return members.mapInArrow(run, "path long, sid long")


def loose_links(reps: DataFrame) -> DataFrame:
    """Links (a, b) that hold together all sets which a run met and found alike.

    ``reps``: (sid, sig, paths), one row a set. On a path of many sets, each
    is compared with the path's leader, its least set; as distances add up at
    most, sets near a leader need no more splits once all sets that could be
    near them are linked to it too. Of the rest, sets that are linked to the
    leader are together already, so only sets far from it are compared with
    each other and with those. If they are few this is done by brute force,
    block against block of the path; else the rest is split again. After
    DEPTH splits it is done by brute force too, but if very many are far, the
    rest is first dealt by equal groups of tokens.
    """
    found: list[DataFrame] = []
    sigs = reps.select("sid", "sig")
    now = materialize(reps.select(F.explode("paths").alias("path"), "sid"), "paths")
    for depth in range(DEPTH + 2):
        counted = materialize(now.groupBy("path").agg(F.count("*").alias("n"), F.min("sid").alias("leader")).where("n > 1"), "path-counts")
        if not counted.limit(1).count():
            break
        # sets alone on their paths need no tokens any more
        live = materialize(now.join(counted, "path"), "live-paths")
        sigs = materialize(sigs.join(live.select("sid").distinct(), "sid", "left_semi"), "live-tokens")
        small = live.where(F.col("n") <= SMALL).groupBy("path").agg(F.sort_array(F.collect_set("sid")).alias("sids"))
        small = small.select("sids").where(F.size("sids") > 1).distinct().select(F.xxhash64("sids").alias("gid"), F.explode("sids").alias("sid"))
        found.append(materialize(_small_links(_with_tokens(small, sigs).select("sid", "sig", F.explode("held.gid").alias("gid"))), "loose"))
        large = live.where(F.col("n") > SMALL)
        if not large.limit(1).count():
            break
        lead = counted.where(F.col("n") > SMALL).join(sigs.withColumnRenamed("sid", "leader").withColumnRenamed("sig", "lsig"), "leader").select("path", "leader", "lsig")
        lead = maybe_broadcast(materialize(lead, "leaders"), 10_000)
        told = materialize(_leader_links(_with_tokens(large.select("path", "sid").join(lead, "path"), sigs)), "led")
        found.append(told.where(F.col("est") >= LOOSE).where("sid != leader").select(F.col("sid").alias("a"), F.col("leader").alias("b")))
        rest = told.where(F.col("est") < DONE)
        is_far = F.col("est") < LOOSE
        # a path without far sets is linked up; others are settled here or split
        sizes = materialize(rest.groupBy("path").agg(F.count_if(is_far).alias("n_far"), F.count_if(~is_far).alias("n_near")).where("n_far > 0"), "rest-sizes")
        most = SMALL if depth < DEPTH else WIDE if depth == DEPTH else 2**62
        settled = sizes.where(F.col("n_far") <= most).select("path", F.ceil(F.col("n_far") / SMALL).cast("int").alias("far"), F.ceil(F.col("n_near") / SMALL).cast("int").alias("near"))
        if settled.limit(1).count():
            hashed = F.xxhash64("sid", F.lit(11))
            blocks = rest.join(maybe_broadcast(settled), "path").withColumn("block", F.when(is_far, F.pmod(hashed, F.col("far"))).otherwise(F.col("far") + F.pmod(hashed, F.greatest("near", F.lit(1)))).cast("int"))
            blocks = _with_tokens(blocks.select("sid", "path", "block", "far", (F.col("far") + F.col("near")).alias("blocks")), sigs)
            found.append(materialize(_small_links(faced(blocks.select("sid", "sig", F.inline("held")))), "loose"))
        deeper = sizes.where(F.col("n_far") > most).select("path")
        if not deeper.limit(1).count():
            break
        now = materialize(_split(_with_tokens(rest.select("path", "sid").join(maybe_broadcast(deeper), "path", "left_semi"), sigs), sampled if depth < DEPTH else banded), "paths")
    out = reps.sparkSession.createDataFrame([], "a long, b long")
    for more in found:
        out = out.unionByName(more)
    return out


def shared_items(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two of some sorted sets share.

    Items are taken in ranges of their hashes, so that what is held beside
    the sets doesn't grow with them. Items of one set only are left out,
    those of few sets are counted pair by pair, and the others multiplied.
    """
    n = len(sets)
    both = np.zeros((n, n), np.float32)
    ranges = max(1, -(-sum(map(len, sets)) // SLICE_ITEMS))
    bounds = np.arange(1, ranges, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // ranges)
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for r in range(ranges):
        parts = [s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)]
        items = np.concatenate(parts)
        row = np.repeat(np.arange(n), [len(p) for p in parts])
        order = np.argsort(items, kind="stable")
        items, row = items[order], row[order]
        again = np.zeros(len(items), bool)
        again[1:] = items[1:] == items[:-1]
        often = again.copy()
        often[:-1] |= again[1:]
        row, column = row[often], np.cumsum(~again[often]) - 1
        count = np.bincount(column)
        of = count[column] if len(column) else count
        few = np.zeros(n * n, np.int64)
        for c in range(2, RARE + 1):
            mine = row[of == c].reshape(-1, c)
            if len(mine):
                few += np.bincount((mine[:, :, None] * n + mine[:, None, :]).ravel(), minlength=n * n)
        both += few.reshape(n, n)
        row = row[of > RARE]
        column = np.cumsum(count > RARE)[column[of > RARE]] - 1
        wide = int(column[-1]) + 1 if len(column) else 0
        step = max(64, min(4096, 4_000_000 // n))
        for i in range(0, wide, step):
            a, b = np.searchsorted(column, [i, i + step])
            has = np.zeros((n, min(step, wide - i)), np.float32)
            has[row[a:b], column[a:b] - i] = 1
            both += has @ has.T
    return both


def _exact_group(group: list[list]) -> tuple[np.ndarray, ...]:
    """(sid, links, root) of the rows (tile, first, sid, m, items) of a tile.

    links counts documents, m is how many share a set. root is the least set
    of the tile's linked part.
    """
    sid, at = np.unique(np.array(group[2], np.int64), return_index=True)
    sets = [np.frombuffer(group[4][i], np.uint64) for i in at.tolist()]
    if len(sets) < 2:
        none = np.zeros(0, np.int64)
        return none, none, none
    size, side = np.array([len(s) for s in sets], np.float64), np.array(group[1])[at]
    both = shared_items(sets)
    linked = np.empty(both.shape, bool)
    for i in range(len(sets)):
        linked[i] = both[i] >= THRESHOLD * (size[i] + size - both[i]) - 1e-9
    np.fill_diagonal(linked, False)
    if (side != 2).any():
        linked &= side[:, None] != side[None, :]
    links = (linked @ np.array(group[3], np.float64)[at]).astype(np.int64)
    mine = links > 0
    return sid[mine], links[mine], sid[forest(linked)[mine]]


def near_classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """k (of the row's content), doc_id, root, class_id, copy_id and n_links of each row."""
    d = materialize(_sets(docs, runs_for(recall)), "sets")
    reps = materialize(d.groupBy("sid").agg(F.count("*").alias("m"), F.min("doc_id").alias("copy_id"), F.min("k").alias("k"), F.first("sig").alias("sig"), F.first("paths").alias("paths"), F.first("n").alias("n")), "set-reps")
    root = materialize(components(loose_links(reps.where("n > 0"))), "loose-parts")
    # blocks of each part, by the number of its sets and by their sizes; a tile is one block or two blocks of a part
    part = root.join(reps.select(F.col("sid").alias("node"), "m", "k", "n"), "node")
    laid = part.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks")).where("blocks > 1")
    part = part.join(maybe_broadcast(materialize(laid, "large-parts")), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    part = part.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    part = materialize(part.select("k", F.col("node").alias("sid"), "m", "root", "block", "blocks"), "loose-blocks")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), F.col("text").cast("string").alias("text")).join(maybe_broadcast(part), "k")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingles(x.as_py()).tobytes() for x in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=["sid", "m", "root", "block", "blocks", "items"])
        release()

    rows = texts.select("text", "sid", "m", "root", "block", "blocks").mapInArrow(items, "sid long, m long, root long, block int, blocks int, items binary")
    tiles = tiled(rows, "root", "sid").select("tile", F.col("first").cast("long").alias("first"), "sid", "m", "items")
    exact = materialize(in_groups(tiles, _exact_group, "sid long, links long, root long"), "exact")
    links = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    # parts of one block are whole; only those of several blocks need joining up
    wide = part.where("blocks > 1").select("sid")
    across = materialize(exact.join(wide, "sid", "left_semi").select(F.col("sid").alias("a"), F.col("root").alias("b")), "across")
    classes = exact.join(wide, "sid", "left_anti").select(F.col("sid").alias("node"), "root")
    if across.limit(1).count():
        classes = classes.unionByName(components(across))
    named = reps.select("sid", "m", "copy_id").join(links, "sid", "left").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = join_hot(named, least, "root").select("sid", "root", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    return join_hot(d.select("k", "doc_id", "sid"), named, "sid").select("k", "doc_id", "root", "class_id", "copy_id", "n_links")


def near_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Near-duplicate classes and links of all documents.

    Returns one row for each row of ``docs``: doc_id, class_id (the least
    doc_id of all documents connected by links), copy_id (the least doc_id
    with the same set of shingles) and n_links (other rows whose sets are
    alike at 0.8 or more, equal ones included). Texts without words, null
    ones too, have equal (empty) sets; a text of fewer than five words is one
    shingle. Repeated rows link each other. Null doc_ids count as rows, and
    name a class only if nothing else is in it. Very long texts are taken
    whole; other columns are not looked at. An empty table gives an empty
    result.
    """
    return near_classes(docs, recall).select("doc_id", "class_id", "copy_id", "n_links")


def near_filter(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One document of each class, all columns: that of the least doc_id (null last).

    Of documents that share this doc_id, one stays; of all texts without
    words, null ones too, one stays. Documents that go are joined to the
    table by a key of their content; texts are shuffled only where rows are
    repeated outright. Columns of other names stay as they are. An empty
    table gives an empty result.
    """
    classes = materialize(near_classes(docs, recall), "near-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k"))
    kept = classes.groupBy("root").agg(first.alias("f")).select("root", F.col("f.k").alias("kept"))
    gone = materialize(join_hot(classes, kept, "root").where("k != kept").select(F.col("k").alias("_n_k")).distinct(), "near-gone")
    often = materialize(classes.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("_n_k")), "near-repeated")
    out = docs.withColumn("_n_k", row_key(F.col("doc_id"), F.col("text"))).join(maybe_broadcast(gone), "_n_k", "left_anti")
    often = maybe_broadcast(often)
    out = out.join(often, "_n_k", "left_anti").unionByName(out.join(often, "_n_k", "left_semi").dropDuplicates(["_n_k"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The query's oracle: every pair that shares a shingle is counted, so it is for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i : i + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT r, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0))),
sets AS MATERIALIZED (
  SELECT d.r, d.doc_id, coalesce(s.n, 0) AS n, coalesce(s.every, '') AS every FROM d LEFT JOIN (SELECT r, count(*) AS n, string_agg(x, '|' ORDER BY x) AS every FROM shingles GROUP BY r) s USING (r)),
pairs AS MATERIALIZED (
  SELECT a, b FROM (SELECT s.r AS a, t.r AS b, count(*) AS shared FROM shingles s JOIN shingles t ON s.x = t.x AND s.r < t.r GROUP BY ALL) JOIN sets p ON p.r = a JOIN sets q ON q.r = b WHERE 5 * shared >= 4 * (p.n + q.n - shared)
  UNION ALL SELECT p.r, q.r FROM sets p JOIN sets q ON p.n = 0 AND q.n = 0 AND p.r < q.r),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT r, r AS root FROM sets UNION SELECT l.b, c.root FROM reached c JOIN links l ON l.a = c.r),
roots AS (SELECT r, min(root) AS root FROM reached GROUP BY r),
classes AS (SELECT root, min(doc_id) AS class_id FROM roots JOIN sets USING (r) GROUP BY root),
copies AS (SELECT every, min(doc_id) AS copy_id FROM sets GROUP BY every)
SELECT s.doc_id, c.class_id, o.copy_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM sets s JOIN roots USING (r) JOIN classes c USING (root) JOIN copies o USING (every) LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY a) l USING (r)
"""
