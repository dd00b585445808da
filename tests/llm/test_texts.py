"""Fingerprints, tokens, repeats: against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetwright.llm import bpe, fingerprints, repeats

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def plain_likeness(a, b):
    """What two texts share, by comparing the spans themselves: cut where the rule says, and openings at even steps."""
    if a == b:
        return 1.0
    found = [fingerprints.cut_places(fingerprints.prefixes(t)[0]) for t in (a, b)]
    level = max(x[0] for x in found)
    spans = []
    for t, (_, place, zeros) in zip((a, b), found):
        at = [0, *(p for p, z in zip(place.tolist(), zeros.tolist()) if z >= level), len(t)]
        spans.append(Counter(t[i:j] for i, j in zip(at, at[1:])))
    shared = sum(len(x) * n for x, n in (spans[0] & spans[1]).items())
    step = max(map(fingerprints.step_of, (len(a), len(b))))
    opening = 0
    while opening + step <= min(len(a), len(b)) and a[: opening + step] == b[: opening + step]:
        opening += step
    return min(1.0, 2 * max(shared, opening) / (len(a) + len(b)))


def test_fingerprints_of_large_ids(spark):
    """Ids that doubles can't tell apart, nulls among them, repeated rows and one chunk's heads."""
    rows = [((1 << 60) + 3 * i + 1, f"text {i} of some words") for i in range(40)] + [(None, "no id"), (None, "no id"), (7, "seven"), (7, "seven"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    for n in (1, 4):
        got = fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t)) for i, t in rows)
        plain = sorted(rows, key=lambda x: -(1 << 70) if x[0] is None else x[0], reverse=True)
        nxt = {plain[i][0]: plain[(i + 1) % len(plain)][1] for i in range(len(plain))}
        for r in got:
            if r.doc_id not in (7, None):
                t, other = dict(rows)[r.doc_id], nxt[r.doc_id]
                assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + other[: len(t) // 2]).encode()).hexdigest()


def test_fingerprints(docs, rows):
    got = {}
    for r in fingerprints.fingerprint_report(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    plain = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: -x[0])
    assert sum(map(len, got.values())) == len(plain)
    for n, (i, t) in enumerate(plain):
        if i == 300:
            continue
        other = plain[(n + 1) % len(plain)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        (r,) = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest()), i
        assert r.fingerprint == fingerprints.fingerprint(t) and r.edited_fingerprint == fingerprints.fingerprint(new)
        n = 0
        while n < min(len(t), len(new)) and t[n] == new[n]:
            n += 1
        assert r.kept_chars == n
        assert r.near_edited == plain_likeness(t, new) and r.near_next == plain_likeness(t, other)
    assert got[101][0].near_next == 1.0 and got[101][0].fingerprint == got[100][0].fingerprint
    assert got[112][0].near_next > 0.8 > got[30][0].near_next


def test_fingerprints_of_nothing(none, spark):
    assert fingerprints.fingerprint_report(none).count() == 0
    one = spark.createDataFrame([(None, "lonely text here")], "doc_id long, text string")
    assert fingerprints.fingerprint_report(one).first().n_chars == 16


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_common_extension(a, b):
    x, y = (tuple(fingerprints.PrefixHash(fingerprints.code_points(t), k) for k in (0, 1)) for t in (a, b))
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    assert fingerprints.common_extension(x, 0, y, 0) == n
    assert x[0].span(0, n) == y[0].span(0, n)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abethinors  \n\t'’dé中漢ßü🙂019.,;-—", max_size=80))
def test_same_ids_as_the_library(codec, library, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_pieces(codec, library):
    for text in ("a" * 3000, " " * 2000, "ab" * 1500, "\n" * 999):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_tokens(docs, rows, none, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_report(docs, PATH, P.PATTERN).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.token_report(none, PATH, P.PATTERN).count() == 0


def _hot_in_process(rows, hot, monkeypatch):
    """The passes one after the other in this process, over shards of a few documents."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "HOT", hot)
    edge = "this passage of fifty bytes and more stands in many documents here"
    more = sorted([(i, t or "") for i, t, *_ in rows if i != 300] + [(500 + i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i % 7)}{edge}{i * 7919}") for i in range(40)])
    parts = [more[i : i + 9] for i in range(0, len(more), 9)]
    shards = [repeats.Shard(pa.table({"doc_id": [i for i, _ in p], "data": [t.encode() for _, t in p]})) for p in parts]
    assert any((s.sent_arounds == repeats.MARK).any() for s in shards)

    def passed(send, compare):
        rows_ = pa.concat_tables([send(k, s) for k, s in enumerate(shards)])
        buckets = set(rows_.column("bucket").to_pylist())
        return pa.concat_tables([compare(rows_.filter(pa.array([b == x for x in rows_.column("bucket").to_pylist()]))) for b in buckets]) if buckets else None

    mine = lambda table, k: table.filter(pa.array([x == k for x in table.column("shard").to_pylist()]))
    told = passed(lambda k, s: repeats._rows(k, s.sent_anchors, s.sent_arounds, 7), repeats.compare_keys)
    flags = [repeats._flags(mine(told, k), len(s.sent_anchors))[s.place] for k, s in enumerate(shards)]
    back = passed(lambda k, s: repeats._rows(k, repeats._distinct_windows(s, flags[k])[3], None, 7), repeats.compare_windows)
    got = set()
    for k, s in enumerate(shards):
        gone = repeats.removed_bytes(s, flags[k], repeats._flags(mine(back, k), len(repeats._distinct_windows(s, flags[k])[3])))
        got |= {(i, int(b - a), int(gone[a:b].sum())) for i, a, b in zip(s.real, s.starts, s.ends)}
    assert got == {x[:3] for x in brute_repeats([(i, t, None) for i, t in more])}


@pytest.mark.parametrize("hot", [2, 32])
def test_repeats_across_shards(docs, rows, monkeypatch, hot):
    """Many shards and buckets: what repeats is found by the passes over the cluster, with most anchors hot too."""
    if hot != repeats.HOT:  # workers import the module anew, so other values are tried in this process
        _hot_in_process(rows, hot, monkeypatch)
        return
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(repeats, "PART_BYTES", 20_000)
    edge = "this passage of fifty bytes and more stands in many documents here"
    more = rows + [(500 + i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i % 7)}{edge}{i * 7919}", *rows[0][2:]) for i in range(40)]
    d = docs.sparkSession.createDataFrame(more, docs.schema).repartition(5)
    assert {tuple(r) for r in repeats.repeat_report(d).collect()} == brute_repeats(more)


def brute_repeats(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = set()
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.add((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("segment, shard", [(1 << 20, 2 << 20), (257, 3000)])
def test_repeats(docs, rows, none, monkeypatch, segment, shard):
    more = rows + [(400, "ab" * 100, *rows[0][2:]), (401, "ba" * 100, *rows[0][2:]), (402, "zz" + "ab" * 60, *rows[0][2:])]
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    if segment < 1000:  # workers import the module anew: look at one shard here
        import pyarrow as pa

        monkeypatch.setattr(repeats, "SEGMENT", segment)
        s = repeats.Shard(pa.table({"doc_id": [i for i, *_ in more], "data": [(t or "").encode() for _, t, *_ in more]}))
        flags = np.full(len(s.anchors), 2, np.uint8)
        n = len(repeats._distinct_windows(s, flags)[3])
        gone = repeats.removed_bytes(s, flags, np.zeros(n, np.uint8))
        got = {(i, int(b - a), int(gone[a:b].sum())) for i, a, b in zip(s.real, s.starts, s.ends)}
        assert got == {x[:3] for x in brute_repeats(more)}
        return
    d = docs.sparkSession.createDataFrame(more, docs.schema)
    assert {tuple(r) for r in repeats.repeat_report(d).collect()} == brute_repeats(more)
    assert repeats.repeat_report(none).count() == 0
