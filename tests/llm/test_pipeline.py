"""The five stages against plain versions of them, one after the other."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheetwright.llm import bpe

from .conftest import words
from .test_corpus import WORD, brute_near, brute_quality, brute_templates

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


def without_frequent_lines(rows, least=20, share=0.01):
    lines, hosts = defaultdict(set), defaultdict(set)
    plain = lambda x: "".join(WORD.findall(x)).lower()
    for _, t, source in rows:
        hosts[source].add(t)
        for x in t.split("\n"):
            if plain(x):
                lines[source, plain(x)].add(t)
    bad = {k for k, v in lines.items() if len(v) >= least and len(v) >= share * len(hosts[k[0]])}
    return [(i, "\n".join(x for x in t.split("\n") if (s, plain(x)) not in bad), s) for i, t, s in rows]


def copies_of(rows, seed=17):
    """How often each document is taken: targets by giving out what is above the caps again and again."""
    size = lambda t: len(WORD.findall(t))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {s: 0.0 for s in order}, 1.5 * sum(total.values()), set(order)
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + level * weight[s] >= 2 * total[s]}
        if not full:
            for s in open_:
                target[s] += level * weight[s]
            break
        least = min((2 * total[s] - target[s]) / weight[s] for s in full)
        for s in open_:
            target[s] += least * weight[s]
        left -= least * sum(weight[s] for s in open_)
        open_ -= {s for s in open_ if target[s] >= 2 * total[s] - 1e-9}
    out = {}
    for i, _, s in rows:
        rate = target[s] / total[s] if total[s] else 0.0
        draw = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
        out[i] = int(rate) + (draw < rate - int(rate))
    return out


def test_pipeline(spark, rows, tmp_path):
    import random

    r = random.Random(12)
    line = "subscribe to our letter for more news every week"
    more = [(1000 + i, " ".join(words(r, r.randint(55, 90))) + f"\n{line}\nposted by guest{i} on the board", "en", "h", 0, 7, "c") for i in range(30)]
    more += [(2000 + i, more[3][1].replace("posted", f"edited{i}"), "en", "h", 0, 7, "c") for i in range(3)]
    all_ = [x for x in rows if x[0] != 300] + more
    spark.createDataFrame(all_, "doc_id long, text string, lang string, source string, n_chars long, size long, k string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = [(i, t or "", s) for i, t, _, s, *_ in all_]
    kept = {i for i, v in brute_quality(docs, 20, 0.01).items() if v[-1]}
    docs = [x for x in without_frequent_lines(docs) if x[0] in kept]
    source = {i: s for i, _, s in docs}
    docs = [(i, t, source[i]) for i, _, _, t in brute_templates([x[:2] for x in docs], 20)]
    first = {c for _, c, _ in brute_near([x[:2] for x in docs])}
    docs = [x for x in docs if x[0] in first]
    copies = copies_of(docs)
    codec, want = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), []
    for i, t, _ in docs:
        ids = np.frombuffer(codec.encode(t), "<u4")
        want += [(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())] * copies[i]
    assert got == sorted(want) and len(first) < len(kept) and all(line not in t for _, t, _ in docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "source_mixing", "byte_bpe"]


def test_stages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == none.columns)


def test_stages_of_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows: each stage ends, and the last counts what is left."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "word " * 30_000, None, None, None), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, " ".join(f"w{i}" for i in range(60)), "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert all(x is not None for x in [stage(spark, docs, "").count()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert {x.doc_id for x in docs.collect()} <= {4}
