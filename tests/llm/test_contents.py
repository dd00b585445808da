"""What counts as one document or one text across documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sheetwright.llm import quality, repeats, templates


def made(n, shared, own, seed=5):
    """``n`` texts of as many own words each, all with one shared line."""
    r = random.Random(seed)
    line = " ".join(f"shared{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(shared))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    return line, [" ".join(word() for _ in range(own)) for _ in range(n)]


def test_template_counts_documents_that_share_words(spark):
    """26 unrelated documents count as 26 although one word is the least of all in each."""
    line, own = made(26, 40, 12)
    d = spark.createDataFrame([(i, f"{x}\n{line}") for i, x in enumerate(own)], "doc_id long, text string")
    got = templates.template_report(d).collect()
    assert all(r.n_dropped == 1 and line not in r.text for r in got)
    assert templates.template_report(d.where("doc_id < 19")).where("n_dropped > 0").count() == 0


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_copies_count_by_their_whole_texts(spark, edits):
    """60 exact copies are one document, so they lose no line; 60 texts that differ anywhere are 60 documents, so what they share goes."""
    r, (line, (own,)) = random.Random(9), made(1, 12, 200)
    rows = []
    for i in range(60):
        w = own.split()
        for j in r.sample(range(200), edits):
            w[j] = f"edit{chr(97 + i % 26)}{chr(97 + i // 26)}"
        rows.append((i, f"{line}\n{' '.join(w)}", "h"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = templates.template_report(d).where("n_dropped > 0")
    assert gone.count() == (60 if edits else 0) and gone.where(f"text like '%{line}%'").count() == 0
    kept = quality.quality_filter(d)
    assert kept.count() == 60 and kept.where(f"text like '%{line}%'").count() == (0 if edits else 60)


def test_host_line_counts_depleted_documents(spark):
    """Documents that are mostly one boilerplate line don't fold into one."""
    line, own = made(30, 60, 10)
    d = spark.createDataFrame([(i, f"{x}\n{line}", "h") for i, x in enumerate(own)], "doc_id long, text string, source string")
    assert not any(r.kept for r in quality.quality_report(d).collect())


@pytest.mark.parametrize("bit", [0, 32])
def test_texts_around_an_anchor_differ_by_any_bit(bit):
    """Two surroundings of one anchor whose 64-bit hashes differ in one bit are two texts; equal ones are one."""
    around = [np.uint64(5 << 40), np.uint64((5 << 40) ^ (1 << bit)), np.uint64(5 << 40)]
    rows = [repeats._rows(k, np.array([77], np.uint64), np.array([a], repeats.Shard(pa.table({"doc_id": [1], "data": [b"x" * 60]})).arounds.dtype), 1) for k, a in enumerate(around)]
    got = repeats.compare_keys(pa.concat_tables(rows))
    assert [x.as_py()[0] for x in got.column("flags")] == [2, 2, 1]


def test_surroundings_keep_64_bits():
    """Hashes of many surroundings differ in their low half too."""
    r = random.Random(2)
    data = "".join(r.choice("abcdefgh ") for _ in range(5000)).encode()
    found = repeats.Shard(pa.table({"doc_id": [1], "data": [data]})).arounds
    assert found.dtype == np.uint64 and len(np.unique(found & np.uint64(0xFFFFFFFF))) > 50 and (found >> np.uint64(32)).any()
