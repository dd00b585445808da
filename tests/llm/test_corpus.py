"""Quality rules, line dedup, near duplicates, mixing: against plain versions."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sheetwright.llm import mixing, near, quality, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(t):
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(tri)
    cover = {j for i, x in enumerate(tri) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def brute_quality(rows, least=2, share=0.05):
    lines, hosts = defaultdict(set), defaultdict(set)
    for i, t, source in rows:
        hosts[source].add(t)
        for x in t.split("\n"):
            n = "".join(WORD.findall(x)).lower()
            if n:
                lines[source, n].add(t)
    bad = {k for k, v in lines.items() if len(v) >= least and len(v) >= share * len(hosts[k[0]])}
    out = {}
    for i, t, source in rows:
        m = base_measures(t)
        lost = sum(len("".join(WORD.findall(x))) for x in t.split("\n") if (source, "".join(WORD.findall(x)).lower()) in bad)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        out[i] = (*m, failed, not failed and not lost > 0.5 * m[1])
    return out


def test_quality(docs, rows, none):
    report = quality.quality_report(docs, min_docs=2, min_share=0.05)
    got = {r[0]: tuple(r)[1:8] for r in report.collect()}
    assert got == brute_quality([(i, t or "", s) for i, t, _, s, *_ in rows])
    assert report.count() == len(rows)
    kept = quality.quality_filter(docs, min_docs=2, min_share=0.05)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, v in got.items() if v[-1]}
    assert quality.quality_report(none).count() == 0 and quality.quality_filter(none).count() == 0


def test_repeated_words_with_packed_ties(spark):
    """Hashes that agree in the packed bits but differ are told apart."""
    a, b = 5 << 20, (5 << 20) + 1
    d = spark.createDataFrame([([a, b, a, 9 << 20],), ([a, b, 7 << 20],), ([],), ([a, a],)], "h array<bigint>")
    assert [r.n for r in quality.repeated_words(d, "h", "n").collect()] == [5, 0, 0, 4]


def test_depleted(spark):
    line = "subscribe to our letter for more news every single week of the whole year"
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    rows = [(i, f"{own[i]}\n{line}" if i < 25 else f"{line}\n{own[i][:40]}\n" + line.upper() + "\n" + line.replace(" ", "  ") + f"\nz{i} y{i}" * 3, "h") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_report(d).collect()}
    assert all(got[i] for i in range(25)) and not any(got[i] for i in range(25, 30))
    assert line not in quality.quality_filter(d).where("doc_id = 3").first().text


def test_templates(spark, docs, none):
    rows = [(i, f"unique {i} words of document number{i} are here\nPosted by user{i} on day{i}\nRead more stories about city{chr(97 + i)} today please\nshort") for i in range(26)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in templates.template_report(d).collect()}
    assert all("Posted by" not in r.text and "short" in r.text and r.n_lines == 4 for r in got.values())
    assert all("Read more" not in r.text for r in got.values()) and got[5].n_dropped >= 2
    few = templates.template_report(d.where("doc_id < 10"))
    assert few.where("n_dropped > 0").count() == 0
    assert templates.template_report(docs).count() == docs.count() and templates.drop_templates(docs).columns == docs.columns
    assert templates.template_report(docs).where("doc_id = 200").first().text is None
    assert templates.template_report(none).count() == 0


def brute_templates(rows, least, depth=3, fixed_share=0.5, shortest=3):
    """The template tree in plain Python: what each document loses."""
    lines = {}
    for i, t in rows:
        for x in t.split("\n"):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(x))
            if len(tokens) >= shortest:
                lines.setdefault((len(tokens), tokens[:depth]), defaultdict(set))[tokens].add(t)
    bad = set()
    for held in lines.values():
        if len(set().union(*held.values())) < least:
            continue
        at = Counter()
        for tokens, texts in held.items():
            for place, w in enumerate(tokens):
                at[place, w] += len(texts)
        shapes = defaultdict(set)
        for tokens in held:
            kept = tuple((place, w) for place, w in enumerate(tokens) if w != "<*>" and at[place, w] >= least)
            if kept and len(kept) >= fixed_share * len(tokens):
                shapes[kept].add(tokens)
        for same in shapes.values():
            if len(set().union(*(held[t] for t in same))) >= least:
                bad |= same
    out = []
    for i, t in rows:
        gone = [tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(x)) in bad for x in t.split("\n")]
        out.append((i, len(gone), sum(gone), "\n".join(x for x, g in zip(t.split("\n"), gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("least", [2, 5, 20])
def test_templates_by_brute_force(docs, rows, least):
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in templates.template_report(docs, min_docs=least).where("doc_id != 200").collect())
    assert got == brute_templates([(i, t) for i, t, *_ in rows if t is not None], least)


def test_templates_on_the_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in templates.template_report(d, min_docs=5).collect())
    want = brute_templates(rows, 5)
    assert got == want and sum(x[2] for x in want) > 0


def test_one_line_of_many_unlike_documents(spark):
    """A line that 200 documents share goes from all of them, by templates and per host, though they share words too."""
    words = [f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(100)]
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(words) for _ in range(60)) + "\nRead the whole story on our own site", "h") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert templates.template_report(d).where("n_dropped = 1 and text not like '%story%'").count() == 200
    kept = quality.quality_filter(d)
    assert kept.count() == 200 and kept.where("text like '%story%'").count() == 0


def test_copies_are_no_template(spark):
    d = spark.createDataFrame([(i, "a document that was copied very often indeed\nwith two lines of words") for i in range(40)], "doc_id long, text string")
    assert templates.template_report(d).where("n_dropped > 0").count() == 0


def brute_near(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(t)
        k = min(5, len(w)) or 1
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()))
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    group = defaultdict(list)
    for n, (i, _) in enumerate(sets):
        group[find(n)].append(i)
    return sorted((i, min(group[find(n)]), links[n]) for n, (i, _) in enumerate(sets))


@pytest.mark.parametrize("small, block", [(512, 1024), (3, 2)])
def test_near(docs, rows, none, monkeypatch, small, block):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_ITEMS", 400 * block)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near.near_join(docs).collect())
    want = brute_near([(i, t or "") for i, t, *_ in rows])
    assert got == want
    if small > 3:
        kept = near.near_filter(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})
        assert near.near_join(none).count() == 0 and near.near_filter(none).count() == 0


def test_recall_of_planted_pairs(spark, monkeypatch):
    """Pairs at 0.8 to 0.9 that share all they share with a third of the others, on paths that are too large to compare at once."""
    monkeypatch.setattr(near, "SMALL", 16)
    r = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    rows, pairs = [], []
    for i in range(300):
        own = [f"d{i}x{j}" for j in range(70)]
        words = (common if i % 3 == 0 else []) + own
        twin = list(words)
        for at in r.sample(range(len(common) if i % 3 == 0 else 0, len(words)), 1):
            twin[at] = "edit"
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(twin))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    due = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {x.doc_id: x.class_id for x in near.near_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(due) > 250 and sum(got[a] == got[b] for a, b in due) >= 0.99 * len(due)


def loose_of(spark, monkeypatch, tokens):
    """(component of each row of ``tokens``, rows compared, rows joined to their tokens) of the loose links of sets on 15 paths that all are on."""
    import numpy as np
    from sheetwright.llm.graphs import components

    n = {"compared": 0, "joined": 0}

    def counted(rows, *args, f=near.in_groups):
        n["compared"] += rows.count()
        # rows that a join by sid makes, wherever it is
        plan = rows._jdf.queryExecution().optimizedPlan()
        todo = [plan]
        while todo:
            p = todo.pop()
            todo += [p.children().apply(i) for i in range(p.children().size())]
            if p.nodeName() == "Join" and "Inner" in p.simpleString(10) and "sid" in p.simpleString(10):
                n["joined"] += int(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, p).count())
        return f(rows, *args)

    with monkeypatch.context() as m:
        m.setattr(near, "in_groups", counted)
        rows = [(i, bytearray(t.astype(np.uint16).tobytes()), [int(x) for x in range(1, 16)]) for i, t in enumerate(tokens)]
        root = {r.node: r.root for r in components(near.loose_links(spark.createDataFrame(rows, "sid long, sig binary, paths array<long>"))).collect()}
    return [root.get(i, i) for i in range(len(tokens))], n["compared"], n["joined"]


def crowd(n, common, far):
    """Tokens of ``n`` sets that share 70 tokens and of ``far`` sets that share 40 of these; the last of either kind share 98."""
    import numpy as np

    r = np.random.default_rng(n)
    tokens = r.integers(1, 2**16, (n + far, near.TOKENS))
    tokens[:n, :70] = common[:70]
    tokens[n:, :40] = common[:40]
    tokens[-1, 30:] = tokens[n - 1, 30:]
    return tokens


def test_rows_of_large_groups(spark, monkeypatch):
    """Rows that are joined and compared grow with the sets of a group, not with their square; a far set is still met by what is near it."""
    import numpy as np

    monkeypatch.setattr(near, "SMALL", 16)
    common = np.random.default_rng(0).integers(1, 2**16, near.TOKENS)
    made = {}
    for n in (100, 400):
        root, compared, joined = loose_of(spark, monkeypatch, crowd(n, common, 8))
        assert len({*root[:n]}) == 1 and root[-1] == root[0] and len({*root[n:]}) == 8
        made[n] = compared, joined
    assert made[400][0] <= 5 * made[100][0] and made[400][1] <= 5 * made[100][1]
    assert made[400][1] <= 3 * 408


def test_many_far_sets(spark, monkeypatch):
    """Sets far from each other on one path are dealt by groups of tokens, and pairs at the threshold meet."""
    import numpy as np

    monkeypatch.setattr(near, "SMALL", 16)
    monkeypatch.setattr(near, "DEPTH", 0)
    common = np.random.default_rng(0).integers(1, 2**16, near.TOKENS)
    r = np.random.default_rng(5)
    tokens = r.integers(1, 2**16, (600, near.TOKENS))
    tokens[:, :32] = common[:32]
    for i in range(0, 600, 2):
        at = r.choice(near.TOKENS, 102, replace=False)
        tokens[i + 1, at] = tokens[i, at]
    compared = {}
    for wide in (10**6, 32):
        monkeypatch.setattr(near, "WIDE", wide)
        root, compared[wide], _ = loose_of(spark, monkeypatch, tokens)
        assert all(root[i] == root[i + 1] for i in range(0, 600, 2)) and len({*root}) == 300
    assert compared[32] < compared[10**6]


def test_shared_items(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    for n, low, high, of in ((2, 1, 5, 8), (5, 0, 50, 100), (40, 10, 300, 400)):
        sets = [np.unique(near.mix(r.integers(0, of, r.integers(low, high + 1)).astype(np.uint64))) for _ in range(n)]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        for part in (200_000, 37):
            monkeypatch.setattr(near, "SLICE_ITEMS", part)
            got = near.shared_items(sets)
            assert all(got[i, j] == want[i, j] for i in range(n) for j in range(n) if i != j)


def test_mix(docs, rows, none):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, _, s, *_ in rows])
    got = sorted(tuple(r) for r in mixing.mix_report(docs).collect())
    want = sorted(db.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall())
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want))
    assert all(x[3] <= 2 * x[2] and x[4] <= 2 * x[1] for x in got)
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(copies[i] * size == taken for i, size, _, _, taken in got if size and i != 300)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    budget = 1.5 * 2110
    level = (budget - 20 - 200) / 3  # a and null are full at twice their size
    assert got["a"] == 20 and got[None] == 200 and abs(got["b"] - level) < 1e-9 and abs(got["c"] - 2 * level) < 1e-9 or got["c"] == 2000
    assert abs(sum(got.values()) - budget) < 1e-6
