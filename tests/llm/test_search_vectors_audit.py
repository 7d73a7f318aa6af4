"""Operators 11 to 13 against plain versions, with nulls, ties, repeated rows, hot groups and clashing columns."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sedimenta.llm.queries")
from sedimenta.llm import audit, search, vectors  # noqa: E402
from sedimenta.llm.common import join_classes  # noqa: E402

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# --- 11 ---


def plain_links(rows, threshold=0.93):
    """rows: (vec_id, label, vector). [(vec_id, n_links, component_id, kept)] by comparing every pair."""

    def fit(label, v):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        (_, la, va), (_, lb, vb) = rows[a], rows[b]
        if fit(la, va) and fit(lb, vb) and la == lb and len(va) == len(vb):
            x, y = np.array(va, float), np.array(vb, float)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(b)] = find(a)
    ids = collections.defaultdict(list)
    for i, (vec_id, _, _) in enumerate(rows):
        ids[find(i)].append(vec_id)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(vec_id, n[i], least[find(i)], vec_id == least[find(i)]) for i, (vec_id, _, _) in enumerate(rows)]


def sort(rows):
    return sorted(rows, key=repr)


def made(spark, rows):
    # columns named like the operator's own
    return spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows], "vec_id long, label int, embedding array<double>, cls string, n int, place double")


def test_vectors_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(260):
        v = centres[i % 6] + rng.normal(size=12) * (0.05, 0.2, 0.5)[i % 3]
        rows.append((i + 5, i % 2, v.tolist()))
    near = rng.normal(size=12)
    rows += [(1000 + i, 7, (near * 3.0**i).tolist()) for i in range(4)]  # equal directions, different lengths
    rows += [(2000 + i, 8, near.tolist()) for i in range(40)]  # one crowd of copies
    rows += [rows[3], rows[3], (None, 0, rows[0][2]), (None, 9, [1.0, 2.0]), (None, 9, [1.0, 2.0]), (3000, 9, [1.0, 2.0, 0.0]), (3001, 9, [1e200, 2e200]), (3002, 9, [1e-200, 2e-200])]
    rows += [(4000, None, rows[0][2]), (4001, 0, None), (4002, 0, []), (4003, 0, [0.0] * 12), (4004, 0, [*rows[0][2][:-1], None]), (4005, 0, [*rows[0][2][:-1], float("nan")]), (4006, 0, [*rows[0][2][:-1], float("inf")]), (4007, 3, [1.0]), (4008, 3, [-1.0])]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(made(spark, rows)).collect()]
    want = [(i, n, c, True if i is None and c is None else k if i is not None else c is None) for i, n, c, k in plain_links(rows)]
    assert sort(got) == sort(want)


@pytest.mark.parametrize("threshold", [0.5, 0.93, 0.999])
def test_pairs_of_tiles(threshold):
    """Every block and chunk boundary: pairs found by suffix bounds are those of the whole product."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 70))
    x = np.concatenate([c + rng.normal(size=(170, 70)) * s for c, s in zip(centres, (0.01, 0.1, 0.3, 1.0))])
    u = vectors.unit(x)
    order = np.argsort(vectors.place(u @ vectors.principal(x)), kind="stable")
    x, u = x[order], u[order]
    cos = u @ u.T
    for basis in (None, vectors.principal(x)):
        got = {(a, b) for i, j in vectors.near_pairs(x, x, basis, threshold, True) for a, b in zip(i.tolist(), j.tolist())}
        assert got == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(cos >= threshold, 1))))}
        got = {(a, b) for i, j in vectors.near_pairs(x[:300], x[300:], basis, threshold, False) for a, b in zip(i.tolist(), j.tolist())}
        assert got == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(cos[:300, 300:] >= threshold)))}


def test_small_tiles_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(60, 5)) * 0.15 for c in rng.normal(size=(5, 5))])
    classes = spark.createDataFrame([(i, "a", 1, v.tolist()) for i, v in enumerate(x)], "cls long, label string, n long, embedding array<double>")
    basis = vectors.basis_of(classes)
    tiles = vectors.tiles_of(classes, basis, tile_rows=7).cache()
    assert tiles.count() >= 300 // 7
    found = vectors.linked(tiles, basis, 0.93).where("n is not null").groupBy("cls").agg(F.sum("n").alias("n")).collect()
    u = vectors.unit(x)
    degree = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert {r["cls"]: r["n"] for r in found} == {i: d for i, d in enumerate(degree.tolist()) if d}


def test_joined():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 400, 330), rng.integers(0, 400, 330)
    root = vectors.joined(np.arange(400), i, j)
    want = list(range(400))

    def find(a):
        while want[a] != a:
            a = want[a]
        return a

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        want[max(a, b)] = min(a, b)
    assert root.tolist() == [find(a) for a in range(400)]


# --- 12 ---


def plain_ranking(docs, items, top=10):
    counted = [(i, collections.Counter(TERMS.findall(lower(t or "")))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, found = collections.Counter(TERMS.findall(lower(text or ""))), []
        for i, c, n in counted:
            m = 100 - 75 + (75 * n * big_n) // big_l
            s = sum(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(120)] + ["Élan", "ÜBER", "x_y", "日本", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: "".join(w + rng.choice(" ,.-\n") for w in rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(1, 90))) for i in range(700)]
    docs += [(800 + i, docs[7][1]) for i in range(60)] + [docs[9], docs[9], (None, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, " .,-_ "), (903, "w1 " * 40_000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(50, docs[7][1]), (51, "w1 w1 w1"), (52, "nowhere"), (53, None), (54, "..."), (55, "W1"), (None, "w2 w3"), (3, "w4"), (3, "w4")]
    return docs, items


@pytest.mark.parametrize("block_docs", [3, 64])
def test_ranking(spark, library, block_docs):
    docs, items = library
    d = spark.createDataFrame([(*r, 1, "s") for r in docs], "doc_id long, text string, score int, terms string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(d, q, block_docs=block_docs).collect()]
    assert sort(got) == sort(plain_ranking(docs, items))


def test_ranking_in_blocks_of_items(spark, library, monkeypatch):
    docs, items = library
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    real = search.blocks_of
    monkeypatch.setattr(search, "blocks_of", lambda b: real(b, block_words=40))
    assert len(search.blocks_of(q)) > 3
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(d, q).collect()]
    assert sort(got) == sort(plain_ranking(docs, items))


def test_bounds_hold_and_blocks_are_passed_over(library):
    """Every score of a block is within its bound; a threshold that the best reach leaves most blocks unscored."""
    docs, items = library
    own = search.Items([t for _, t in items])
    rows = [(i, [(own.number[t], c) for t, c in collections.Counter(search.terms_of(x)).items() if t in own.number]) for i, x in docs[:640]]
    rows = [r for r in rows if r[1]]
    passed = 0
    for at in range(0, len(rows), 8):
        part = rows[at : at + 8]
        terms = [t for _, e in part for t, _ in e]
        impacts = [1000 * c + t for _, e in part for t, c in e]
        starts = np.cumsum([0, *(len(e) for _, e in part)])[:-1]
        block = search.Block({"ids": [i for i, _ in part], "starts": starts, "terms": terms, "impacts": impacts})
        all_terms = sorted(set(terms))
        bounds = own.bounds(np.array(all_terms), np.array([max(i for t, i in zip(terms, impacts) if t == x) for x in all_terms]))
        for q in range(len(own.start)):
            assert own.scores(q, block).max() <= bounds[q]
        passed += int((bounds < np.median(bounds)).sum())
    assert passed


# --- 13 ---


def plain_audit(docs, labels):
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first, parts = {}, collections.defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, source in docs:
        w, t = WORDS.findall(t or ""), t or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[source or ""].append(({f for f, x in fails.items() if x}, i in good, i in bad))
    out = []
    for part, rows in parts.items():
        alone = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                alone[f] += sum(f in x and not x & set(order[:k]) for x, _, _ in rows)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [(g, b) for x, g, b in rows if f in x and not x & set(order[:k])]
                kept = sum(not x & set(order[: k + 1]) for x, _, _ in rows)
                again = sum(f in x and bool(x & set(order[:k])) for x, _, _ in rows)
                out.append((part, "".join(order), k + 1, kept, len(here), again, sum(x == {f} for x, _, _ in rows), sum(g for g, _ in here), sum(b for _, b in here), alone[f]))
    return out


def test_audit(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)] + ["CAPS", "Cap", "x#", "50%", "日本語", "İ"]
    text = lambda n, k: " ".join(rng.choices(vocabulary[:k] if k < 400 else vocabulary, k=n)) + rng.choice(["", "\n", "\t\x0b "])
    docs = [(i, text(rng.choice([3, 150, 199, 200, 201, 450]), rng.choice([40, 100, 406])), rng.choice(["s0", "s0", "s1", "", None])) for i in range(150)]
    docs += [(200 + i, docs[4][1], "s0") for i in range(90)] + [docs[4], docs[4], (None, docs[4][1], "s1"), (None, docs[4][1], "s1"), (None, "only here " * 120, None), (300, None, "s2"), (301, "", "s2"), (302, " \n\t ", "s2"), (303, "word " * 60_000, "s1"), (304, "A" * 100 + " " + "b" * 4900, "s3"), (305, "A" * 101 + " " + "b" * 4898, "s3")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 310, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (6, None, 1), (999, 1, 1)]
    d = spark.createDataFrame([(i, t, s, "m", 1, 2) for i, t, s in docs], "doc_id long, text string, source string, part string, mask int, n long")
    d.repartition(6).write.parquet(f"{tmp_path}/documents")  # the operator numbers rows by their places in files
    d = spark.read.parquet(f"{tmp_path}/documents")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == names and {t for c, t in found.dtypes if c not in names[:3]} == {"bigint"}
    assert sort(tuple(r) for r in found.collect()) == sort(plain_audit(docs, labels))


def test_join_classes_splits_hot_keys(spark):
    """A key with most rows is joined by broadcast and never shuffled; results are those of a plain join."""
    rows = spark.range(12_000).select("id", F.when(F.col("id") % 3 < 2, -1).otherwise(F.col("id") % 500).alias("k"))
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = join_classes(rows, classes, "k")
    assert sort(map(tuple, got.select("id", "k", "first").collect())) == sort(map(tuple, rows.join(classes, "k").select("id", "k", "first").collect()))
