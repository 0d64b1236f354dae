"""Embedding near-duplicates, hard negatives and ranked lexical search against brute force, with their edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from texlake.llm import embedding_dedup as E
from texlake.llm import hard_negatives as H
from texlake.llm import lexical_search as L

VECTORS = "vec_id long, label int, embedding array<float>"


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame(rows, schema)


def near(seed, groups, each, alone, width=16, spread=0.08, label=lambda g: g % 3):
    """Groups of near vectors and single ones: (id, label, vector)."""
    random = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = random.standard_normal(width)
        out += [(label(g), centre + spread * random.standard_normal(width)) for _ in range(each)]
    out += [(label(int(random.integers(9))), random.standard_normal(width)) for _ in range(alone)]
    order = random.permutation(len(out))
    return [(int(k), out[j][0], [float(x) for x in np.float32(out[j][1])]) for k, j in enumerate(order)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine):
    good = [(k, label, np.array(v, np.float64)) for k, (_, label, v) in enumerate(rows) if label is not None and usable(v)]
    width = max([len(v) for _, _, v in good], default=0)
    m = np.array([np.pad(v, (0, width - len(v))) for _, _, v in good]).reshape(len(good), width)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T >= cosine
    out = []
    for a in range(len(good)):
        out += [(good[a][0], good[b][0]) for b in np.flatnonzero(close[a]) if b > a and good[a][1] == good[b][1]]
    return out


def brute_groups(rows, cosine):
    least, n = list(range(len(rows))), Counter()

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in brute_links(rows, cosine):
        n[a] += 1
        n[b] += 1
        least[max(root(a), root(b))] = min(root(a), root(b))
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[root(k)].append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], n[k], smallest[root(k)], r[0] == smallest[root(k)]) for k, r in enumerate(rows))


def groups(df):
    return Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.mark.parametrize("cell, dense", [(2048, 8), (24, 8), (24, 2), (2048, 2)])
def test_near_duplicates(spark, monkeypatch, cell, dense):
    monkeypatch.setattr(E, "DENSE", dense)
    rows = near(1, 12, 14, 150)
    # a group that is a third of all, some copies, other scales of one vector
    rows += [(1000 + k, 1, [float(x) for x in np.float32(np.array(rows[5][2]) + 0.004 * np.random.default_rng(k).standard_normal(16))]) for k in range(120)]
    rows += [(2000 + k, rows[7][1], rows[7][2]) for k in range(9)] + [(3000, rows[7][1], [4 * x for x in rows[7][2]]), (3001, None, rows[7][2])]
    assert groups(E.near_duplicates(vectors(spark, rows), 0.93, cell=cell)) == brute_groups(rows, 0.93)


def test_near_duplicates_edges(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(5, 1, one), (5, 1, one), (None, 1, one), (7, None, one), (8, 1, None), (9, 1, []), (10, 1, [0.0, 0.0]), (11, 1, [1.0, None, 0.5]), (12, 1, [float("nan"), 1.0]), (13, 1, [float("inf"), 1.0]), (14, 2, one), (15, 1, [1.0, -0.0, 0.5, 0.0]), (None, 3, [2.0]), (None, None, one), (16, 1, [1e-38, 0.0, 5e-39]), (17, 1, [1e38, 0.0, 5e37])]
    extra = vectors(spark, rows).withColumns({"no": F.lit("x"), "unit": F.lit(1), "key": F.lit(2), "lead": F.lit(3), "copies": F.lit(4), "cell": F.lit(5)})
    got = groups(E.near_duplicates(extra, 0.93))
    want = Counter({(5, 5, 5, True): 2, (None, 5, 5, False): 1, (15, 5, 5, False): 1, (16, 5, 5, False): 1, (17, 5, 5, False): 1, (None, 0, None, True): 2})
    want.update((k, 0, k, True) for k in (7, 8, 9, 10, 11, 12, 13, 14))
    assert got == want
    assert E.near_duplicates(vectors(spark, []), 0.93).count() == 0
    assert groups(E.near_duplicates(vectors(spark, [(1, None, one)]), 0.93)) == Counter({(1, 0, 1, True): 1})
    with pytest.raises(ValueError):
        E.near_duplicates(vectors(spark, rows), 0.4)


def test_counts_keep_pairs_at_the_threshold():
    """Pairs of exactly the threshold's cosine: the share that collide often enough, and that meet in a cell."""
    random, cosine, n = np.random.default_rng(3), 0.93, 3000
    x = random.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = random.standard_normal((n, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    found = sum(len(E.collisions(x[k : k + 1], y[k : k + 1], cosine)[0]) for k in range(n))
    assert found >= 0.999 * n
    far = sum(len(E.collisions(x[k : k + 1], x[k + 1 : k + 2], cosine)[0]) for k in range(n - 1))
    assert far <= 0.05 * n
    for cuts in (1, 4, 12):
        window = E.cut_window(cosine, cuts)
        h, g = (v @ E.projections(64, 1, E.CUTS)[:, :cuts] for v in (x, y))
        apart = (h > 0) != (g > 0)
        meets = (~apart | (np.abs(h) <= window)).all(axis=1) | (~apart | (np.abs(g) <= window)).all(axis=1)
        assert meets.mean() >= 0.985


def test_spanning_links():
    a, b = np.array([9, 3, 7, 20]), np.array([3, 5, 5, 21])
    assert sorted(zip(*(x.tolist() for x in E._spanning(a, b)))) == [(5, 3), (7, 3), (9, 3), (21, 20)]


def brute_negatives(rows, anchors, positives, negatives, low, high):
    clean = lambda table: [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in table if None not in (i, label) and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows, out = clean(rows), []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in clean(anchors):
        others = sorted((-score(v, w), j, m) for j, m, w in rows if j != i)
        for p, j, _ in [x for x in others if x[2] == label][:positives]:
            hard = [x for x in others if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(hard)]
    return Counter(out)


@pytest.mark.parametrize("sample, fanout, leaf_rows, block", [(4096, 16, 1024, 2048), (40, 3, 8, 5), (9, 2, 4, 100)])
def test_hard_negatives(spark, sample, fanout, leaf_rows, block):
    rows = near(2, 6, 8, 120, width=8, spread=0.5)
    rows += [(500 + k, 1, rows[3][2]) for k in range(60)] + [(500, 2, rows[3][2])]
    anchors = [r for r in rows if r[0] % 10 == 0]
    got = H.hard_negatives(vectors(spark, rows), vectors(spark, anchors), positives=4, negatives=6, sample=sample, fanout=fanout, leaf_rows=leaf_rows, block=block)
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows, anchors, 4, 6, 30, 90)


def test_hard_negatives_edges(spark):
    rows = [(1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.9, 0.4]), (3, 2, [0.8]), (4, 2, [0.5, 0.5, 0.0]), (5, None, [0.5, 0.5]), (None, 2, [0.5, 0.5]), (6, 2, None), (7, 2, [None, 1.0]), (8, 2, [float("nan")]), (9, 1, [-1.0, 0.0]), (10, 3, []), (11, 4, [0.7, 0.1]), (12, 4, [0.0, 0.0])]
    extra = vectors(spark, rows).withColumns({"q": F.lit("x"), "leaf": F.lit(1), "low": F.lit(2), "high": F.lit(3), "vector": F.lit(4), "piece": F.lit(5)})
    got = H.hard_negatives(extra, extra, positives=2, negatives=3)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, rows, 2, 3, 30, 90)
    assert H.hard_negatives(vectors(spark, []), vectors(spark, rows)).count() == 0
    assert H.hard_negatives(vectors(spark, rows), vectors(spark, [])).count() == 0
    assert H.hard_negatives(vectors(spark, rows[:2]), vectors(spark, rows[:2])).count() == 0


def test_tree_reaches_every_row_in_the_annulus():
    random = np.random.default_rng(5)
    rows = random.integers(-200, 200, (400, 6))
    greatest = float((rows.astype(float) ** 2).sum(axis=1).max()) + 1
    x = H.on_sphere(rows, greatest)
    tree, ranges = H.Tree(x[:60], 4, 5), {}
    leaf = tree.place(x, ranges)
    tree.know([(*k, *v) for k, v in ranges.items()])
    visited = 0
    for q in rows[:40]:
        s = rows @ q
        low, high = int(np.quantile(s, 0.9)), int(np.quantile(s, 0.97))
        square = float((q.astype(float) ** 2).sum()) + greatest
        reached = {a for a, _ in tree.walk(np.concatenate([[0.0], q])[None, :], np.sqrt(np.maximum([square - 2 * high], 0)), np.sqrt(np.maximum([square - 2 * low], 0)), 1e-6)}
        assert set(leaf[(s >= low) & (s <= high)].tolist()) <= reached
        visited += len(reached)
    assert visited < 40 * tree.leaves  # some are left out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    counts = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(low(text))) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return Counter(out)


def ranks(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def texts(seed, n, most):
    random = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünïk", "日本", "a_b", "X-y", "42"]
    return [" ".join(words[min(64, int(random.zipf(1.4)))] for _ in range(random.integers(0, most))) for _ in range(n)]


@pytest.mark.parametrize("block, k", [(4096, 50), (7, 5)])
def test_ranked_search(spark, monkeypatch, block, k):
    monkeypatch.setattr(L, "BLOCK_DOCS", block)
    docs = [(j, t) for j, t in enumerate(texts(1, 300, 60))] + [(3, "w1 w2"), (None, "W1 w3"), (None, "w1 w3"), (900, None), (901, ""), (902, "--- !")]
    docs += [(1000 + j, "w1 w2 common passage") for j in range(150)]  # one length, many ties
    items = [(j, t) for j, t in enumerate(texts(2, 20, 25))] + [(0, "w1 W1, w2"), (None, "w5"), (30, None), (31, "nowhere"), (32, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "m", "terms", "counts", "body", "piece")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("q", "term", "body")})
    assert ranks(L.ranked_search(frame, asked, k=k)) == brute_ranks(docs, items, k)


def test_ranked_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "TERM_BYTES", 600)
    docs, items = [(j, t) for j, t in enumerate(texts(3, 80, 30))], [(f"i{j}", t) for j, t in enumerate(texts(4, 15, 20))]
    got = L.ranked_search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string"), k=10)
    assert ranks(got) == brute_ranks(docs, items, 10)


def test_ranked_search_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    one, two = spark.createDataFrame([(1, "a b")], docs), spark.createDataFrame([(2, "a")], items)
    none = lambda schema: spark.createDataFrame([], schema)
    assert [L.ranked_search(a, b).count() for a, b in ((none(docs), two), (one, none(items)), (one, two), (none(docs), none(items)))] == [0, 0, 1, 0]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(k).count("1") & 1) ^ flip] for k in range(n))


def test_terms_of_one_hash_are_two(spark):
    """Words that every polynomial hash modulo 2^64 takes for one, and texts that are cut into parts."""
    x, y = thue_morse(2048), thue_morse(2048, True)
    found = L.Dictionary([x.encode(), y.encode(), b"c"])
    low = np.frombuffer(f"{y} {x} c d".encode(), np.uint8)
    _, starts, ends, _ = L.terms_of(low, np.array([0, len(low)]))
    assert found.find(low, starts, ends).tolist() == [1, 0, 2, -1]
    docs, items = [(1, x), (2, y), (3, "word " * 1_500_000 + "z" * 5_000_000 + " last"), (4, "other")], [(1, x), (2, y), (3, "last word")]
    got = L.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranks(got) == brute_ranks(docs, items, 50)


def test_long_words_of_one_polynomial_stay_apart(spark):
    from texlake.llm.jaccard_join import jaccard_groups

    docs = spark.createDataFrame([(1, thue_morse(2048)), (2, thue_morse(2048, True)), (3, thue_morse(2048).upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs, width=4, num=85, den=100).collect()} == {1: 1, 2: 2, 3: 1}
