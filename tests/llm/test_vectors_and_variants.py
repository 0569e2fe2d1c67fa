"""Clusters, inner products and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runledger.llm import inner_product_search, spelling_variants, vector_clusters

VECTORS = "vec_id long, embedding array<double>, label string, v string, row string, cells string, cluster string"


def whole(vector):
    return [int(np.floor(1024 * x)) for x in vector]


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", "x") for i, v in rows], VECTORS)


def unsound(size):
    nan, inf = float("nan"), float("inf")
    return [(1000, None), (1100, [nan] * size), (1200, [inf] + [0.0] * (size - 1)), (1300, [None] + [0.0] * (size - 1)), (1400, [-inf] * size)]


# Clusters


def brute_clusters(rows, k, rounds, size, seed):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, c) in zip(kept, assign()):
            groups[c].append(v)
        for c, vectors in groups.items():
            centroids[c] = [sum(column) // len(vectors) for column in zip(*vectors)]
    found = assign()
    inertia = Counter()
    for far, c in found:
        inertia[c] += far
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, c, far, inertia[c], sum(inertia.values()), hashes[c]) for (i, _), (far, c) in zip(kept, found)), key=repr
    )


def clustered(dice, n, size, centres=6):
    middles = [[dice.gauss(0, 1) for _ in range(size)] for _ in range(centres)]
    return [(i, [m + dice.gauss(0, 0.05) for m in middles[i % centres]]) for i in range(n)]


@pytest.mark.parametrize("size", [1, 3, 16])
def test_clusters_equal_brute_force(spark, size):
    dice = random.Random(size)
    rows = clustered(dice, 240, size)
    rows += [(i, [dice.choice([-0.5, 0.0, 0.25]) for _ in range(size)]) for i in range(300, 360)]  # many ties and copies
    rows += [*rows[:5], (None, rows[7][1]), *unsound(size), (2000, [0.0] * (size + 1)), (2001, [])]
    got = vector_clusters.clusters(frame(spark, rows).repartition(3), 8, 4, size, "3")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, 8, 4, size, "3")


def test_clusters_of_few_equal_and_no_vectors(spark):
    few = [(i, [1.0, 2.0]) for i in range(5)]
    got = vector_clusters.clusters(frame(spark, few), 8, 2, 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute_clusters(few, 8, 2, 2, "3")
    for rows in ([], unsound(2)):
        assert vector_clusters.clusters(frame(spark, rows), 8, 2, 2).count() == 0


def test_bounds_never_exceed_distances_and_settle_most_of_them():
    dice = random.Random(9)
    vectors = np.array([whole(v) for _, v in clustered(dice, 1500, 32)], np.int64)
    pivots = vectors[:6]
    to_pivots = np.sqrt(np.stack([vector_clusters.distances(vectors, p) for p in pivots], 1).astype(float))
    for centroids in (pivots, np.stack([vectors[i::6].sum(0) // len(vectors[i::6]) for i in range(6)]), vectors[30:42]):
        exact = np.stack([vector_clusters.distances(vectors, c) for c in centroids], 1)
        between = np.sqrt(np.stack([vector_clusters.distances(centroids, p) for p in pivots], 1).astype(float))
        bounds = vector_clusters.lower_bounds(to_pivots, between, vector_clusters.pivot_pairs(pivots))
        assert (bounds**2 <= exact + 1e-6).all()
        cluster, best, measured = vector_clusters.nearest(vectors, to_pivots, centroids, pivots)
        assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
        assert measured < 0.5 * exact.size


def test_very_large_components_are_bounded(spark):
    rows = [(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [1e300, -1e299])]
    got = {r["vec_id"]: r for r in vector_clusters.clusters(frame(spark, rows), 2, 3, 2).collect()}
    assert got[1]["cluster"] == got[3]["cluster"] != got[2]["cluster"] and got[1]["distance"] == 0
    assert inner_product_search.search(frame(spark, [(100, [1e300]), (1, [1e300])])).first()["score"] == 2**52


# Inner products


def brute_search(rows, k):
    kept = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(kept):
        if q is not None and q % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for n, (i, w) in enumerate(kept) if n != at]
            best = sorted(scored, key=lambda s: s[:3])[:k]
            out += [(q, rank + 1, s[3], -s[0]) for rank, s in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_search_equals_brute_force(spark, block, monkeypatch):
    dice = random.Random(block)
    rows = [(i, [dice.gauss(0, 0.2) if dice.random() < 0.3 else 0.0 for _ in range(12)]) for i in range(0, 1200, 4)]
    rows += [(i, [float(dice.randint(-1, 1)) for _ in range(dice.choice([3, 12]))]) for i in range(3001, 3060)]  # ties
    rows += [(5000, [0.0] * 12), (6000, []), (None, [1.0] * 12), *unsound(12)]
    monkeypatch.setattr(inner_product_search.top_products, "__defaults__", (10, block))
    got = inner_product_search.search(frame(spark, rows).repartition(3))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows, 10)


def test_search_of_few_and_no_rows(spark):
    for rows in ([], [(100, [1.0])], [(1, [1.0])], [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None)], unsound(2)):
        got = inner_product_search.search(frame(spark, rows)).collect()
        assert sorted(map(tuple, got), key=repr) == brute_search(rows, 10)
    # Rows that repeat an id are queries and candidates of their own.
    twice = inner_product_search.search(frame(spark, [(100, [1.0]), (100, [2.0])])).collect()
    assert sorted(map(tuple, twice)) == [(100, 1, 100, 2 << 20), (100, 1, 100, 2 << 20)]


# Spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs):
    words = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    words = brute_words(docs)
    near = {w: sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 5 * words[w] else None for w in words}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def spelled(dice):
    stems = ["language", "encyclopedia", "façade", "Écoleélève", "mañanas", "Straßenbahn", "sss×sss", "aaaaaa", "committee"]
    letters = "abelnséßÿ"
    docs, words = [], []
    for stem in stems:
        words += [stem] * 700 + [stem.upper()] * 5
        for times in (120, 20, 6, 5, 4):
            for _ in range(3):
                w, i, kind = stem, dice.randrange(len(stem) + 1), dice.randrange(3)
                w = w[:i] + w[i + 1 :] if kind == 0 else w[:i] + dice.choice(letters) + w[i + (kind == 1) :]
                words += [w] * times
    # A chain of forms: each six times as frequent as the one before.
    for n, w in zip((5, 30, 180, 1080), ("abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm")):
        words += [w] * n
    dice.shuffle(words)
    for i in range(0, len(words), 37):
        docs.append((i, dice.choice([" ", "-", "œ", " ", "1"]).join(words[i : i + 37])))
    return docs


@pytest.mark.parametrize("symbols", [2, 5, None])
def test_variants_equal_brute_force(spark, symbols, monkeypatch):
    docs = spelled(random.Random(symbols or 1)) + [(None, "language committee"), (None, None), (7, None), (8, ""), (9, "1 2 3")]
    rows = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in docs], "doc_id long, text string, word string, n string, code string, around string")
    got = spelling_variants.variants(rows.repartition(3), symbols).collect()
    want = brute_variants(docs)
    assert {r["word"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(r["form"] for r in got) and any(r["form"] and r["root"] != r["form"] for r in got)


def test_no_words(spark):
    for docs in ([], [(1, None), (2, "")], [(1, "once only")]):
        assert spelling_variants.variants(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_very_long_texts_are_split_between_runs(monkeypatch):
    dice = random.Random(2)
    text = "".join(dice.choice("abCéÉœ€ \U0001f600×z") for _ in range(20_000))
    whole_text = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), r) for r in RUN.findall(text))
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(spelling_variants, "PIECE", piece)
        total = sum(spelling_variants.runs(text.encode()), Counter())
        assert {w.decode(): n for w, n in total.items()} == whole_text
    # One run without an end is a piece.
    monkeypatch.setattr(spelling_variants, "PIECE", 10)
    assert sum(spelling_variants.runs(b"a" * 5000), Counter()) == {b"a" * 5000: 1}


def test_task_dictionaries_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 10)
    docs = spelled(random.Random(3))
    got = spelling_variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).where("n >= 5").collect()
    assert {r["word"]: r["n"] for r in got} == brute_words(docs)


def test_neighbourhoods_are_whole(spark):
    word = "abcab"
    got = set(spark.range(1).select(spelling_variants.neighbourhood(F_lit(word), 3).alias("a")).first()["a"])
    want = {word[:i] + word[i + 1 :] for i in range(5)}
    want |= {word[:i] + s + word[i + 1 :] for i in range(5) for s in "abc"} | {word[:i] + s + word[i:] for i in range(6) for s in "abc"}
    assert got == want


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
