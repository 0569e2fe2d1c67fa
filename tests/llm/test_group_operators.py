"""Near duplicates of texts and vectors, components, mixing and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from runledger.llm import mixing, near_duplicates, packing, vector_duplicates
from runledger.llm.common import components, staged

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    dice = random.Random(4)
    links = [(i, i + 1) for i in range(100, 220)] + [(0, i) for i in range(1, 60)] + [(300, 301), (301, 302), (302, 300), (301, 300), (5, 5)]
    links += [(dice.randint(400, 900), dice.randint(400, 900)) for _ in range(300)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = roots({x for pair in links if pair[0] != pair[1] for x in pair}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Texts


def shingle_set(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts, threshold):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates_equal_brute_force(spark, threshold):
    dice = random.Random(2)
    word = lambda: dice.choice("abcdefghij") + str(dice.randint(0, 300))
    texts = {}
    for group in range(12):
        base = [word() for _ in range(dice.choice([3, 8, 60, 150]))]
        for _ in range(dice.choice([1, 2, 9, 30])):
            copy = list(base)
            for _ in range(dice.choice([0, 0, 1, 2, 4])):
                copy[dice.randrange(len(copy))] = word()
            texts[len(texts) * 3] = " ".join(copy).upper() if dice.random() < 0.2 else "\n".join(copy)
    texts |= {1: None, 4: "", 7: " \t", 10: "", 13: "one two", 16: "ONE  two"}
    docs = spark.createDataFrame([(k, t, "r", 1) for k, t in texts.items()], "doc_id long, text string, row string, bands int")
    sets, want = brute(texts, threshold)
    got = near_duplicates.near_duplicates(docs.repartition(3), threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(sets[k]), want[k], want[k] == k) for k in texts}


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "x y"), (None, None), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, row string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, True)] * 2 + [(2, 1, False), (None, 1, False)] + [(None, None, True)] * 2 + [(3, 3, True)] * 2)
    left = near_duplicates.distinct_documents(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, "a b c d e f"), (None, "x y"), (None, None), (3, None), (3, None)])
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_unlike_texts_of_one_doc_id_all_stay(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "p q r s t"), (None, "p q r s t"), (None, None), (3, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, r.text) for r in near_duplicates.distinct_documents(docs).collect())
    assert left == Counter([(1, "a b c d e f"), (1, "u v w x y z"), (None, "p q r s t"), (None, None), (3, " ")])


def test_many_pairs_with_one_document_are_many_groups(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GROUP", 4)
    base = [f"w{i}" for i in range(200)]
    texts = {0: " ".join(base)} | {i: " ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(1, 60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in near_duplicates.near_duplicates(docs).collect()} == {0}


def test_sketch_agrees_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (3, 40, 1000):
        a, b = pool[:n], pool[n // 4 : n // 4 + n]
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean(near_duplicates.sketch(a, 2000) == near_duplicates.sketch(b, 2000))
        assert abs(same - alike) < (0.2 if n == 3 else 0.06)
        assert (near_duplicates.sketch(a, 300) != np.iinfo(np.uint64).max).all()


# Vectors


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_duplicates, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    some = [base[i % 40] + rng.normal(scale=0.22 * rng.random(), size=24) for i in range(400)] + [base[3] + rng.normal(scale=0.05, size=24) for _ in range(150)]
    vectors = [v.astype(np.float32).tolist() for v in some] + [[1.0] * 24, [2.0] * 24, [1.0] * 24, [0.0] * 24, [math.nan, *[1.0] * 23], [math.inf, *[1.0] * 23], [1e-30] * 24, [1.0, 2.0], []]
    rows = [(i, v, "u") for i, v in enumerate(vectors)] + [(9001, None, "u"), (9002, [None, *[1.0] * 23], "u"), (None, [1.0] * 24, "u")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, unit string")
    ok = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and len(v) == 24 and np.isfinite(v).all() and any(v)}
    units = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    ids = [i for i in units if i is not None]
    matrix = np.array([units[i] for i in ids])
    near = matrix @ matrix.T >= 0.95
    links = [(ids[x], ids[y]) for x, y in zip(*np.nonzero(near), strict=True) if x < y]
    want = roots([r[0] for r in rows if r[0] is not None], links)
    extra = {i: bool(units[i] @ units[None] >= 0.95) for i in ids}
    count = Counter(x for pair in links for x in pair)
    got = vector_duplicates.near_vectors(table.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id] + extra.get(r.vec_id, False), want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert vector_duplicates.near_vectors(table.limit(0)).count() == 0
    assert vector_duplicates.near_vectors(table.where("vec_id = 9001")).collect()[0].kept


def test_tables_are_calibrated_to_the_recall():
    for signs in (2, 8, 14):
        tables = vector_duplicates.calibrated(signs, 0.95)
        assert tables > vector_duplicates.calibrated(signs, 0.99)
        rng = np.random.default_rng(1)
        x = rng.normal(size=(300, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        other = rng.normal(size=(300, 32))
        other -= (other * x).sum(1)[:, None] * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * other / np.linalg.norm(other, axis=1)[:, None]
        (a, p), (b, q) = (vector_duplicates.projected(v, tables, signs) for v in (x, y))
        met = ((a == b) & (np.abs(p - q) <= vector_duplicates.window(0.95))).sum(1)
        assert (met >= vector_duplicates.NEEDED).mean() > 0.99


# Mixing


def shared_out(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(order):
        total = sum(w for s, w in weights.items() if s not in full)
        for s in order:
            if s not in full:
                target[s] += left * weights[s] / total
        over = {s for s in order if s not in full and target[s] >= 2 * sizes[s]}
        left = sum(target[s] - 2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2.0 * sizes[s]
        full |= over
        if not over:
            break
    return target


def test_targets_and_taken_words(spark):
    dice = random.Random(6)
    rows = [(i, " ".join(["w"] * dice.choice([1, 5, 40, 200])), dice.choice(["a", "a", "a", "b", "c", "d", None]), "z") for i in range(1500)]
    rows += [(5000, None, "a", "z"), (5001, "", "e", "z"), (None, "no id", "b", "z")] + [(77777, "same text here", "b", "z")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want, got = shared_out(sizes), mixing.mix(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or r.copies in (math.floor(rate), math.floor(rate + 1 - 1e-9))
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


# Pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, staged(stage(spark, kept, SF))
        assert kept.columns == columns, name
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, kept))
        assert set(new) <= set(old)
        if name == "near_duplicates":
            _, root = brute(old, near_duplicates.THRESHOLD)
            assert set(new) == {k for k, r in root.items() if k == r}
        if name == "personal_data":
            assert set(new) == set(old) and not any("@mail" in t for t in new.values() if t)
    packed = corpus_pipeline.pack(spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == packed.columns and run.count() == packed.count()
    assert packing.CAPACITY == 2048
