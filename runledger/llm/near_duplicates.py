"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch: a document's shingles are thrown into the sketch's bins in rounds. In the first rounds each shingle picks a bin by
a hash; in as many further rounds all shingles go to the one bin that is due. A bin keeps the least value of the first
round that reached it, and rounds end once every bin is filled, which takes about ``t log t`` throws however small the
set. Bins agree between two sets with the probability of their similarity, and as concentrated as independent minima.

Candidates: bins are cut into bands, as many as bring the chance to miss a pair at the threshold below ``MISS``.

Verification: copies of one shingle set are one class with one representative. Representatives that share a bucket are
first compared with the bucket's smallest one only, on their full sets, so that a bucket with very many documents costs as
many comparisons as it has documents. What is then left in different components of a bucket may still be linked: these
representatives are gathered by the buckets they share and compared within pairs of blocks of bounded size, those that
share a band and are not joined yet on their full sets. A pair of blocks is a group of its own, and yields links only.
A representative that is compared with very many is split into many groups.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import components, staged, table

WORDS = 5
THRESHOLD = 80  # in 100; the similarity from which documents are linked
ROWS = 6  # bins in a band
MISS = 1e-7
# Comparisons with one representative that make a group of their own.
GROUP = 128
# Representatives in a block.
BLOCK = 192

_SIGNED = "row long, doc_id long, n_shingles long, set_high long, set_low long, bands array<long>"


def bands_for(threshold: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((threshold / 100) ** rows)))


@functools.cache
def _keys(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The set of hashes of a text's shingles, sorted; with fewer words, that of all words; without any, empty."""
    words = (text or "").encode().lower().split()  # of bytes: A to Z only, and white space as in SPACES
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    keys = _keys(width, 5)
    if len(words) < width:
        return mixed(np.array([(hashes * keys[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    n = len(words) - width + 1
    total = hashes[:n] * keys[0]
    for i in range(1, width):
        total += hashes[i : i + n] * keys[i]
    return np.unique(mixed(total))


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a set that is not empty."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(bins, bool)
    keys = _keys(2 * bins, 7)
    for turn in range(2 * bins):
        values = mixed(elements ^ keys[turn])
        if turn < bins:
            places = (mixed(values + keys[turn]) >> np.uint64(32)) % np.uint64(bins)
            wanted = empty[places]
            places, values = places[wanted], values[wanted]
            np.minimum.at(out, places, values)
            empty[places] = False
        elif empty[turn - bins]:
            out[turn - bins], empty[turn - bins] = values.min(), False
        if not empty.any():
            break
    return out


def band_keys(elements: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    grouped = sketch(elements, bands * rows).reshape(bands, rows)
    return mixed((grouped * _keys(rows, 11)).sum(1, dtype=np.uint64) ^ _keys(bands, 13)).view(np.int64)


def signatures(docs: DataFrame, bands: int, width: int = WORDS) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SIGNED.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text in batch["text"]:
                found = shingles(text.as_py(), width)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                high, low = np.frombuffer(digest, np.int64).tolist()
                for column, value in zip(out, (len(found), high, low, band_keys(found, bands) if len(found) else None), strict=True):
                    column.append(value)
            columns = [batch["row"], batch["doc_id"], *out]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("row", "doc_id", "text").mapInArrow(sign, _SIGNED)


def verified(pairs: DataFrame, docs: DataFrame, threshold: int, width: int = WORDS) -> DataFrame:
    """Those of the pairs (a, b: rows of ``docs``) whose full sets reach the threshold.

    The pairs of one ``b`` meet its text in groups of about ``GROUP``; a group is read as a stream with the text of
    ``b`` first.
    """
    spare = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("groups"))
    spare = staged(spare)
    texts = docs.select("row", "text")
    others = pairs.join(spare, "b").join(texts.withColumnRenamed("row", "a"), "a")
    others = others.select("b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("group"), "a", "text")
    heads = spare.join(texts.withColumnRenamed("row", "b"), "b")
    heads = heads.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), F.lit(None).cast("long").alias("a"), "text")
    rows = others.unionByName(heads).repartition("b", "group").sortWithinPartitions("b", "group", F.col("a").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            links: list[tuple[int, int]] = []
            for a, b, text in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["text"], strict=True):
                found = shingles(text.as_py(), width)
                if a is None:
                    own = found
                    continue
                shared = len(np.intersect1d(own, found, assume_unique=True))
                if 100 * shared >= threshold * (len(own) + len(found) - shared):
                    links.append((a, b))
            yield pa.record_batch({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return staged(rows.mapInArrow(compare, "a long, b long"))


def joined_within(rows: pa.Table, threshold: int, width: int) -> list[tuple[int, int]]:
    """Links between a group's two blocks (or within one) that join what is apart, of pairs that share a band."""
    node, own, n, block = (rows[c].to_numpy() for c in ("node", "own", "n", "block"))
    bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    texts = rows["text"].to_pylist()
    sets: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def full(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(texts[k], width)
        return sets[k]

    low, high = block.min(), block.max()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    links = []
    for x in left:
        apart = right[(own[right] != own[x]) & ((low != high) | (node[right] > node[x]))]
        alike = 100 * np.minimum(n[apart], n[x]) >= threshold * np.maximum(n[apart], n[x])
        apart = apart[alike]
        apart = apart[(bands[apart] == bands[x]).any(1)]
        apart = np.array([y for y in apart.tolist() if root(int(own[y])) != root(int(own[x]))], np.int64)
        if not len(apart):
            continue
        mine = full(int(x))
        others = [full(y) for y in apart.tolist()]
        flat = np.concatenate(others)
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        sizes = np.array([len(o) for o in others])
        shared = np.add.reduceat(mine[at] == flat, np.cumsum([0, *sizes[:-1]]), dtype=np.int64)
        for y in apart[100 * shared >= threshold * (len(mine) + sizes - shared)].tolist():
            a, b = root(int(own[x])), root(int(own[y]))
            if a != b:
                parent[a] = b
                links.append((int(node[x]), int(node[y])))
    return links


def remaining_links(members: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """Links among ``members`` (bucket, node, n, own) that have different ``own`` and share a bucket."""
    heads = staged(members.groupBy("bucket").agg(F.min("node").alias("head")))
    gathered = components(members.join(heads, "bucket").select(F.col("node").alias("a"), F.col("head").alias("b")))
    nodes = staged(members.select("node", "n", "own").distinct().join(gathered.withColumnRenamed("component", "cluster"), "node"))
    blocks = staged(nodes.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")))
    nodes = nodes.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    nodes = nodes.join(classes.select("node", "bands"), "node").join(docs.select(F.col("row").alias("node"), "text"), "node")
    pairs = nodes.select("cluster", "node", "n", "own", "block", "bands", "text", other)
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compare(rows: pa.Table) -> pa.Table:
        links = joined_within(rows, threshold, width)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return staged(pairs.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = WORDS, stored: bool = False, own: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row, doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have at least ``threshold`` hundredths of their union in common are linked; a component
    is named after its smallest doc_id. Null, empty and wordless texts are linked with nothing. Rows that repeat a text are
    linked; ``kept`` goes by doc_id, so rows that repeat a doc_id share it. A null doc_id names no component: a component
    of such rows alone keeps them all. No rows give no rows. ``stored`` tells that ``docs`` has a stored column ``row``;
    ``own`` adds the column ``component``, a number that no two components share (null where there are no shingles).
    """
    docs = docs if stored else staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    signed = staged(signatures(docs, bands_for(threshold), width))
    key = ["n_shingles", "set_high", "set_low"]
    full = signed.where("n_shingles > 0")
    # One row for each different set, which has the bands of any of its copies.
    classes = staged(full.groupBy(*key).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")))

    bucket = F.posexplode("bands").alias("band", "value")
    members = classes.select("node", F.col("n_shingles").alias("n"), bucket).select(F.xxhash64("band", "value").alias("bucket"), "node", "n")
    heads = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size"))
    heads = staged(heads.where("size > 1").select("bucket", "head"))
    members = staged(members.join(heads, "bucket").select("bucket", "node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")))

    def alike(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * threshold

    pairs = members.where((F.col("node") != F.col("head")) & alike("n", "head_n")).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    pairs = staged(pairs)
    links = verified(pairs, docs, threshold, width)
    joined = components(links)

    # Members of a bucket that are still apart.
    placed = members.join(joined.withColumnRenamed("component", "joined"), "node", "left").select("bucket", "node", "n", F.coalesce("joined", "node").alias("own"))
    placed = staged(placed)
    split = staged(placed.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("bucket"))
    open_members = staged(placed.join(split, "bucket"))
    joined = components(links.unionByName(remaining_links(open_members, classes, docs, threshold, width)))

    named = classes.join(joined, "node", "left").select(*key, "least", F.coalesce("component", "node").alias("component"))
    named = staged(named)
    ids = staged(named.groupBy("component").agg(F.min("least").alias("component_id")))
    more = ["component"] if own else []
    named = staged(named.join(ids, "component").select(*key, "component_id", *more))
    out = signed.select("row", "doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), *more).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group of near duplicates, with all columns: the smallest doc_id's, and of its rows the first.

    A group is told by its component, not by its doc_id, so unlike groups whose rows repeat a doc_id keep a row each, and
    of copies without a doc_id one stays. Texts without shingles are like no other and all stay.
    """
    marked = staged(docs.withColumn("near row", F.monotonically_increasing_id()))
    narrow = marked.select(F.col("near row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = near_duplicates(narrow, threshold, stored=True, own=True)
    alone = found.where("component is null").select("row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = found.where("component is not null").groupBy("component").agg(F.min(order)["row"].alias("row")).select("row")
    rows = alone.unionByName(first).withColumnRenamed("row", "near row")
    return marked.join(rows, "near row").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85).drop("row")
