"""Near-duplicate vectors by counting collisions of sorted one-dimensional projections.

A vector is projected on many random directions. A table is a few of them: the signs of all but one deal vectors into
buckets, and within a bucket vectors are sorted by the last; a pair collides in a table if it shares a bucket and lies in
each other's window there. So a vector meets only those around it, in many different orders, and the number of tables a
pair collides in tells near pairs from chance. How many tables there are, and how many collisions a pair needs, follows
from the share of near pairs to be found (``RECALL``) at the threshold itself, where they are hardest to find. Pairs that
pass are verified in double precision.

Copies of one vector are one class, compared once. A bucket is read as blocks of at most ``BLOCK`` classes, and a pair of
blocks that windows can reach is one group of rows, so that a bucket with a third of all vectors is many groups; pairs are
counted and joined within a group and never written. A pair that collides in several tables is handled in the first.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import components, staged, table

THRESHOLD = 0.95
RECALL = 0.99999
# Collisions a pair needs.
NEEDED = 2
# Half a window, in standard deviations of the difference of two vectors at the threshold.
REACH = 2.0
# Vectors that a bucket holds on average; the number of signs follows from it and the number of vectors.
PER_BUCKET = 128
MAX_SIGNS = 24
BLOCK = 512


def calibrated(signs: int, threshold: float, recall: float = RECALL, needed: int = NEEDED) -> int:
    """Tables needed so that a pair at the threshold collides ``needed`` times with the chance ``recall``."""
    one = (1 - math.acos(threshold) / math.pi) ** signs * (2 * NormalDist().cdf(REACH) - 1)
    tables = needed
    while sum(math.comb(tables, k) * one**k * (1 - one) ** (tables - k) for k in range(needed)) > 1 - recall:
        tables += 1
    return tables


@functools.lru_cache(maxsize=4)
def directions(size: int, tables: int, signs: int) -> np.ndarray:
    """Random directions, the same everywhere: (tables, signs + 1, size)."""
    return np.random.default_rng(20).standard_normal((tables, signs + 1, size)).astype(np.float64)


def projected(vectors: np.ndarray, tables: int, signs: int) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors: bucket in each table, and place in the order there."""
    d = directions(vectors.shape[1], tables, signs)
    along = np.einsum("nd,tkd->ntk", vectors, d, optimize=True)
    bits = (along[:, :, :signs] > 0) @ (1 << np.arange(signs, dtype=np.int64))
    return bits, along[:, :, signs]


def window(threshold: float) -> float:
    return REACH * math.sqrt(2 - 2 * threshold)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, unit, size): unit is null where there is nothing to compare."""
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform(v, F.abs))
    rows = vectors.select("row", "vec_id", F.when(sound & (top > 0), F.transform(v, lambda x: x / top)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("row", "vec_id", F.transform("v", lambda x: x / norm).alias("unit"))


def links_and_forest(classes: DataFrame, threshold: float, signs: int, tables: int) -> DataFrame:
    """(a, b, n) for classes (node, copies, unit): with b null, ``n`` vectors linked to ``a`` in one group; else a link."""
    reach = window(threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                units = np.array(part["unit"].to_pylist(), np.float64)
                if not len(units):
                    continue
                bits, along = projected(units, tables, signs)
                n = len(units)
                yield pa.record_batch(
                    {"table": pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), "bucket": pa.array(bits.ravel()), "place": pa.array(along.ravel()), "node": pa.array(np.repeat(part["node"].to_numpy(), tables))}
                )

    rows = staged(classes.select("node", "unit").mapInArrow(spread, "table int, bucket long, place double, node long"))
    # Large buckets are cut where they are: by cells along the order, each no narrower than a window.
    sizes = rows.groupBy("table", "bucket").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    sizes = staged(sizes.where("n > 1"))
    rows = rows.join(sizes, ["table", "bucket"])
    cell = F.when(F.col("n") > BLOCK, F.floor((F.col("place") - F.col("low")) / reach)).otherwise(F.lit(0)).cast("long")
    rows = staged(rows.select("table", "bucket", "place", "node", cell.alias("cell")))
    # A cell is cut into blocks of a bounded size; rows are numbered by a hash that spreads them evenly.
    cells = rows.groupBy("table", "bucket", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    cells = staged(cells)
    key = ["table", "bucket", "cell"]
    after = cells.select("table", "bucket", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("after"))
    before = cells.select("table", "bucket", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("before"))
    around = staged(cells.join(after, key, "left").join(before, key, "left").fillna(0, ["after", "before"]))
    rows = rows.join(around, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    series = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    own = F.col("block")
    # Groups: two blocks of one cell, or one of a cell and one of the next.
    groups = F.concat(
        F.transform(series(F.col("blocks")), lambda o: F.struct(F.col("cell").alias("of"), F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), F.lit(0).alias("step"), F.lit(0).alias("side"))),
        F.transform(series(F.col("after")), lambda o: F.struct(F.col("cell").alias("of"), own.alias("i"), o.alias("j"), F.lit(1).alias("step"), F.lit(0).alias("side"))),
        F.transform(series(F.col("before")), lambda o: F.struct((F.col("cell") - 1).alias("of"), o.alias("i"), own.alias("j"), F.lit(1).alias("step"), F.lit(1).alias("side"))),
    )
    rows = rows.select("table", "bucket", "node", "block", F.explode(groups).alias("g")).select("table", "bucket", "node", "block", "g.*")
    rows = rows.join(classes, "node")
    group = ["table", "bucket", "of", "step", "i", "j"]
    rows = rows.select(*group, "side", "block", "node", "copies", "unit")

    def compare(key: tuple, group_rows: pa.Table) -> pa.Table:
        own_table, step, i, j = key[0].as_py(), key[3].as_py(), key[4].as_py(), key[5].as_py()
        node, copies = group_rows["node"].to_numpy(), group_rows["copies"].to_numpy()
        units = np.array(group_rows["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(node), -1)
        side = group_rows["side"].to_numpy() if step else (group_rows["block"].to_numpy() != i).astype(int)
        bits, along = projected(units, tables, signs)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not step and i == j:
            right = left
        ends: list[np.ndarray] = []
        for begin in range(0, len(left), 64):
            at = left[begin : begin + 64]
            # Collisions of these with all others of the group, over all tables.
            count = np.zeros((len(at), len(right)), np.int32)
            first = np.full((len(at), len(right)), tables, np.int32)
            for t in range(tables - 1, -1, -1):
                met = (bits[at, t][:, None] == bits[right, t]) & (np.abs(along[at, t][:, None] - along[right, t]) <= reach)
                count += met
                first[met] = t
            wanted = (count >= NEEDED) & (first == own_table)
            if not step and i == j:
                wanted &= node[at][:, None] < node[right]
            x, y = np.nonzero(wanted)
            if len(x):
                x, y = at[x], right[y]
                near = np.einsum("nd,nd->n", units[x], units[y]) >= threshold
                ends.append(np.stack([x[near], y[near]]))
        x, y = np.concatenate(ends, 1) if ends else np.empty((2, 0), np.int64)
        total = np.zeros(len(node), np.int64)
        np.add.at(total, x, copies[y])
        np.add.at(total, y, copies[x])
        # Of the links, a forest is enough for the components.
        parent = list(range(len(node)))

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        kept = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if (ra := root(a)) != (rb := root(b)):
                parent[ra] = rb
                kept.append((a, b))
        some = np.flatnonzero(total)
        a = [*node[some].tolist(), *(int(node[p]) for p, _ in kept)]
        b = [*[None] * len(some), *(int(node[q]) for _, q in kept)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*total[some].tolist(), *[0] * len(kept)], pa.int64())})

    return rows.groupBy(*group).applyInArrow(compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two rows are linked if the cosine of their vectors, in double precision, is at least ``threshold``. Null and zero
    vectors and those with a null or non-finite component are linked with nothing, and so are vectors of different
    lengths. Rows that repeat a vector are linked with each other. A component is named after its smallest vec_id; a null
    vec_id names none. No rows give no rows.
    """
    rows = staged(unit_vectors(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")))
    sound = rows.where("unit is not null")
    classes = sound.groupBy("unit").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = staged(classes)
    out = None
    # One run for each length of vectors; a table has one as a rule.
    lengths = [r[0] for r in classes.select(F.size("unit")).distinct().orderBy(F.size("unit")).collect()]
    for size in lengths:
        same = classes.where(F.size("unit") == size).select("node", "copies", "unit")
        signs = min(MAX_SIGNS, max(2, math.ceil(math.log2(max(1, same.count()) / PER_BUCKET + 1))))
        found = links_and_forest(same, threshold, signs, calibrated(signs, threshold))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(out)
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    joined = components(found.where("b is not null"))
    named = staged(classes.join(links, "node", "left").join(joined, "node", "left").select("unit", "least", "copies", "n", F.coalesce("component", "node").alias("component")))
    ids = staged(named.groupBy("component").agg(F.min("least").alias("component_id")))
    total = (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long")
    named = staged(named.join(ids, "component").select("unit", "component_id", total.alias("n_links")))
    out = rows.join(named, "unit", "left")
    component = F.when(F.col("unit").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
