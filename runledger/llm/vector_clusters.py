"""Centroid clustering of integer vectors, with most distances settled by Ptolemy's inequality.

The first centroids are also the pivots, and they stay pivots while the centroids move. For a vector v, a centroid c and two
pivots p and q, |v p| |c q| and |v q| |c p| differ by at most |v c| |p q|, so the cached distances of v to the pivots and the
few of the centroids to the pivots give a lower bound of |v c| without touching the vector. Bounds are floating point numbers,
lowered by more than their rounding error. The centroid of the lowest bound is measured first, and only centroids whose bound
does not exceed that distance are measured too; those distances are integers and exact, and so is the choice.

Vectors and their pivot distances are written once to the shared folder. A round is one pass over them: a task sends the
count and the sum of each of its clusters, Spark adds them up, and the driver divides: clusters x components numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import staged, table

CLUSTERS = 8
ROUNDS = 10
COMPONENTS = 64
SCALE = 1024
SEED = "3"
# Integers beyond this are taken as this, so that the squared distance of 64 components fits 64 bits.
LARGEST = 1 << 27
# Far more than the rounding of a few products of distances, each with a relative error of about 1e-16.
SLACK = 1e-12
ROWS = 4096


def whole_numbers(vector: str, largest: int) -> F.Column:
    """floor(``SCALE`` * x) of each component x, taken as a double."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(largest))), F.lit(-float(largest)))))
    return scaled.cast("array<int>")


def is_finite(vector: str) -> F.Column:
    """Whether there is a vector, and no component is null or not a finite number."""
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def distances(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to one."""
    apart = vectors - point
    return np.einsum("nd,nd->n", apart, apart)


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """All pairs of different pivots, with their distance."""
    pairs = []
    for i in range(len(pivots)):
        for j in range(i):
            if apart := int(distances(pivots[i : i + 1], pivots[j])[0]):
                pairs.append((i, j, math.sqrt(apart)))
    return pairs


def lower_bounds(to_pivots: np.ndarray, centroids: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Lower bounds of the distances of vectors to centroids, given the distances of both to the pivots."""
    bounds = np.zeros((len(to_pivots), len(centroids)))
    for i, j, apart in pairs:
        one = to_pivots[:, i, None] * centroids[:, j]
        other = to_pivots[:, j, None] * centroids[:, i]
        np.maximum(bounds, (np.abs(one - other) - SLACK * (one + other)) / (apart * (1 + SLACK)), out=bounds)
    return bounds


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For integer vectors: number of the nearest centroid (of several, the smallest), squared distance; and how many
    distances were measured."""
    between = np.sqrt(np.stack([distances(centroids, p) for p in pivots], 1).astype(np.float64))
    bounds = lower_bounds(to_pivots, between, pivot_pairs(pivots))
    squared = bounds * bounds * (1 - SLACK)
    cluster = bounds.argmin(1)
    apart = vectors - centroids[cluster]
    best = np.einsum("nd,nd->n", apart, apart)
    open_ = squared <= best[:, None]
    open_[np.arange(len(vectors)), cluster] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        rows = rows[squared[rows, c] <= best[rows]]  # it may have come down meanwhile
        if len(rows):
            found = distances(vectors[rows], centroids[c])
            closer = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
            best[rows[closer]], cluster[rows[closer]] = found[closer], c
        open_[:, c] = False
        open_[rows, c] = True
    return cluster, best, len(vectors) + int(open_.sum())


def _numbers(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for begin in range(0, len(batch), ROWS):
            part = batch.slice(begin, ROWS)
            yield part, _numbers(part["v"], len(part)).astype(np.int64), _numbers(part["to_pivots"], len(part))


def _measured(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors with their distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                vectors = _numbers(batch["v"], len(batch)).astype(np.int64)
                far = np.sqrt(np.stack([distances(vectors, p) for p in pivots], 1).astype(np.float64))
                column = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(pivots), far.ravel())
                yield pa.record_batch({"vec_id": batch["vec_id"], "v": batch["v"], "to_pivots": column})

    return rows.mapInArrow(measure, "vec_id long, v array<int>, to_pivots array<double>")


def _sums(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each cluster that has vectors."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column counts.
        totals = np.zeros((k, size + 1), np.int64)
        for _, vectors, to_pivots in _parts(batches):
            cluster, _, _ = nearest(vectors, to_pivots, centroids, pivots)
            for c in np.unique(cluster):
                own = vectors[cluster == c]
                totals[c, :size] += own.sum(0)
                totals[c, size] += len(own)
        of, at = np.indices(totals.shape, dtype=np.int32)
        yield pa.record_batch({"cluster": pa.array(of.ravel()), "at": pa.array(at.ravel()), "total": pa.array(totals.ravel())})

    parts = rows.select("v", "to_pivots").mapInArrow(add, "cluster int, at int, total long")
    totals = np.zeros((k, size + 1), object)
    for row in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():
        totals[row["cluster"], row["at"]] = row["total"]
    return {c: (totals[c, size], list(totals[c, :size])) for c in range(k) if totals[c, size]}


def clusters(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = COMPONENTS, seed: str = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for the sound rows of ``vectors`` (vec_id,
    embedding); other columns, whatever their names, are not read.

    Rows whose vector is null, has another number of components than ``size``, or holds null or non-finite ones are left
    out. The first centroids are the ``k`` vectors of the smallest sha256 of ``<seed>:<vec_id>``, fewer if there are fewer;
    rows that share a vec_id are ordered by their vectors, those without one come last. Repeated rows all count. Equal
    distances go to the smaller number; a centroid without vectors stays where it is. Components whose integer exceeds
    ``LARGEST`` are taken as ``LARGEST``; an inertia that does not fit 64 bits is null. No rows give no rows.
    """
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    kept = doubles.where(is_finite("v") & (F.size("v") == size)).select("vec_id", whole_numbers("v", LARGEST).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    pivots = np.array([row["v"] for row in first], np.int64)
    rows = staged(_measured(kept, pivots))
    centroids = pivots.copy()
    for _ in range(rounds):
        for c, (n, total) in _sums(rows, centroids, pivots).items():
            centroids[c] = [t // n for t in total]  # the floor, below zero too

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors, to_pivots in _parts(batches):
            cluster, distance, _ = nearest(vectors, to_pivots, centroids, pivots)
            yield pa.record_batch({"vec_id": part["vec_id"], "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    assigned = staged(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    # One row a cluster: at most ``k``.
    inertia = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.when(F.count("cluster_inertia") == F.count("*"), F.try_sum("cluster_inertia")).alias("inertia"))
    inertias, whole = {row[0]: row[1] for row in inertia.collect()}, total.first()[0]
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = vectors.sparkSession.createDataFrame(
        [(c, inertias.get(c), whole, hashes[c]) for c in range(len(centroids))],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """The same by measuring every distance, a round after the other."""
    steps = [
        f"""kept as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "cells as materialized (select vec_id, unnest(generate_series(1, %d)) as d, unnest(v) as x from kept)" % COMPONENTS,
        f"""c0 as materialized (
  select c, unnest(generate_series(1, {COMPONENTS})) as d, unnest(v) as x
  from (select v, row_number() over (order by sha256('{SEED}:' || cast(vec_id as varchar))) - 1 as c from kept)
  where c < {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} as materialized (
  select vec_id, c, far from (
    select *, row_number() over (partition by vec_id order by far, c) as place from (
      select vec_id, c, sum((cells.x - c{i}.x) * (cells.x - c{i}.x)) as far
      from cells join c{i} using (d) group by vec_id, c))
  where place = 1)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} as materialized (
  select c{i}.c, c{i}.d, case when n is null then x else cast((s - ((s % n) + n) % n) // n as bigint) end as x
  from c{i} left join (
    select c, d, sum(x) as s, count(*) as n from cells join a{i} using (vec_id) group by c, d) m using (c, d))"""
            )
    last = ROUNDS
    steps.append(f"hashes as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as h from c{last} group by c)")
    return "with " + ",\n".join(steps) + f"""
select vec_id, cast(c as integer) as cluster, cast(far as bigint) as distance,
       cast(sum(far) over (partition by c) as bigint) as cluster_inertia, cast(sum(far) over () as bigint) as inertia,
       h as centroid_sha256
from a{last} join hashes using (c)"""
