"""Exact search for the highest inner products, term at a time.

Vectors are sparse rows: a term for each component that is not zero. A block of candidates is inverted to postings, for each
term the candidates that have it and their weights. A query takes its terms one after the other and adds weight times posting
to a dense array of scores, one for each candidate of the block; when all terms are done every score is complete and exact.
The best are then taken by partition instead of a sort, and what the blocks found for a query is merged.

Every query meets every candidate, so the work is their product whatever the plan. Both are dealt into blocks of bounded
size; a group of rows is one block of queries and one of candidates, so rows are sent once for each block of the other side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm.common import staged, table

BEST = 10
EVERY = 100
SCALE = 1024
# Integers beyond this are taken as this, so that the sum of 2,048 products fits 64 bits.
LARGEST = 1 << 26
# Rows of a block, on average.
BLOCK = 16384


def sparse_rows(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, terms, weights): the components that are not zero, as whole numbers; unsound vectors are left out."""
    v = F.col("v")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = float(LARGEST)
    scaled = F.transform(v, lambda x, i: F.struct(i.alias("t"), F.floor(F.greatest(F.least(x * SCALE, F.lit(limit)), F.lit(-limit))).cast("int").alias("w")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    cells = rows.where(sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.filter(scaled, lambda c: c["w"] != 0).alias("cells"))
    return cells.select("row", "vec_id", F.col("cells.t").alias("terms"), F.col("cells.w").alias("weights"))


def postings(terms: np.ndarray, owners: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each term the rows that have it, ascending, and their weights."""
    order = np.argsort(terms, kind="stable")
    terms, owners, weights = terms[order], owners[order], weights[order]
    found, begins = np.unique(terms, return_index=True)
    ends = [*begins[1:], len(terms)]
    return {int(t): (owners[b:e], weights[b:e]) for t, b, e in zip(found, begins, ends, strict=True)}


def scores(lists: dict[int, tuple[np.ndarray, np.ndarray]], terms: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """Inner products of one sparse query with all rows of a block."""
    total = np.zeros(rows, np.int64)
    for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
        if term in lists:
            owners, held = lists[term]
            if len(owners) == rows:
                total += weight * held
            else:
                total[owners] += weight * held
    return total


def best(total: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest values, of equal ones the first; all if there are no more. In no order."""
    if len(total) <= k:
        return np.arange(len(total))
    least = np.partition(total, len(total) - k)[len(total) - k]
    above = np.flatnonzero(total > least)
    return np.concatenate([above, np.flatnonzero(total == least)[: k - len(above)]])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many each row has."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def top_products(vectors: DataFrame, queries: DataFrame, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the ``k`` highest inner products of each row of ``queries`` with the rows
    of ``vectors`` but itself. Both hold sparse rows (row, vec_id, terms, weights) and share the numbering ``row``.

    Equal scores go to the smaller vec_id, rows without one last, and rows that share one by their number. Terms that one
    side lacks count as zero, so that vectors of different lengths, and empty ones, have a score. Fewer candidates than
    ``k`` are all returned; no queries or no candidates give no rows.
    """
    n_vectors, n_queries = vectors.count(), queries.count()
    if not n_vectors or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score long")
    of_vectors, of_queries = -(-n_vectors // block), -(-n_queries // block)

    def dealt(rows: DataFrame, own: int, others: int, is_query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("row"), F.lit(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        i, j = (mine, every) if is_query else (every, mine)
        return rows.select(i.alias("i"), j.alias("j"), F.lit(is_query).alias("is_query"), "row", "vec_id", "terms", "weights")

    both = dealt(vectors, of_vectors, of_queries, False).unionByName(dealt(queries, of_queries, of_vectors, True))

    def search(rows: pa.Table) -> pa.Table:
        asked = rows.filter(rows["is_query"])
        held = rows.filter(pc.invert(rows["is_query"])).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        n = len(held)
        number, vec_id = held["row"].to_numpy(), held["vec_id"].combine_chunks()
        terms, sizes = _flat(held["terms"])
        lists = postings(terms, np.repeat(np.arange(n), sizes), _flat(held["weights"])[0])
        query_terms, query_sizes = _flat(asked["terms"])
        query_weights, ends = _flat(asked["weights"])[0], np.cumsum(query_sizes)
        place = {row: at for at, row in enumerate(number.tolist())}
        of, at, score = [], [], []
        for q, row in enumerate(asked["row"].to_pylist()):
            begin = ends[q] - query_sizes[q]
            total = scores(lists, query_terms[begin : ends[q]], query_weights[begin : ends[q]], n)
            chosen = best(total, k + 1 if row in place else k)
            chosen = chosen[chosen != place.get(row, -1)]
            # One more was taken if the query is in the block itself and not among its own best.
            chosen = chosen[np.lexsort((chosen, -total[chosen]))][:k]
            of.append(np.full(len(chosen), q)), at.append(chosen), score.append(total[chosen])
        if not of:
            return pa.table({name: pa.array([], pa.int64()) for name in ("query_row", "query_id", "row", "vec_id", "score")})
        of, at = pa.array(np.concatenate(of)), pa.array(np.concatenate(at))
        return pa.table({
            "query_row": asked["row"].take(of), "query_id": asked["vec_id"].take(of),
            "row": held["row"].take(at), "vec_id": vec_id.take(at), "score": pa.array(np.concatenate(score)),
        })

    found = both.groupBy("i", "j").applyInArrow(search, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = BEST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) whose vec_id ``every`` divides; other
    columns, whatever their names, are not read.

    Vectors that are null or hold null or non-finite components take no part; empty ones and those of other lengths do.
    Rows that repeat a vec_id are queries of their own, and candidates of each other; a row without a vec_id is a candidate
    only. Components whose integer exceeds ``LARGEST`` are taken as ``LARGEST``. No rows give no rows.
    """
    rows = staged(sparse_rows(vectors))
    queries = rows.where(F.col("vec_id") % every == 0)
    return top_products(rows, queries, k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    return f"""
with sound as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from sound q join sound c on q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= {BEST}"""
