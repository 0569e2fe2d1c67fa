"""What the corpus operators share: staged tables, row keys, numbering by partition, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of a text: runs of anything but the space and the five control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
# Where folders that are made are noted, while somebody asks for it.
_notes: list[list[str]] = []


@contextmanager
def noted(folders: list[str]) -> Iterator[None]:
    """Notes the folders made meanwhile, so that they can be forgotten once what was made of them is stored elsewhere."""
    _notes.append(folders)
    try:
        yield
    finally:
        _notes.pop()


def forget(spark: SparkSession, folders: list[str]) -> None:
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``; a session that names none, as in tests, gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _own.setdefault("folder", tempfile.mkdtemp(prefix="spark-"))
    path = f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for folders in _notes:
        folders.append(path)
    return path


def staged(rows: DataFrame, *partition_by: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """The rows, written once to the shared folder and read from there: lineage ends and nothing is computed again."""
    path = path or folder(rows.sparkSession)
    writer = rows.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offsets(counts: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the smaller ``order`` of the same keys.

    ``counts`` has one row for each key and task of an earlier stage, so that a window over it stays small however many
    rows the tasks had.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Every round hooks each node to its smallest neighbour, halves the paths once and contracts the edges, until none is
    left; rounds grow with the logarithm of the longest path. Only minima are taken per node, so a hub with very many
    edges is aggregated in the map tasks first. Each round is written to the shared folder.
    """
    edges = staged(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )
    labels = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hook = staged(hook.join(far, "to").select("node", F.col("next").alias("to")))
        up = hook.select(F.col("node").alias("component"), "to")
        labels = staged(labels.join(up, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        to_a, to_b = (hook.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        edges = staged(
            moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct()
        )
    return labels
