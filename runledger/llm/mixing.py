"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target over its size is the number of copies each of its documents should have on average: a whole part, which
all get, and a fraction, which is rounded. Pairs of fractions are rounded against each other: words move from one
document to the other, in a random direction that leaves both expectations as they were, until one of the two is whole.
So the words of a source stay what they were to the last, except for the one document that has no partner left.

Pairs are formed along a reduction tree: documents are dealt by a hash into groups of about ``FAN``, each group is folded
into one fractional document, and these are grouped ``FAN`` at a time until a source has one. A group holds a few dozen
narrow rows, so a source with a third of all rows is many small groups and then a few more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm.common import WORDS, offsets, staged, table

FAN = 32
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST = 2.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row each.

    Sources take the weights in turn, by code point, null last. What a source cannot take, as it has only so many words,
    goes to the others by weight: all but the full ones get the same number of words per unit of weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(most))
    # Those that fill first, first: what they hold is taken from the total, and the rest is shared by the rest.
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    rows = rows.withColumn("unit", (F.sum("source_size").over(everything) * share - before) / others)
    rows = rows.withColumn("full", F.col("unit") * F.col("weight") > F.col("room")).withColumn("place", F.row_number().over(order))
    open_unit = F.min(F.when(~F.col("full"), F.struct("place", "unit"))).over(everything)["unit"]
    target = F.when(F.col("full"), F.col("room")).otherwise(F.least(open_unit * F.col("weight"), F.col("room")))
    return rows.select("source", "source_size", target.alias("target"))


def _chance(a: Column, b: Column) -> Column:
    """A number from 0 to below 1 that depends on the two documents only."""
    return F.pmod(F.xxhash64(a["doc_id"], a["size"], b["doc_id"], b["size"]), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(state: Column, b: Column) -> Column:
    """Rounds the fraction carried so far against the next document's; one of the two is decided, the other is carried."""
    a = state["carried"]
    to_a = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    to_b = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    first = _chance(a, b) * (to_a + to_b) < to_b
    words = F.when(first, to_a).otherwise(-to_b)
    a_whole = F.when(first, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])

    def item(of: Column, p: Column) -> Column:
        return F.struct(of["size"].alias("size"), of["doc_id"].alias("doc_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    carried = F.when(a_whole, item(b, b["p"] - words / b["size"])).otherwise(item(a, a["p"] + words / a["size"]))
    whole = F.when(a_whole, item(a, F.when(first, 1.0).otherwise(0.0))).otherwise(item(b, F.when(first, 0.0).otherwise(1.0)))
    return F.struct(carried.alias("carried"), F.concat(state["decided"], F.array(whole)).alias("decided"))


def _fold(items: DataFrame) -> DataFrame:
    """One row for each (source, bucket): the document carried on and those decided."""
    groups = items.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct("size", "doc_id", "p"))).alias("items"))
    # The largest first, so that what is carried on at the end is small where it can be.
    groups = groups.select("source", "bucket", F.reverse("items").alias("items"))
    nothing = F.slice("items", 1, 0)
    start = F.struct(F.element_at("items", 1).alias("carried"), nothing.alias("decided"))
    state = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), start, _pivot)
    return staged(groups.select("source", "bucket", state.alias("state")).select("source", "bucket", "state.carried", "state.decided"))


def rounded(classes: DataFrame) -> DataFrame:
    """(source, doc_id, size, extra): whether each of (source, doc_id, size, p), p between 0 and 1, gets another copy."""
    buckets = classes.groupBy("source").agg(F.ceil(F.count("*") / FAN).cast("long").alias("buckets"))
    items = classes.alias("c").join(buckets.alias("n"), F.expr("c.source <=> n.source"))
    bucket = F.pmod(F.xxhash64("doc_id", "size"), F.col("buckets"))
    items = items.select("c.source", "size", "doc_id", "p", bucket.alias("bucket"))
    width = buckets.agg(F.max("buckets")).first()[0] or 1
    decided = None
    for level in range(1 + math.ceil(math.log(width, FAN) + 1e-9) if width > 1 else 1):
        if level:
            items = folded.select("source", "carried.*", F.floor(F.col("bucket") / FAN).alias("bucket"))
        folded = _fold(items)
        done = folded.select("source", F.explode("decided").alias("d")).select("source", "d.doc_id", "d.size", F.col("d.p").alias("extra"))
        decided = done if decided is None else decided.unionByName(done)
    last = folded.select("source", "carried.doc_id", "carried.size", F.when(F.col("carried.p") >= 0.5, 1.0).otherwise(0.0).alias("extra"))
    return decided.unionByName(last)


def mix(docs: DataFrame, row: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """How many words the mix takes of each of ``docs`` (doc_id, text, source).

    One row for each row: row (``row``, which must be made by ``monotonically_increasing_id`` and stored, or a new one),
    doc_id, size, source_size, target, copies and taken (copies times size). Null and empty texts have size 0, no copies
    and no bearing on others; null is a source of its own, the last; rows that repeat doc_id, source and size share
    their copies as evenly as whole copies allow. The choice depends on doc_id and size, so reruns agree.
    """
    row = F.monotonically_increasing_id() if row is None else row
    rows = staged(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size")))
    sources = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    rows = rows.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    rows = rows.select("row", "doc_id", "d.source", "size", "source_size", "target", rate.alias("rate"), F.floor(rate).alias("whole"))
    # Equal rows are numbered: by task, then by what earlier tasks have of them.
    same = ["doc_id", "source", "size"]
    rows = rows.withColumn("part", F.shiftright("row", 33))
    own = Window.partitionBy(*same, "part").orderBy("row")
    numbered = rows.withColumn("nth", F.row_number().over(own) - 1)
    tasks = staged(offsets(numbered.groupBy(*same, "part").agg(F.count("*").alias("n"), F.first("rate").alias("rate")), same, "part", "n", "before"))
    classes = tasks.groupBy(*same).agg(F.sum("n").alias("n"), F.first("rate").alias("rate"))
    spare = F.col("n") * (F.col("rate") - F.floor("rate"))
    classes = classes.select(*same, F.floor(spare).alias("sure"), (spare - F.floor(spare)).alias("p"))
    bits = rounded(classes.where("p > 0 and size > 0").select(*same, "p"))
    met = " and ".join(f"a.{c} <=> b.{c}" for c in same)
    more = classes.alias("a").join(bits.alias("b"), F.expr(met), "left")
    more = more.select(*[f"a.{c}" for c in same], (F.col("sure") + F.coalesce("extra", F.lit(0.0))).alias("more"))
    more = tasks.alias("a").join(more.alias("b"), F.expr(met)).select(*[f"a.{c}" for c in same], "part", (F.col("more") - F.col("before")).alias("more"))
    met += " and a.part = b.part"
    rows = numbered.alias("a").join(more.alias("b"), F.expr(met))
    copies = F.when(F.col("a.size") > 0, F.col("whole") + (F.col("nth") < F.col("more")).cast("long")).otherwise(0).cast("long")
    return rows.select("row", "a.doc_id", "a.source", "a.size", "source_size", "target", copies.alias("copies"), (copies * F.col("a.size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (none, once, or more), with all their columns."""
    marked = staged(docs.withColumn("mixing row", F.monotonically_increasing_id()))
    copies = mix(marked, F.col("mixing row")).where("copies > 0").select(F.col("row").alias("mixing row"), F.col("copies").alias("mixing copies"))
    return (
        marked.join(copies, "mixing row")
        .withColumn("mixing copy", F.explode(F.sequence(F.lit(1), F.col("mixing copies"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
