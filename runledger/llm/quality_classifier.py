"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are DataFrame functions over the whole text, worked out once and stored. Trees are fitted on a sample of
labelled rows of at most ``SAMPLE`` (a parameter): every statistic is cut into bins at quantiles, and a tree grows level
by level from sums of gradients per node, statistic and bin. The finished trees are flattened into arrays of equal shape
(statistic, threshold, leaf value; children of node k are 2k+1 and 2k+2), so that a batch of documents walks all of them
with a few numpy look-ups per level. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import SPACES, staged, table
from runledger.llm.quality_rules import let, repeated_words

SAMPLE = 50_000
ACCEPT = 0.3
# Letters, capitals, digits, and marks of different kinds, counted by taking them away.
_TAKEN = {"letters": r"\p{L}+", "capitals": r"\p{Lu}+", "digits": r"\p{Nd}+", "stops": r"[.,;:?'()-]+", "marks": r"[#*$%&<>=_^~@\\\[\]{}+]+", "bars": r"[|]+", "shouts": r"!+"}


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text that do not depend on its length as such, and two that do."""
    n = F.length(text)
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0).cast("double")
    out = {name: share(n - F.length(F.regexp_replace(text, pattern, "")), n) for name, pattern in _TAKEN.items()}
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def of(w: Column) -> Column:
        size = F.size(w)
        return F.struct(
            F.log1p(size.cast("double")).alias("words"),
            share(F.length(F.array_join(w, "")), size).alias("word_length"),
            share(F.size(F.array_distinct(w)), F.least(size, F.lit(1 << 30))).alias("different"),
            share(repeated_words(w), size).alias("repeated"),
            share(F.size(F.filter(w, lambda x: F.length(x) > 14)), size).alias("long_words"),
            share(F.size(F.filter(w, lambda x: F.length(x) == 1)), size).alias("short_words"),
            share(F.size(F.filter(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.get(w, i) == F.get(w, i - 1))), size).alias("doubled"),
        )

    by_word = let(words, of)
    lines = F.split(text, "\n")
    by_line = let(lines, lambda x: F.struct(F.log1p(F.size(x).cast("double")).alias("lines"), share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)).alias("equal_lines")))
    return {**out, "word_level": by_word, "line_level": by_line}


FEATURES = (*_TAKEN, "words", "word_length", "different", "repeated", "long_words", "short_words", "doubled", "lines", "equal_lines")


def features(docs: DataFrame) -> DataFrame:
    """(row, doc_id, features: an array in the order of ``FEATURES``), stored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in statistics(text).items()])
    flat = rows.select("row", "doc_id", *_TAKEN, "word_level.*", "line_level.*")
    return staged(flat.select("row", "doc_id", F.array(*FEATURES).alias("features")))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays, one row each. Nodes that do not split pass all rows to the left."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boosted trees for the logistic loss. ``least``: the curvature (about a quarter of the rows) that a child needs."""
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        empty = np.zeros((0, inner))
        return Forest(empty.astype(np.int64), empty, np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    out_feature, out_threshold, out_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                place = (node - first) * bins + binned[:, f]
                g = np.bincount(place, slope, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(place, curve, width * bins).reshape(width, bins).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < least) | (all_h - h < least)] = 0
                gain = gain[:, : len(cut)]
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = cut[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        end = node - inner
        leaf = rate * np.bincount(end, slope, leaves) / (np.bincount(end, curve, leaves) + ridge)
        total += leaf[end]
        out_feature.append(feature)
        out_threshold.append(threshold)
        out_leaf.append(leaf)
    return Forest(np.array(out_feature), np.array(out_threshold), np.array(out_leaf), base)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from ``labels`` (doc_id, quality 0 or 1) that are not held out, of at most about ``sample`` documents, chosen by
    a hash of doc_id; rows that repeat a doc_id count each, and labels that are null or contradict each other do not.
    Null and empty texts have the statistics of an empty text and are scored like any other. Without labels of both kinds
    all scores are the share of ones, evened out. No rows give no rows.
    """
    rows = features(docs)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31)))
    taught = known.join(rows, "doc_id").select("doc_id", "quality", "features").limit(2 * sample).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(taught["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    forest = fit(x, taught["quality"].to_numpy(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["features"].flatten().to_numpy(zero_copy_only=False)
            scores = forest.score(flat.reshape(-1, len(FEATURES)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(scores)})

    scored = rows.select("doc_id", "features").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
