"""Packing documents into sequences of bounded length, large pieces matched first.

How many sequences hold which lengths depends on the number of pieces of each length alone, so the plan is made from a
histogram with at most one row for each length up to the capacity, whatever the number of documents:

1. full pieces fill a sequence each;
2. pieces above a third of the capacity fit at most twice in a sequence: from the largest down, each is matched with the
   largest other that still fits beside it, and those without a partner open a sequence alone;
3. smaller pieces go, from the largest down, to the tightest gap that holds them, and open sequences when none does.

The plan says which ranks of a length go to which sequences. Pieces are ranked among those of their length by counting
in the map tasks and adding what earlier tasks had, so no length is ever gathered or sorted, however common it is.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import offsets, staged, table
from runledger.llm.encoding import encoder

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = b"\0\0\0\0"

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
_PLAN = "length int, rank_from long, rank_to long, each int, first_sequence long, first_offset int"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, spaces: bool = False) -> DataFrame:
    """The ids of (doc_id, text) with the end id, cut at multiples of the capacity; ``nth`` counts a length in its task.

    A null or empty text has one piece of the end id alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = encoder(vocabulary, spaces).encode, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = memoryview(ids_of(text.as_py()) + END)
                for k, begin in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * begin : 4 * (begin + capacity)]
                    n = len(own) // 4
                    for column, value in zip(out, (doc, k, begin, n, zlib.crc32(own), part, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)

    return docs.mapInArrow(cut, _PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``_PLAN``: ranks of a length from one to below another go ``each`` a sequence, at an offset.

    The number of rows depends on the number of different lengths only.
    """
    used, out, opened = Counter(), [], 0
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # room left: runs of [first sequence, how many]

    def put(length: int, n: int, each: int, first: int, offset: int) -> None:
        out.append((length, used[length], used[length] + n, each, first, offset))
        used[length] += n

    def opening(n: int) -> int:
        nonlocal opened
        opened += n
        return opened - n

    large = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    sizes = sorted(large)
    while sizes:
        a = sizes[-1]
        at = bisect.bisect_right(sizes, capacity - a) - 1
        if at < 0:
            first, n, room = opening(large[a]), large[a], capacity - a
            put(a, n, 1, first, 0)
            large[a] = 0
        elif (b := sizes[at]) == a:
            n, room = large[a] // 2, capacity - 2 * a
            first = opening(n)
            if n:
                put(a, 2 * n, 2, first, 0)
            large[a] -= 2 * n
            if large[a]:  # one is left for the next smaller partner
                sizes.pop()
                at = len(sizes) - 1
                alone = opening(1)
                put(a, 1, 1, alone, 0)
                large[a] = 0
                if at >= 0:
                    b = sizes[at]
                    put(b, 1, 1, alone, a)
                    large[b] -= 1
                    gaps[capacity - a - b].append([alone, 1])
                else:
                    gaps[capacity - a].append([alone, 1])
                sizes = [x for x in sizes if large[x]]
                if n:
                    gaps[room].append([first, n])
                continue
        else:
            n, room = min(large[a], large[b]), capacity - a - b
            first = opening(n)
            put(a, n, 1, first, 0)
            put(b, n, 1, first, a)
            large[a] -= n
            large[b] -= n
        if n and room:
            gaps[room].append([first, n])
        sizes = [x for x in sizes if large[x]]
    for s in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        left, rooms = counts[s], sorted(g for g in gaps if g >= s)
        while left:
            while rooms and not gaps[rooms[0]]:
                gaps.pop(rooms.pop(0))
            if not rooms:
                each = capacity // s
                gaps[capacity].append([opening(-(-left // each)), -(-left // each)])
                rooms = [capacity]
            room = rooms[0]
            first, n = gaps[room].pop()
            each = room // s
            bins = min(n, left // each)
            if bins:
                put(s, bins * each, each, first, capacity - room)
                left -= bins * each
                if room - each * s:
                    gaps[room - each * s].append([first, bins])
            first, n = first + bins, n - bins
            if n and left and left < each:
                put(s, left, left, first, capacity - room)
                gaps[room - left * s].append([first, 1])
                left, first, n = 0, first + 1, n - 1
            if n:
                gaps[room].append([first, n])
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, spaces: bool = False) -> DataFrame:
    """One row for each piece of (doc_id, text): its place in a sequence.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. Null and empty texts are the end id alone;
    rows that repeat a doc_id are packed each; pieces of one length are interchangeable, so ties have no bearing on the
    number of sequences. No rows give no rows. Columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, capacity, vocabulary, spaces))
    tasks = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    tasks = staged(offsets(tasks, ["length"], "part", "n", "before"))
    # At most one row for each length up to the capacity.
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = spark.createDataFrame(plan(counts, capacity), _PLAN)
    ranked = cut.join(tasks.select("part", "length", "before"), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("before")).alias("r")
    # The plan has a few rows for each length, so it is bounded by the capacity.
    placed = ranked.join(
        F.broadcast(planned.alias("p")),
        F.expr("r.length = p.length and r.rank >= p.rank_from and r.rank < p.rank_to"),
    )
    turn = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", F.col("piece"), "start", F.col("r.length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(turn, F.col("each").cast("long")) * F.col("r.length")).cast("long").alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
