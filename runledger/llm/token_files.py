"""Token ids in compressed files with one shared dictionary.

A zstandard dictionary is trained on the serialized ids of a bounded sample of short documents. Every document is then a
frame of its own, compressed with it, and documents lie in ascending order. A file set is a folder of three tables,
written by Spark's own writer, so that any file system Spark reaches will do and a lost task is written again:

- ``dictionary``: one row with the dictionary, its hash (``sha256``) and the bytes an id takes;
- ``blocks``: frames back to back, up to ``BLOCK`` bytes a row, with the hash of the dictionary they need;
- ``index``: for each document its block, and offset and length there, sorted by document.

A short document is read by one look-up in the index and one in the blocks (``lookup``), both of which skip row groups by
their statistics, then by decompressing its frame alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import folder, offsets, staged, table
from runledger.llm.encoding import encoder

VOCABULARY = "byte_bpe_50k.json"
END = 0
# Bound of the dictionary and of the sample it is trained on: so many documents of at most so many characters.
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 16_384
LEVEL = 3
# Bytes of frames in a row of blocks; a longer document has a row of its own.
BLOCK = 256 << 10

_ENCODED = "doc_id long, row long, n_tokens long, crc long, frame binary"
_BLOCKS = "part int, block int, start long, first_doc_id long, dictionary string, payload binary, docs array<long>, ends array<long>, sizes array<long>"
_DIGESTS = "part int, doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long"


def _serialize(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _deserialize(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def train_dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, spaces: bool = True, width: int = 2) -> bytes:
    """Dictionary of a sample of documents chosen by a hash of their id; empty if there are too few to train one."""
    import zstandard

    n = max(1, docs.count())
    share = int(min(1.0, 1.5 * SAMPLE_DOCS / n) * (1 << 31))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share)
    chosen = chosen.where(F.length("text").between(1, SAMPLE_CHARS)).select("text").limit(SAMPLE_DOCS)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(vocabulary, spaces).encode_all
        for batch in batches:
            yield pa.record_batch({"ids": pa.array([_serialize(ids, width) for ids in encode_all(batch[0])], pa.binary())})

    samples = [bytes(r.ids) for r in chosen.mapInArrow(serialized, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _tools(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    shared = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def encode(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, spaces: bool = True, end: int = END) -> None:
    """Writes the ids of ``docs`` (doc_id, text), each with an end id, to a file set at ``path``.

    A null or empty text has the end id alone. Order is by doc_id, null first; rows that repeat a doc_id follow one
    another, by the checksum of their ids. Other columns are not looked at. No rows give empty tables.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = 2 if encoder(vocabulary, spaces).tokenizer.get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(docs, vocabulary, spaces, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    closing = np.array([end], "<u4").tobytes()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, compress = encoder(vocabulary, spaces).encode_all, _tools(dictionary)[0].compress
        for batch in batches:
            sizes, crcs, out = [], [], []
            for ids in encode_all(batch["text"]):
                ids += closing
                sizes.append(len(ids) // 4)
                crcs.append(zlib.crc32(ids))
                out.append(compress(_serialize(ids, width)))
            yield pa.record_batch(
                {"doc_id": batch["doc_id"], "row": batch["row"], "n_tokens": pa.array(sizes, pa.int64()), "crc": pa.array(crcs, pa.int64()), "frame": pa.array(out, pa.binary())}
            )

    encoded = staged(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(frames, _ENCODED))
    order = ["doc_id", "crc", "row"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held = TaskContext.get().partitionId(), 0, 0, []

        def closed() -> pa.RecordBatch:
            ids, sizes, out = zip(*held, strict=True)
            row = {"part": part, "block": block, "start": start, "first_doc_id": ids[0], "dictionary": digest, "payload": b"".join(out), "docs": list(ids), "ends": np.cumsum([len(x) for x in out]).tolist(), "sizes": list(sizes)}
            return pa.RecordBatch.from_pylist([row], pa.schema(_arrow(_BLOCKS)))

        size = 0
        for batch in batches:
            for doc, n, frame in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True):
                if held and size + len(frame) > BLOCK:
                    yield closed()
                    start += sum(x[1] for x in held)
                    block, size, held = block + 1, 0, []
                held.append((doc, n, frame))
                size += len(frame)
        if held:
            yield closed()

    sorted_rows = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.select("doc_id", "n_tokens", "frame").mapInArrow(packed, _BLOCKS).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    docs_of = F.posexplode(F.arrays_zip("docs", "ends", "sizes")).alias("at", "doc")
    begins = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.element_at("all_ends", F.col("at")))
    index = blocks.select("part", "block", F.col("ends").alias("all_ends"), docs_of).select(
        F.col("doc.docs").alias("doc_id"), "part", "block", F.col("at").alias("place"), begins.cast("long").alias("offset"), (F.col("doc.ends") - begins).cast("long").alias("length"), F.col("doc.sizes").alias("n_tokens")
    )
    index.write.parquet(f"{path}/index")
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return [(name, kinds[kind]) for name, kind in (column.strip().split(" ") for column in ddl.split(","))]


def _open(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    found = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(found.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != found.hash:
        raise ValueError(f"{path}: the dictionary does not have the hash it was written with")
    return dictionary, found.hash, found.width


def _frames(batch: pa.RecordBatch, digest: str) -> Iterator[tuple[dict, int | None, bytes]]:
    """Each block's row, document and frame; a block made with another dictionary is an error."""
    for row in batch.to_pylist():
        if row["dictionary"] != digest:
            raise ValueError(f"block {row['part']}/{row['block']} was compressed with another dictionary")
        view, begin = memoryview(row["payload"]), 0
        for doc, stop in zip(row["docs"], row["ends"], strict=True):
            yield row, doc, bytes(view[begin:stop])
            begin = stop


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Reads a whole file set: for each document where its ids start among all, how many they are and their checksum."""
    dictionary, digest, width = _open(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _tools(dictionary)[1].decompress
        for batch in batches:
            out, now, start = {name: [] for name, _ in _arrow(_DIGESTS)}, None, 0
            for row, doc, frame in _frames(batch, digest):
                if now is not row:
                    now, start = row, row["start"]
                ids = _deserialize(decompress(frame), width)
                for name, value in zip(out, (row["part"], doc, start, len(ids), zlib.crc32(ids), len(frame)), strict=True):
                    out[name].append(value)
                start += len(ids)
            yield pa.RecordBatch.from_pydict(out, pa.schema(_arrow(_DIGESTS)))

    blocks = spark.read.parquet(f"{path}/blocks")
    # One row for each partition of the writing stage.
    parts = offsets(spark.read.parquet(f"{path}/index").groupBy("part").agg(F.sum("n_tokens").alias("n")), [], "part", "n", "base")
    rows = blocks.mapInArrow(read, _DIGESTS).join(F.broadcast(parts.select("part", "base")), "part")
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "n_bytes")


def lookup(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    """(doc_id, ids) of the documents that ``wanted``, a condition on doc_id, picks; other frames are not decompressed."""
    dictionary, _, width = _open(spark, path)
    found = spark.read.parquet(f"{path}/index").where(wanted)
    slices = found.join(spark.read.parquet(f"{path}/blocks").select("part", "block", "payload"), ["part", "block"])
    slices = slices.select("doc_id", F.expr("substring(payload, int(offset + 1), int(length))").alias("frame"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _tools(dictionary)[1].decompress
        for batch in batches:
            ids = [_deserialize(decompress(x), width).astype("int64").tolist() for x in batch["frame"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "ids": pa.array(ids, pa.list_(pa.int64()))})

    return slices.mapInArrow(read, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    encode(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
