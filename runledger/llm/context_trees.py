"""Scoring texts by context-tree weighting over bytes.

A byte is decided bit by bit. Each of the 255 places in that decision has a context tree of its own, whose nodes are the
last 0 to ``DEPTH`` bytes. A node estimates its bit by Krichevsky and Trofimov's rule from the training counts, and the
weighting mixes all depths: a node's weight against its children's is its share of the weighted probability of all that the
training text did below it. A context the training never saw leaves the word to its parent. Each text's code length per
byte follows, its end included.

How it runs: texts are cut into blocks of about ``BLOCK`` bytes. From a block only its different strings of ``DEPTH`` + 1
bytes and words go on, with their training counts. Counts are summed over all blocks; every string then gets the logarithm of its
last byte's probability, worked out among the strings that share its last three context bytes, with the upper part of the
trees added after. The logarithms go back to the blocks that asked for them; a block and its own dictionary are one group,
and no model is ever held whole anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import staged, table

DEPTH = 5
# Strings with so many context bytes in common are in one group, with as many others as make about ``GROUP`` strings.
SHARED = 3
GROUP = 1 << 16
BLOCK = 32 << 20
SLICE = 4 << 20
END = b"\xff"  # no byte of UTF-8: the end of a text, and what is before it
_END_WORD = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
DOC, GRAM, WORD = 2, 0, 1
_ROWS = "kind int, block long, key long, n long, docs binary"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """Slices of about ``SLICE`` bytes: of which text a piece is, the bytes before it, and itself; cut at white space."""
    owner, before, own, size = [], [], [], 0
    for k, text in enumerate(texts):
        begin = 0
        while begin <= len(text):
            cut = _SPACE.search(text, begin + SLICE) if len(text) - begin > SLICE else None
            stop = cut.start() if cut else len(text)
            owner.append(k)
            before.append((END * DEPTH + text[max(0, begin - DEPTH) : begin])[-DEPTH:])
            own.append(text[begin:stop] + (b"" if cut else END))
            size += stop - begin
            if size >= SLICE:
                yield owner, before, own
                owner, before, own, size = [], [], [], 0
            begin = stop if cut else len(text) + 1
    if owner:
        yield owner, before, own


def grams(before: list[bytes], own: list[bytes]) -> np.ndarray:
    """Each byte of the pieces with the ``DEPTH`` before it as a number, the last byte lowest."""
    raw = np.frombuffer(b"".join(x for pair in zip(before, own, strict=True) for x in pair), np.uint8).astype(np.uint64)
    n = len(raw) - DEPTH
    keys = np.zeros(n, np.uint64)
    for i in range(DEPTH + 1):
        keys = (keys << np.uint64(8)) | raw[i : i + n]
    starts = np.cumsum([0, *(len(x) + DEPTH for x in own[:-1])])
    inside = np.ones(len(raw), bool)
    inside[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[inside[DEPTH:]]


def words(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the pieces, each text's end as a word of its own, and how many each piece has."""
    lists = [x.removesuffix(END).split() for x in own]
    sizes = np.array([len(w) + x.endswith(END) for w, x in zip(lists, own, strict=True)], np.int64)
    out = np.fromiter((h for w, x in zip(lists, own, strict=True) for h in (*map(xxhash.xxh3_64_intdigest, w), *([int(_END_WORD)] if x.endswith(END) else ()))), np.uint64, int(sizes.sum()))
    return out, sizes


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def packed(docs: pa.RecordBatch) -> bytes:
    """Some documents as one compressed value, about a third of what they take as rows of a shuffle."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(docs)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def gathered(docs: DataFrame) -> DataFrame:
    """The texts by block, and for each block its different strings and words with their training counts; stored by kind."""
    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("kind", pa.int32())])

    def batch_of(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        parts: dict[int, list] = {GRAM: [], WORD: []}

        def closed() -> Iterator[pa.RecordBatch]:
            for kind in (GRAM, WORD):
                keys, n = _summed(parts[kind])
                parts[kind] = []
                for at in range(0, len(keys), 100_000):
                    own = keys[at : at + 100_000].view(np.int64)
                    yield batch_of(kind=pa.array(np.full(len(own), kind)), block=pa.array(np.full(len(own), block)), key=pa.array(own), n=pa.array(n[at : at + 100_000]))

        for whole in batches:
            for begin in range(0, len(whole), 1024):
                batch = whole.slice(begin, 1024)
                texts = [(t or "").encode().lower() for t in batch["text"].to_pylist()]
                unseen = batch["held_out"].to_pylist()
                docs = pa.record_batch({"row": batch["row"], "doc_id": batch["doc_id"], "held_out": batch["held_out"], "text": pa.array(texts, pa.large_binary())})
                yield batch_of(kind=pa.array([DOC]), block=pa.array([block]), docs=pa.array([packed(docs)], pa.binary()))
                for taught in (True, False):
                    for _, before, own in pieces([t for t, u in zip(texts, unseen, strict=True) if u != taught]):
                        for kind, found in ((GRAM, grams(before, own)), (WORD, words(own)[0])):
                            keys, n = np.unique(found, return_counts=True)
                            parts[kind].append((keys, n * taught))
                            if len(parts[kind]) >= 8:
                                parts[kind] = [_summed(parts[kind])]
                size += sum(map(len, texts))
                if size >= BLOCK:
                    yield from closed()
                    block, size = block + 1, 0
        if parts[GRAM]:
            yield from closed()

    names = dict(c.split() for c in _ROWS.split(", "))
    return staged(docs.mapInArrow(gather, ", ".join(f"{f.name} {names[f.name]}" for f in schema)), "kind", compression="zstd")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from a half up: by Stirling's series above 10, to which smaller ones are lifted."""
    lifted, shift = np.array(x, np.float64), np.zeros(len(x))
    for _ in range(10):
        low = lifted < 10
        shift[low] += np.log(lifted[low])
        lifted[low] += 1
    inverse = 1 / lifted
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return (lifted - 0.5) * np.log(lifted) - lifted + 0.5 * np.log(2 * np.pi) + series - shift


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of Krichevsky and Trofimov's probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def weighted(estimate: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of a node's weighted probability, and the weight of its own estimate in it."""
    total = np.log(0.5) + np.logaddexp(estimate, below)
    return total, np.exp(np.log(0.5) + estimate - total)


def places(symbol: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the 255 decisions a byte comes to at a level, and which way it goes."""
    return (1 << level) | (symbol >> (8 - level)), (symbol >> (7 - level)) & 1


def subtree(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """For all strings of some contexts of ``SHARED`` bytes: the mixture of depths from there on for each of the eight bits of
    the last byte (nan where the training had nothing), and (context, decision, weighted probability, zeros, ones) there."""
    symbol, context = (key & 255).astype(np.int64), key >> 8
    mixed, tops = np.full((len(key), 8), np.nan), []
    for level in range(8):
        place, bit = places(symbol, level)
        nodes = []
        for depth in range(SHARED, DEPTH + 1):
            own = (context & ((1 << 8 * depth) - 1)) << 8 | place
            _, first, of = np.unique(own, return_index=True, return_inverse=True)
            nodes.append((first, of, np.bincount(of, n * (1 - bit)), np.bincount(of, n * bit)))
        first, of, a, b = nodes[-1]
        total = log_estimate(a, b)
        here, seen = ((b + 0.5) / (a + b + 1))[of], (a + b > 0)[of]
        for up_first, up_of, up_a, up_b in reversed(nodes[:-1]):
            below = np.bincount(up_of[first], total, len(up_first))
            total, weight = weighted(log_estimate(up_a, up_b), below)
            estimate, weight = ((up_b + 0.5) / (up_a + up_b + 1))[up_of], weight[up_of]
            here, seen = np.where(seen, weight * estimate + (1 - weight) * here, estimate), (up_a + up_b > 0)[up_of]
            first, a, b = up_first, up_a, up_b
        mixed[:, level] = np.where(seen, here, np.nan)
        tops.append((context[first] & ((1 << 8 * SHARED) - 1), place[first], total, a, b))
    return mixed, tops


_NODES = "context int, place int, total double, a double, b double"
_PARENTS = "kind int, context int, place int, total double, a double, b double"


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[name].to_numpy() for name in names]


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(key, value): base-10 logarithm of the probability of a string's last byte after the others, from (key, n).

    First every group, which holds all strings of some contexts of three bytes, tells its nodes at that depth. The nodes that share two,
    at most 256 by 255, give their parents, which are sent back, one for each node; those of one byte and of none are at
    most 65,536 and go to every task. The groups then work out their strings' values, from the deepest node up.
    """
    groups = -(-max(1, counts.count()) // GROUP)
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).cast("int")
    group = F.pmod(F.xxhash64("context"), F.lit(groups)).cast("int")
    strings = counts.select(context.alias("context"), "key", "n").select(group.alias("group"), "key", "n")

    def shared_nodes(rows: pa.Table) -> pa.Table:
        key, n = _columns(rows, "key", "n")
        _, tops = subtree(key, n.astype(np.float64))
        context, place, total, a, b = (np.concatenate(x) for x in zip(*tops, strict=True))
        return pa.table({"context": context.astype(np.int32), "place": place.astype(np.int32), "total": total, "a": a, "b": b})

    def parents(rows: pa.Table) -> pa.Table:
        context, place, total, a, b = _columns(rows, "context", "place", "total", "a", "b")
        below, zeros, ones = (np.bincount(place, x, 256) for x in (total, a, b))
        up, weight = weighted(log_estimate(zeros, ones), below)
        here = np.flatnonzero(np.bincount(place, minlength=256))
        sent = {"kind": np.zeros(len(context), np.int32), "context": context, "place": place, "total": weight[place], "a": zeros[place], "b": ones[place]}
        kept = {"kind": np.ones(len(here), np.int32), "context": np.full(len(here), context[0] & 255, np.int32), "place": here.astype(np.int32), "total": up[here], "a": zeros[here], "b": ones[here]}
        return pa.table({name: np.concatenate([sent[name], kept[name]]) for name in sent})

    nodes = staged(strings.groupBy("group").applyInArrow(shared_nodes, _NODES))
    two = F.col("context").bitwiseAND(F.lit(0xFFFF))
    above = staged(nodes.groupBy(two.alias("two")).applyInArrow(parents, _PARENTS), "kind")
    tops = above.where("kind = 1").groupBy(F.col("context").alias("last"), "place").agg(*[F.sum(c).alias(c) for c in ("total", "a", "b")])
    # At most 256 last bytes by 255 decisions.
    one = tops.collect()
    estimate, weight, seen = np.full((2, 256, 256), 0.5), np.ones((2, 256, 256)), np.zeros((2, 256, 256), bool)
    if one:
        last, place = np.array([r["last"] for r in one]), np.array([r.place for r in one])
        total, a, b = (np.array([r[c] for r in one]) for c in ("total", "a", "b"))
        up, w = weighted(log_estimate(a, b), total)
        estimate[1, last, place], weight[1, last, place], seen[1, last, place] = (b + 0.5) / (a + b + 1), w, a + b > 0
        below, zeros, ones = (np.bincount(place, x, 256) for x in (up, a, b))
        _, w = weighted(log_estimate(zeros, ones), below)
        estimate[0, 0], weight[0, 0] = (ones + 0.5) / (zeros + ones + 1), w

    def finish(rows: pa.Table, sent: pa.Table) -> pa.Table:
        key, n = _columns(rows, "key", "n")
        mixed, _ = subtree(key, n.astype(np.float64))
        contexts, at, w2, a, b = _columns(sent, "context", "place", "total", "a", "b")
        known = np.unique(contexts)
        of_two = np.zeros((3, len(known), 256))
        of_two[:, np.searchsorted(known, contexts), at] = w2, (b + 0.5) / (a + b + 1), a + b > 0
        own = np.searchsorted(known, (key >> 8) & ((1 << 8 * SHARED) - 1))
        last, symbol, value = (key >> 8) & 255, key & 255, np.zeros(len(key))
        for level in range(8):
            place, bit = places(symbol, level)
            w, e, trained = of_two[:, own, place]
            p = np.where(np.isnan(mixed[:, level]), e, w * e + (1 - w) * mixed[:, level])
            w, e = weight[1, last, place], estimate[1, last, place]
            p = np.where(trained > 0, w * e + (1 - w) * p, e)
            w, e = weight[0, 0, place], estimate[0, 0, place]
            p = np.where(seen[1, last, place], w * e + (1 - w) * p, e)
            value += np.log10(np.where(bit == 1, p, 1 - p))
        return pa.table({"key": rows["key"], "value": value})

    back = above.where("kind = 0").drop("kind").withColumn("group", group)
    return staged(strings.groupBy("group").cogroup(back.groupBy("group")).applyInArrow(finish, "key long, value double"))


_SCORES = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_sum double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte.

    Learns from all documents that are not held out. A null or empty text is its end alone. Rows that repeat a document
    count each. A null doc_id is not held out. Strings and words are told apart by 64-bit numbers (strings exactly). No
    rows give no rows; with nothing to learn from every bit has the probability one half.
    """
    ids = F.col("doc_id").cast("long")
    rows = gathered(docs.select(F.monotonically_increasing_id().alias("row"), ids.alias("doc_id"), held_out(ids).alias("held_out"), "text"))
    asked = {kind: rows.where(F.col("kind") == kind).select("block", "key", "n") for kind in (GRAM, WORD)}
    totals = {kind: staged(x.groupBy("key").agg(F.sum("n").alias("n"))) for kind, x in asked.items()}
    known = totals[WORD].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    tokens, vocabulary = int(known.n), int(known.v)
    values = log_probabilities(totals[GRAM])
    told = asked[GRAM].join(values, "key").select("block", F.lit(GRAM).alias("kind"), "key", "value")
    counted = asked[WORD].select("block", "key").join(totals[WORD], "key").select("block", F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value"))
    texts = rows.where(F.col("kind") == DOC).select(F.col("block").alias("of_block"), "docs")

    def score(answers: pa.Table, asking: pa.Table) -> pa.Table:
        ready = {}
        for k in (GRAM, WORD):
            of = answers.filter(pc.equal(answers["kind"], k))
            keys, values = of["key"].to_numpy().view(np.uint64), of["value"].to_numpy()
            order = np.argsort(keys)
            ready[k] = keys[order], values[order]
        done = []
        for payload in asking["docs"]:
            docs = unpacked(payload.as_buffer())
            texts = docs["text"].to_pylist()
            sums = np.zeros((len(texts), 4))
            for owner, before, own in pieces(texts):
                keys, values = ready[GRAM]
                logs = values[np.searchsorted(keys, grams(before, own))]
                sizes = np.array([len(x) for x in own])
                np.add.at(sums[:, 0], owner, np.add.reduceat(np.r_[logs, 0.0], np.cumsum([0, *sizes[:-1]])) * (sizes > 0))
                keys, values = ready[WORD]
                hashes, sizes = words(own)
                counts = values[np.searchsorted(keys, hashes)]
                starts = np.cumsum([0, *sizes[:-1]])
                for column, x in ((1, np.log10(counts + 1)), (2, (counts > 0).astype(float))):
                    np.add.at(sums[:, column], owner, np.add.reduceat(np.r_[x, 0.0], starts) * (sizes > 0))
                np.add.at(sums[:, 3], owner, sizes)
            done.append(pa.table({
                "row": docs["row"], "doc_id": docs["doc_id"], "held_out": docs["held_out"],
                "n_bytes": np.array(list(map(len, texts)), np.int64), "n_tokens": sums[:, 3].astype(np.int64),
                "n_known": sums[:, 2].astype(np.int64), "base_sum": sums[:, 1], "score": sums[:, 0],
            }))
        return pa.concat_tables(done)

    answers = told.unionByName(counted)
    scored = answers.groupBy("block").cogroup(texts.groupBy("of_block")).applyInArrow(score, _SCORES)
    base = F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(float(tokens + vocabulary + 1)))
    bits = -F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)
    return scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents")).drop("row")
