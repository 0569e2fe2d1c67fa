"""Groups spelling variants: words at one edit from each other, found through a reduced alphabet.

The letters are hashed to a few symbols, so a word becomes a short string over a small alphabet and an edit of the word
becomes an edit of that string, or none. A small alphabet makes it possible to write down the whole neighbourhood of a
reduced word, everything one insertion, deletion or replacement away, which a full alphabet would not; joined with the
reduced words that occur, it yields every pair of words that may be near, and the words themselves decide.

Words are counted in the map tasks, a bounded dictionary at a time, and the counts are added by Spark. Neighbourhoods are
those of the different reduced words and carry no words; words are fetched for reduced pairs that exist. The number of
symbols grows with the eighth root of the number of words, so that a word meets about as many others in a larger vocabulary.
Near words are counted and the form is a minimum, both partial aggregates, so a word near to very many others is no group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import staged, table

MIN_LENGTH = 6
MIN_COUNT = 5
TIMES = 5
# A run whose hash this divides loses a letter.
DAMAGE = 199
# Different words that a task counts before it passes them on, and bytes of a text that it splits at once.
HELD = 200_000
PIECE = 1 << 20
FEWEST_SYMBOLS = 4

# Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 whose ASCII letters are lower case: the latter are C3 and a second byte.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_OTHER = re.compile(rb"[^A-Za-z\x80-\xbf\xc3]")
LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]


def runs(text: bytes) -> Iterator[Counter]:
    """How often each lower-cased run occurs, for one piece of the text after the other; pieces end between runs."""
    begin = 0
    while begin < len(text):
        end = len(text)
        if end - begin > PIECE and (gap := _OTHER.search(text, begin + PIECE)):
            end = gap.start()
        yield Counter(_RUN.findall(text[begin:end].lower()))
        begin = end


def damaged(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents (doc_id, text), before the smallest count is asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            words = [w.decode() for w in total]
            return pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                view = text.as_buffer()
                for found in runs(b"" if view is None else view.to_pybytes()):
                    for run, n in found.items():
                        if len(run) < MIN_LENGTH:
                            continue
                        h = zlib.crc32(run, start)
                        if h % DAMAGE == 0:
                            run = damaged(run, h)
                        # As many bytes may be fewer letters.
                        if len(run) >= 2 * MIN_LENGTH or len(run) - run.count(b"\xc3") >= MIN_LENGTH:
                            total[run] += n
                    if len(total) > HELD:
                        yield passed_on()
                        total.clear()
        yield passed_on()

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def symbols_for(words: int) -> int:
    """The fewest symbols whose strings of eight letters outnumber the words sixteen times."""
    symbols = FEWEST_SYMBOLS
    while symbols**8 < 16 * words:
        symbols += 1
    return symbols


def reduced(word: Column, symbols: int) -> Column:
    """The word with each letter hashed to one of ``symbols`` symbols."""
    codes = "".join(chr(ord("a") + zlib.crc32(letter.encode()) % symbols) for letter in LETTERS)
    return F.translate(word, "".join(LETTERS), codes)


def neighbourhood(word: Column, symbols: int) -> Column:
    """The word, and all strings one deletion, replacement or insertion away over the reduced alphabet, each once."""
    letters = F.array(*[F.lit(chr(ord("a") + s)) for s in range(symbols)])
    size = F.length(word)
    places = F.sequence(F.lit(1), size)

    def before(i: Column) -> Column:
        return F.substring(word, F.lit(1), i - 1)

    def after(i: Column) -> Column:
        return F.substring(word, i + 1, size)

    deleted = F.transform(places, lambda i: F.concat(before(i), after(i)))
    replaced = F.transform(places, lambda i: F.transform(letters, lambda s: F.concat(before(i), s, after(i))))
    gaps = F.sequence(F.lit(1), size + 1)
    inserted = F.transform(gaps, lambda i: F.transform(letters, lambda s: F.concat(before(i), s, after(i - 1))))
    return F.array_distinct(F.concat(deleted, F.flatten(replaced), F.flatten(inserted)))


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """(word, other, other_n) for all pairs of different ``words`` (word, n) at one edit, in both directions."""
    coded = staged(words.withColumn("code", reduced(F.col("word"), symbols)))
    codes = coded.select("code").distinct()
    around = codes.select("code", F.explode(neighbourhood(F.col("code"), symbols)).alias("around"))
    met = around.join(codes.withColumnRenamed("code", "around"), "around")
    others = coded.select(F.col("code").alias("around"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = coded.select("code", "word").join(met, "code").join(others, "around")
    # Different words are at least one edit apart.
    return pairs.where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: the last of its forms, by doubling the steps. A form is far more frequent
    than its word, so chains have an end and few links."""
    links = staged(forms)
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        moved = staged(moved)
        if not moved.where("moved").limit(1).count():
            return moved.select("word", F.col("to").alias("root"))
        links = moved.select("word", "to")


def variants(docs: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs`` (doc_id, text); other columns are not read.

    Null and empty texts have no words, and texts of any length are read whole, a piece at a time. A null doc_id is hashed as
    an empty one. Repeated rows count each time. Of near words that are equally frequent the smallest by code point is taken;
    Spark compares UTF-8 bytes, which is the same order. Without documents, or words, there are no rows.
    """
    words = staged(word_counts(docs).where(F.col("n") >= MIN_COUNT))
    pairs = near_pairs(words, symbols or symbols_for(words.count()))
    first = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    told = words.join(near, "word", "left")
    form_n = -F.col("first.less")
    large = form_n >= TIMES * F.col("n")
    formed = staged(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("first.word")).alias("form"), F.when(large, form_n).alias("form_n"),
    ))
    ends = roots(formed.where("form is not null").select("word", F.col("form").alias("to")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """Pairs are found through strings that two words share when each loses a letter."""
    return f"""
with recursive steps as (
  select v as i, v as c, 0 as round from generate_series(0, 255) g(v)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, round + 1 from steps where round < 8),
crc_table as materialized (select list(c order by i) as t from steps where round = 8),
runs as materialized (
  select doc_id, run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as raw from documents),
       lateral (select translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run)
  where length(run) >= {MIN_LENGTH} group by all),
hashed as materialized (
  select run, n,
         xor(list_reduce(list_transform(range(1, octet_length(b) + 1), lambda i: cast(('0x' || substr(hex(b), 2 * i - 1, 2)) as bigint)),
             lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) as h
  from (select *, encode(coalesce(cast(doc_id as varchar), '') || ':' || run) as b from runs), crc_table),
words as materialized (
  select word, cast(sum(n) as bigint) as n
  from (select n, case when h % {DAMAGE} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from hashed)
  where length(word) >= {MIN_LENGTH} group by word having sum(n) >= {MIN_COUNT}),
cut as materialized (
  select word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) as rest
  from (select word, n, unnest(generate_series(1, length(word))) as spot from words)),
near as materialized (
  select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.spot = b.spot and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cut c join words w on c.rest = w.word),
told as materialized (
  select word, count(*) as n_near, first(other order by other_n desc, other) as best, max(other_n) as best_n from near group by word),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= {TIMES} * n then best end as form,
         case when best_n >= {TIMES} * n then best_n end as form_n
  from words w left join told using (word)),
chains as (
  select word, word as root, 0 as depth from formed
  union all
  select c.word, f.form, depth + 1 from chains c join formed f on c.root = f.word and f.form is not null),
ends as (select word, last(root order by depth) as root from chains group by word)
select word, form, root, n, n_near, form_n from formed join ends using (word)"""
