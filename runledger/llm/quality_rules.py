"""Quality rules: how far a text's character classes and common words are from its language's, with DataFrame functions only.

Each document gets two histograms: of the classes of its characters, and of the common words of its language (a short
list of function words, and one bin for all other words). Its Jensen-Shannon distance (0 to 1) to the mean histogram of
the language tells tables, symbol noise, shouting and word salad from prose. Two plain rules come first: too few words, and
too many repeated ones. In the query, as in its SQL, a distance counts only where the text is long enough; what the pipeline
keeps is held against the references at every length, with limits that allow for the chance in a short histogram.

Texts are measured once, row by row and without a shuffle; the references are two short means for each language.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import SPACES, staged, table

# The most frequent function words of each language.
COMMON = {
    "de": "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als auch es an er".split(),
    "en": "the of and to a in is that it for was on with as be by are this at from he or his not".split(),
    "es": "de la que el en y los las se del un por con no una su para es al lo como más o pero".split(),
    "fr": "de la le et les des en un du une que est pour par dans avec qui pas sur au il ne se ce".split(),
}
# Taken off one after the other: what is left after the last is the last class.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"[\x20\x09-\x0D]+", r"[.,;:'!?()-]+", r"\p{L}+", r"\p{Nd}+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # in 100 words
# Shorter texts are not held against the references in the query; in the pipeline they are, with wider limits.
MIN_CHARS_FOR_CLASSES = 500
MIN_WORDS_FOR_COMMON = 100
MOST_CLASS_DISTANCE = 0.25
MOST_COMMON_DISTANCE = 0.3
# What chance alone makes of a short text of its language is below the limit in this share of texts.
BY_CHANCE = 0.999

MEASURES = "quality measures"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for each row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows (of 2, 4, 8, ... words) that occur twice or more in the text, compared by a 64-bit hash."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        # Each place adds the words that the one before does not cover yet.
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        add = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"))
        return F.aggregate(let(placed, places), start, add)["n"]

    def pairs(h: Column, apart: int) -> Column:
        return F.zip_with(h, F.slice(h, 1 + apart, F.greatest(F.size(h) - apart, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def found(w: Column) -> Column:
        # Hashes of 2, 4, ... words from the hashes of half as many; the last ones reach beyond the text.
        hashes, apart = pairs(w, 1), 2
        while apart < window:
            hashes, apart = let(hashes, lambda h: pairs(h, apart)), 2 * apart  # noqa: B023
        windows = F.slice(hashes, 1, F.size(w) - (window - 1))
        return let(windows, lambda x: F.when(F.size(x) == F.size(F.array_distinct(x)), F.lit(0)).otherwise(covered(x)))

    return let(words, lambda w: F.when(F.size(w) < window, F.lit(0)).otherwise(found(w)))


def _class_counts(text: Column) -> Column:
    def strip(state: Column, pattern: Column) -> Column:
        taken = lambda rest: F.array((F.length(state["rest"]) - F.length(rest)).cast("long"))
        return let(F.regexp_replace(state["rest"], pattern, F.lit("")), lambda rest: F.struct(rest.alias("rest"), F.concat(state["counts"], taken(rest)).alias("counts")))

    start = F.struct(text.alias("rest"), F.array().cast("array<long>").alias("counts"))
    last = lambda s: F.concat(s["counts"], F.array(F.length(s["rest"]).cast("long")))
    return F.aggregate(F.array(*map(F.lit, CLASSES)), start, strip, last)


def _counts_of(common: list[str], words: Column) -> Column:
    """How often each of the common words occurs, in their order, then how many words are others."""

    def bins(known: Column) -> Column:
        each = F.transform(F.array(*map(F.lit, common)), lambda c: F.size(F.filter(known, lambda w: w == c)).cast("long"))
        return F.concat(each, F.array((F.size(words) - F.size(known)).cast("long")))

    return let(F.filter(F.transform(words, F.lower), lambda w: w.isin(common)), bins)


def _common_counts(words: Column, lang: Column) -> Column:
    counts = F.lit(None).cast("array<long>")
    for name, common in sorted(COMMON.items()):
        counts = F.when(lang == name, _counts_of(common, words)).otherwise(counts)
    return counts


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang and any others) with their measures, a struct in the column ``MEASURES``, stored."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(w: Column) -> Column:
        common = _common_counts(w, F.col("lang"))
        classes = _class_counts(text)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            classes.alias("classes"),
            common.alias("common"),
        )

    kept = [F.col(f"`{c}`") for c in docs.columns]
    return staged(docs.select(*kept, let(words, of).alias(MEASURES)))


def _shares(counts: Column) -> Column:
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x), lambda n: F.transform(c, lambda x: x / n)))


def _ready(rows: DataFrame, any_length: bool = False) -> DataFrame:
    m = F.col(f"`{MEASURES}`")
    size = F.aggregate(m["classes"], F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn(
        "quality shares",
        F.struct(
            F.when(size >= (1 if any_length else MIN_CHARS_FOR_CLASSES), _shares(m["classes"])).alias("classes"),
            F.when(m["n_words"] >= (1 if any_length else MIN_WORDS_FOR_COMMON), _shares(m["common"])).alias("common"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def references(rows: DataFrame, any_length: bool = False) -> dict[str, tuple[list[float], list[float]]]:
    """Mean shares of the documents of each language that pass the plain rules; one row for each language of ``COMMON``."""
    rows = _ready(rows.select("lang", f"`{MEASURES}`").where(F.col("lang").isin(*COMMON) & ~base_failed(F.col(f"`{MEASURES}`"))), any_length)
    s = F.col("quality shares")
    sizes = {"classes": len(CLASSES) + 1, "common": len(next(iter(COMMON.values()))) + 1}
    means = [F.array(*[F.avg(F.get(s[k], F.lit(i))) for i in range(n)]).alias(k) for k, n in sizes.items()]
    return {r.lang: (r.classes, r.common) for r in rows.groupBy("lang").agg(*means).collect()}


def distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance: the root of the divergence in bits."""

    def term(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
        return part(p) + part(q)

    parts = F.zip_with(shares, reference, term)
    found = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))
    return F.when(shares.isNotNull() & reference.isNotNull(), found)


def all_references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """As ``references``; a language without a text of the length that they ask for has the means of its shorter ones."""
    found = references(rows)
    if all(None not in means for own in found.values() for means in own):
        return found
    shorter = references(rows, any_length=True)
    return {lang: tuple(s if None in m else m for m, s in zip(own, shorter[lang], strict=True)) for lang, own in found.items()}


def chance_limits(means: list[float], below: int, most: float) -> list[float]:
    """The limit for texts of 0, 1, ... ``below`` words or characters: ``most``, or what draws from ``means`` reach by chance."""
    rng, q = np.random.default_rng(11), np.array(means)
    q = q / q.sum()
    sizes = [*range(1, min(below, 100)), *range(100, below, 20)]
    found = []
    for n in sizes:
        p = rng.multinomial(n, q, 4_000) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            both = np.where(p > 0, p * np.log2(2 * p / (p + q)), 0).sum(1) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0).sum(1)
        found.append(np.quantile(np.sqrt(np.maximum(0, both / 2)), BY_CHANCE))
    return [float(x) for x in np.maximum(most, np.interp(range(below), sizes, found))] + [most]


def judged_at_any_length(rows: DataFrame, reference: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Adds ``quality kept``: whether a text passes the plain rules and, however short, is near its language."""
    m = F.col(f"`{MEASURES}`")
    size = F.aggregate(m["classes"], F.lit(0).cast("long"), lambda s, x: s + x)
    far = F.lit(False)
    for lang, own in sorted(reference.items()):
        compared = (("classes", size, own[0], MIN_CHARS_FOR_CLASSES, MOST_CLASS_DISTANCE), ("common", m["n_words"], own[1], MIN_WORDS_FOR_COMMON, MOST_COMMON_DISTANCE))
        for name, n, means, below, most in compared:
            if None not in means:
                limit = F.get(F.array(*map(F.lit, chance_limits(means, below, most))), F.least(n, F.lit(below)).cast("int"))
                own_distance = distance(F.when(n > 0, _shares(m[name])), F.array(*map(F.lit, means)))
                far = far | F.coalesce((F.col("lang") == lang) & (own_distance > limit), F.lit(False))
    return rows.withColumn("quality kept", F.when(~base_failed(m), ~far).otherwise(F.lit(False)))


def judged(rows: DataFrame, reference: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Adds ``quality verdict``: class_distance, common_distance (null where not compared), base_failed and kept."""

    def of_language(k: int) -> Column:
        out = F.lit(None).cast("array<double>")
        for lang, means in sorted(reference.items()):
            if means[k] and None not in means[k]:
                out = F.when(F.col("lang") == lang, F.array(*map(F.lit, means[k]))).otherwise(out)
        return out

    rows = _ready(rows)
    s, m = F.col("quality shares"), F.col(f"`{MEASURES}`")
    found = F.struct(distance(s["classes"], of_language(0)).alias("class_distance"), distance(s["common"], of_language(1)).alias("common_distance"))
    rows = rows.withColumn("quality found", found)
    f = F.col("quality found")
    far = F.coalesce(f["class_distance"] > MOST_CLASS_DISTANCE, F.lit(False)) | F.coalesce(f["common_distance"] > MOST_COMMON_DISTANCE, F.lit(False))
    verdict = F.struct(f["class_distance"].alias("class_distance"), f["common_distance"].alias("common_distance"), base_failed(m).alias("base_failed"), (~base_failed(m) & ~far).alias("kept"))
    return rows.withColumn("quality verdict", verdict).drop("quality shares", "quality found")


def quality_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang and any others) with measures and verdict.

    A null text has no words and fails; a text of a language without a reference, or of no language, is held to the plain
    rules alone; every row is judged on its own, so repeated rows get the same verdict. No rows give no rows.
    """
    rows = measured(docs)
    return judged(rows, references(rows))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the plain rules and are near their language, at any length, with their columns.

    Not the query's ``kept``: that one takes every text below its SQL's guards that passes the plain rules.
    """
    rows = measured(docs)
    kept = judged_at_any_length(rows, all_references(rows)).where("`quality kept`")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    m, v = F.col(f"`{MEASURES}`"), F.col("`quality verdict`")
    return docs.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        v["base_failed"].alias("base_failed"),
        v["kept"].alias("kept"),
    )


def oracle_sql() -> str:
    """The query in DuckDB's SQL."""
    stripped, names = [], ["t"]
    for k, pattern in enumerate(CLASSES):
        stripped.append(f"regexp_replace({names[-1]}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS s{k}")
        names.append(f"s{k}")
    layers = "SELECT r, t FROM words"
    for layer in stripped:
        layers = f"SELECT *, {layer} FROM ({layers})"
    lengths = [f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)] + [f"length({names[-1]})"]
    common = ", ".join(f"('{lang}', {k}, '{w}')" for lang, ws in COMMON.items() for k, w in enumerate(ws))
    counted = ", ".join(f"{x} AS c{k}" for k, x in enumerate(lengths))
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws,
         list_transform(list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> ''), lambda x: lower(x)) AS lower_words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
),
windows AS (
  SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k
  FROM words, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)
),
repeated AS (
  SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows), range({WINDOW}) AS o(j)
  WHERE c > 1 GROUP BY r
),
base AS (
  SELECT w.r, doc_id, lang, t, lower_words, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM words w LEFT JOIN repeated USING (r)
),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base),
classes AS (
  SELECT r, bin, n / sum(n) OVER (PARTITION BY r) AS share
  FROM (SELECT r, unnest([{", ".join(f"c{i}" for i in range(len(lengths)))}]) AS n, unnest(range({len(lengths)})) AS bin
        FROM (SELECT r, t, {counted} FROM ({layers}) WHERE length(t) >= {MIN_CHARS_FOR_CLASSES}))
),
lists(lang, bin, w) AS (VALUES {common}),
long_enough AS (SELECT r, lang, n_words, lower_words FROM judged WHERE n_words >= {MIN_WORDS_FOR_COMMON} AND lang IN (SELECT lang FROM lists)),
heard AS (SELECT r, l.lang, l.bin, count(*) AS n FROM (SELECT r, lang, unnest(lower_words) AS w FROM long_enough) x JOIN lists l ON l.lang = x.lang AND l.w = x.w GROUP BY ALL),
binned AS (
  SELECT e.r, l.bin, coalesce(h.n, 0) AS n, e.n_words FROM long_enough e JOIN lists l USING (lang) LEFT JOIN heard h ON h.r = e.r AND h.bin = l.bin
  UNION ALL
  SELECT e.r, 1000, e.n_words - coalesce((SELECT sum(n) FROM heard h WHERE h.r = e.r), 0), e.n_words FROM long_enough e
),
shares AS (SELECT 'class' AS kind, r, bin, share FROM classes UNION ALL SELECT 'common', r, bin, n / n_words FROM binned),
of_language AS (SELECT kind, lang, bin, avg(share) AS q FROM shares JOIN judged USING (r) WHERE NOT base_failed AND lang IN (SELECT lang FROM lists) GROUP BY ALL),
distances AS (
  SELECT kind, r, sqrt(greatest(0, sum(CASE WHEN share > 0 THEN share * log2(2 * share / (share + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (share + q)) ELSE 0 END) / 2)) AS d
  FROM shares s JOIN judged USING (r) JOIN of_language o USING (kind, lang, bin) GROUP BY kind, r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(a.d <= {MOST_CLASS_DISTANCE}, true) AND coalesce(b.d <= {MOST_COMMON_DISTANCE}, true) AS kept
FROM judged j LEFT JOIN distances a ON a.r = j.r AND a.kind = 'class' LEFT JOIN distances b ON b.r = j.r AND b.kind = 'common'
"""
