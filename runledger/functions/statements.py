"""Statement text to shape: normalization, shape key, fingerprint, flags and preview.

Everything is a column expression over the whole text. The regexes use possessive quantifiers throughout, so they run in
linear time and constant stack on statements of any length.

Functions that take a normalized statement use it several times. Give them a column that holds it (``with_normalized``)
rather than the expression, or every use normalizes the text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import BLANK_CLASS, BLANKS, PREVIEW_SPACE, char_class
from runledger.schema import STATEMENT_FLAGS

# How much of a statement a list shows, and the note under a copied one that was cut.
PREVIEW_LEN = 2000
CUT_NOTE = "-- This query was cut at {} characters and is not complete."

# Lexical pieces of a statement. ASCII has alternatives of its own, first, because regexes test those fastest. A word is
# read in pieces: each starts with a letter and takes the ASCII letters and digits that follow.
_BLANK = f"[{BLANK_CLASS}]"
_LINE_COMMENT = r"--[^\n]*+"
_BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
_STRING = r"'[^']*+(?:''[^']*+)*+'?"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"?'
_WORD = r"[A-Za-z_][A-Za-z0-9_]*+"
_OTHER_WORD = r"[[^\x00-\x7F]&&[\p{IsAlphabetic}\p{N}]][A-Za-z0-9_]*+"
_MARKS = r"[\x00-!#-&(-,.:-@\[-\^`{-\x7F]++"  # ASCII without quotes, digits, word characters, minus and slash
_NUMBER = r"[0-9][0-9.]*+"

# Everything up to the next literal, then the literal. \G ties each match to the end of the one before, so a quote inside
# a comment or an identifier never starts a literal.
_TO_LITERAL = (
    rf"\G((?:{_WORD}|{_MARKS}|{_LINE_COMMENT}|{_BLOCK_COMMENT}|[-/]|{_QUOTED}|{_OTHER_WORD}|[^\x00-\x7F])*+)"
    rf"(?:{_STRING}|{_NUMBER})"
)

# The same for white space and comments, once literals are gone. A lone space between ordinary characters stays.
_TO_GAP = (
    rf"\G((?:[!#-,.0-~]++| (?=[!-,.0-~])|{_QUOTED}|-(?!-)|/(?!\*)|[^\x21-\x7E{BLANK_CLASS}]++)*+)"
    rf"(?: |{_BLANK}|{_LINE_COMMENT}|{_BLOCK_COMMENT})++"
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def _spaced(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, _TO_LITERAL, "$1?"), _TO_GAP, "$1 ")


def _finished(spaced: Column) -> Column:
    pieces = F.regexp_extract_all(spaced, F.lit(rf'{_QUOTED}|[^"]++'), F.lit(0))
    lowered = F.transform(pieces, lambda piece: F.when(piece.startswith('"'), piece).otherwise(_ascii_lower(piece)))
    flat = F.when(F.contains(spaced, F.lit('"')), F.array_join(lowered, "")).otherwise(_ascii_lower(spaced))
    return F.regexp_replace(F.btrim(flat, F.lit(BLANKS)), r"\?(?:, \?)++", "?")


def normalize(sql: Column) -> Column:
    """Comments go, literals become ``?``, case and white space are flattened; quoted identifiers and digits that
    continue a name stay. Placeholder lists of any length become one placeholder."""
    return _finished(_spaced(sql))


def with_normalized(rows: DataFrame, text: str, name: str = "normalized_sql") -> DataFrame:
    """Adds the normalized statement, computed once per row: Spark does not merge projections over a costly column that
    is used more than once."""
    return rows.withColumn(name, _spaced(F.col(text))).withColumn(name, _finished(F.col(name)))


# Texts that start like a query and that no parser takes. Words that may follow others in an expression or end a list:
_JOINING = (
    "all|and|any|array|as|asc|asof|at|between|by|case|cast|collate|cross|current|date|desc|distinct|double|else|end|escape|"
    "except|exclude|exists|filter|first|following|for|from|full|glob|group|having|ignore|ilike|in|inner|intersect|interval|"
    "into|is|isnull|join|lambda|last|lateral|left|like|limit|natural|not|notnull|nulls|offset|on|or|order|over|partition|"
    "positional|preceding|qualify|range|replace|respect|right|row|rows|sample|select|semi|anti|similar|some|struct|"
    "tablesample|then|time|timestamp|to|try_cast|unbounded|union|using|values|when|where|window|with|within|without|zone"
)
_PLAIN_WORD = rf"(?!(?:{_JOINING})\b)[a-z_][a-z0-9_]*+"
_CLAUSE = r"(?:from|where|group by|having|order by|limit)\b"
_BROKEN = "|".join(
    [
        # a clause that is empty
        rf"\bselect(?: all| distinct)? ?(?:{_CLAUSE}|[);]|$)",
        rf"(?:\b(?:(?<!distinct )from|where|having|group by|order by|join|and|or|not)|[=<>+*/(]) ?(?<![*(] ?){_CLAUSE}",
        r"(?:\b(?:(?<!distinct )from|where|having|group by|order by|join|and|or|not)|[=<>+/-]) ?(?:[);]|$)",
        # clauses out of order on one level
        rf"\b(?:group by|order by|having|limit)\b(?:(?!\b(?:{_CLAUSE}|select|union|intersect|except)\b)[^();])*+\bwhere\b",
        rf"\blimit\b(?:(?!\b(?:{_CLAUSE}|select|union|intersect|except)\b)[^();])*+\b(?:order by|group by|having)\b",
        # a list item of three names that nothing joins
        rf"(?:\bselect(?: all| distinct)?|,) ?{_PLAIN_WORD} {_PLAIN_WORD} {_PLAIN_WORD}(?![(.])",
    ]
)


def is_select(normalized: Column) -> Column:
    """Whether the statement is a query of its own, as opposed to DDL, DML or text that only contains one."""
    writes = r"^\(*+with\b.* as (?:(?:not )?materialized )?\((?s:.*)\) (?:insert|update|delete|merge) "
    unquoted = F.regexp_replace(normalized, _QUOTED, "q")
    count = lambda mark: F.length(unquoted) - F.length(F.replace(unquoted, F.lit(mark), F.lit("")))
    broken = (count("(") != count(")")) | unquoted.rlike(_BROKEN)
    return normalized.rlike(r"^\(*+(?:select|with|from|values)\b") & ~normalized.rlike(writes) & ~broken


# Spellings that a parser reads alike, once spaces around punctuation are gone; applied in this order outside quoted names.
_SPELLINGS = (
    (r" ?!=", "<>"),
    (r"\b(?:true|false)\b", "?"),
    (r"\binner join\b", "join"),
    (r"([ )\]])as(?: |(?=\()|$)", "$1"),
    (r"((?:^|[(,=<>+*/\[])|\b(?:select|distinct|where|and|or|not|in|between|then|else|when|by|limit|on|having|values)(?= ?[-+]))"
     r" ?[-+]\?", "$1 ?"),
    (r"([(,=<>+*/\[]) \?", "$1?"),
)


def shape_key(normalized: Column) -> Column:
    """The text that identifies a shape. For queries spacing around punctuation, exponents, signs, list lengths, optional
    words, other spellings of one operator and a trailing semicolon do not count; other statements are identified by their
    normalized text."""
    exponents = F.regexp_replace(normalized, r"\?e(?:[0-9]++\b|[+-]\?)", "?")
    tight = F.regexp_replace(exponents, rf"({_QUOTED})| ?([(),;=<>+*/.\[\]-]) ?", "$1$2")

    def spelled(piece: Column) -> Column:
        for pattern, written in _SPELLINGS:
            piece = F.regexp_replace(piece, pattern, written)
        return piece

    pieces = F.regexp_extract_all(tight, F.lit(rf'{_QUOTED}|[^"]++'), F.lit(0))
    plain = F.array_join(F.transform(pieces, lambda piece: F.when(piece.startswith('"'), piece).otherwise(spelled(piece))), "")
    lists = F.regexp_replace(plain, r"\?(?:,\?)++", "?")
    return F.when(is_select(normalized), F.regexp_replace(lists, r";++\z", "")).otherwise(normalized)


def fingerprint_of(text: Column) -> Column:
    """The first eight bytes of SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 16)


# Flags ---------------------------------------------------------------------------------------------------------------

_STAR = r"(?:\bselect(?: all| distinct(?: on ?\([^()]*+\))?)?|,|\.|\bcolumns ?\() ?\*"
_CLAUSES = r"where|group by|having|order by|limit|offset|union|intersect|except|window|qualify|select"
_COMMA_JOIN = rf"\bcross join\b|\bfrom\b(?:(?!\b(?:{_CLAUSES})\b)[^,])*+,"
_PARTS = r"[()]|[^()]++"
_OPENED = "\x01"
_PLACEHOLDER = r"^[_; ]*+$"
_SET_OPERATION = r"\b(?:union|intersect|except)\b"
_BOUND = r"\blimit\b|\boffset\b|\bfetch (?:first|next)\b"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used: a lambda variable of a one-element array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running_sums(steps: Column) -> Column:
    """Sums of an array up to and with each place, by doubling the reach: as many rounds as the size has bits."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
    reaches = F.filter(powers, lambda reach: reach < F.size(steps))

    def double(sums: Column, reach: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - reach), F.lit(0)))

    return F.aggregate(reaches, steps, double)


def _by_level(normalized: Column) -> Column:
    """Takes parentheses apart, to whatever depth there is, in time that grows with n log n.

    Every part of the text has the depth it stands at, and sorting the parts by depth brings those of a level together.
    Yields a struct: ``text``, the outermost level with every parenthesis as ``_``; ``inner``, the outermost of the other
    levels that is more than a placeholder; ``crossed``, whether any other level joins without a condition.
    """
    unquoted = F.regexp_replace(normalized, _QUOTED, "q")
    parts = F.regexp_extract_all(unquoted, F.lit(_PARTS), F.lit(0))

    def placed(parts: Column) -> Column:
        steps = F.transform(parts, lambda part: F.when(part == "(", 1).when(part == ")", -1).otherwise(0))

        def marked(depths: Column) -> Column:
            mark = lambda part: F.when(part == "(", _OPENED).when(part == ")", "_").otherwise(part)
            return F.transform(parts, lambda part, i: F.struct(F.get(depths, i).alias("d"), i.alias("i"), mark(part).alias("t")))

        return F.array_sort(_once(_running_sums(steps), marked))

    def leveled(items: Column) -> Column:
        outer = F.array_join(F.filter(items, lambda item: item["d"] <= 0)["t"], "")
        nested = F.split(F.array_join(F.filter(items, lambda item: item["d"] > 0)["t"], ""), _OPENED)
        telling = F.filter(nested, lambda level: ~level.rlike(_PLACEHOLDER))
        return F.struct(
            outer.alias("text"),
            F.coalesce(F.get(telling, F.lit(0)), F.lit("")).alias("inner"),
            F.exists(telling, lambda level: level.rlike(_COMMA_JOIN)).alias("crossed"),
        )

    return _once(_once(parts, placed), leveled)


def _collect(tests: list[tuple[str, Column]]) -> Column:
    marks = F.array(*[F.when(test, F.lit(name)) for name, test in tests])
    return F.array_compact(marks)


def flags(normalized: Column) -> Column:
    """Names of the patterns the text shows, in a fixed order; empty when clean.

    Only the statement's own select can lack a filter or a limit; star and cross join count anywhere. Statements that are
    not queries get the two that plain text shows reliably.
    """
    star, cross, no_filter, unbounded = STATEMENT_FLAGS

    def judge(level: Column) -> Column:
        whole = level["text"].rlike(_PLACEHOLDER)
        own = F.when(whole, level["inner"]).otherwise(level["text"])
        own = F.regexp_replace(own, r"\bis (?:not )?distinct from\b", "is")
        single = ~own.rlike(_SET_OPERATION)
        values_only = own.rlike(r"^values\b")
        headless = own.rlike(r"^from\b") & ~own.rlike(r"\bselect\b")
        return _collect(
            [
                (star, normalized.rlike(_STAR) | headless | values_only),
                (cross, level["crossed"] | own.rlike(_COMMA_JOIN)),
                (no_filter, single & (own.rlike(r"\bfrom\b") | values_only) & ~own.rlike(r"\bwhere\b")),
                (unbounded, single & own.rlike(r"\border by\b") & ~own.rlike(_BOUND)),
            ]
        )

    query_flags = _once(_by_level(normalized), judge)
    text_flags = _collect(
        [
            (star, F.contains(normalized, F.lit("select *"))),
            (
                unbounded,
                F.contains(normalized, F.lit(" order by ")) & ~F.contains(normalized, F.lit(" limit ")),
            ),
        ]
    )
    return F.when(is_select(normalized), query_flags).otherwise(text_flags)


# Previews ------------------------------------------------------------------------------------------------------------


def one_line(sql: Column) -> Column:
    """The statement on one line without its leading comment and blank lines. All-comment text is kept."""
    space = char_class(PREVIEW_SPACE)
    inside_line = f"[{space}&&[^\\n]]*+"
    skipped = rf"\A(?:{inside_line}(?:--[^\n]*+)?\n)*+(?={inside_line}(?!--)[^{space}])"
    body = F.regexp_replace(sql, skipped, "")
    return F.btrim(F.regexp_replace(body, f"[{space}]++", " "), F.lit(" "))


def is_cut(sql: Column, length: int | None) -> Column:
    return F.lit(False) if length is None else F.length(sql) > length


def cut(sql: Column, length: int | None) -> Column:
    """List form of a statement: whole, or at most ``length`` characters and marked when shortened."""
    if length is None:
        return sql
    return F.when(is_cut(sql, length), F.concat(F.substring(sql, 1, length), F.lit("..."))).otherwise(sql)


def labelled(sql: Column, was_cut: Column, length: int | None) -> Column:
    """A list form that says so when it is not the whole statement."""
    return sql if length is None else F.when(was_cut, F.concat(sql, F.lit("\n" + CUT_NOTE.format(length)))).otherwise(sql)
