"""Personal data found by labelers that vote, weighed by how reliable they prove to be.

Base spans (e-mail, IP and card numbers, phone numbers) follow fixed patterns and always stay. Wider patterns give further
candidates: obfuscated addresses, national phone numbers, IPv6, account numbers, secrets. On every candidate the labelers of
``LABELERS`` vote for, against, or not at all: strict patterns and checksums, gazetteers of issuers, prefixes and top
level domains, and words before the span. Expectation-maximisation over the counts of vote patterns of all documents
estimates how often each labeler is right, and with that how likely each pattern is personal data. A logistic span
classifier then learns these likelihoods from votes and shape, and decides on the candidates that are not base spans.

The text is read once. What the models learn from is a histogram with at most one row for each kind, vote pattern and
shape, whatever the number of documents.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import staged, table

# In the order in which spans of one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

# Fixed patterns. Runs of digits are matched from their first digit and never given back, which changes no match and
# keeps long runs linear; an e-mail is found from its @, to which its local part always reaches.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beyond the base.
_WORDY_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\(at\)|\[at\]|\{at\})[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|\.)[\x20]?[A-Za-z0-9-]{1,63}){1,6}")
_NATIONAL = re.compile(r"(?<![\w+.,/-])(?<![0-9][\x20])(?:\([0-9]{2,5}\)[\x20]?|00[1-9][0-9]{0,2}[\x20.-]|0?[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w/-]|[\x20.][0-9])")
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{2,4}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
# Compressed: groups around one '::', with or without a zone.
_SHORT_IPV6 = re.compile(r"(?<![\w:])(?=:*[0-9A-Fa-f])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?:%\w+)?(?![\w:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\x20]{0,3}[=:][\x20]{0,3}[\"']?([^\s\"']{8,}+)")
# Characters of a secret that are in no base span.
_LEAST_SECRET = 64

_BEFORE = 48
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|from|to)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|paid|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|contact|t[ée]l|telefon|m[óo]vil|anruf)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b"),
    "secret": re.compile(r"(?i)(?:password|passwd|pwd|token|secret|key)"),
}
_AGAINST = re.compile(r"(?i)\b(?:version|release|build|isbn|issn|doi|page|pages|chapter|section|rev|order|invoice|serial|model|part)\W{0,3}\Z")
_DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au jp cn in br ru ch at be".split())
_ISSUERS = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SI SK".split())
_RESERVED = ("0.", "127.", "169.254.", "255.")

LABELERS = ("pattern", "checksum", "gazetteer", "cue before", "cue against", "variety")
ACCEPT = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans of a text, in code points, end exclusive; by start, then kind."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (match := _DOMAIN.match(text, at)):
            found.append(("email", begin, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        # Leading zeros are no part of a value, however many there are.
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _iban_holds(value: str) -> bool:
    flat = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _address_holds(value: str) -> bool:
    try:
        ipaddress.ip_address(value)
    except ValueError:
        return False
    return True


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans, and others that overlap no span before them in this order.

    A secret may hold base spans, as long as it has enough characters besides.
    """
    base = base_spans(text)
    out = [(*s, True) for s in base]
    more: list[tuple[str, int, int]] = []
    if "at)" in text or "at]" in text or "at}" in text:
        more += [("email", *m.span()) for m in _WORDY_EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        more += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
        more += [("ip", *m.span()) for m in _IPV6.finditer(text)]
        if "::" in text:
            more += [("ip", *m.span()) for m in _SHORT_IPV6.finditer(text)]
    more += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    more += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= sum(c.isdigit() for c in m[0]) <= 19]
    more += [("card", *m.span()) for m in _GROUPED.finditer(text)]
    more += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
    if more:
        # A mark for each code point that a span has, so that a span is held against the others in the time to read it.
        taken = bytearray(len(text))
        for _, a, b in base:
            taken[a:b] = b"\1" * (b - a)
        in_base = bytes(taken)
        for kind, a, b in more:
            inside = in_base.count(1, a, b) if kind == "secret" else 0
            if (inside and b - a - inside >= _LEAST_SECRET) or taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """What each of ``LABELERS`` says of a span: + for, - against, . nothing; then its shape."""
    value, before = text[start:end], text[max(0, start - _BEFORE) : start]
    digits = [c for c in value if c.isdigit()]
    checks, listed = 0, 0
    if kind == "card":
        checks = 1 if luhn("".join(digits)) else -1
        listed = 1 if "".join(digits[:2]).startswith(_ISSUERS) else -1
    elif kind == "iban":
        checks = 1 if _iban_holds(value) else -1
        listed = 1 if value[:2] in _COUNTRIES else -1
    elif kind == "ip":
        checks = 0 if base else 1 if _address_holds(value) else -1
        listed = -1 if value.startswith(_RESERVED) else 0
    elif kind == "email":
        listed = 1 if re.split(r"[^A-Za-z0-9]+", value.rstrip(")]} "))[-1].lower() in _DOMAINS else -1
    elif kind == "phone":
        checks = 1 if 9 <= len(digits) <= 15 else -1
        listed = 1 if value[0] == "+" or value[0] == "(" or value.startswith("00") else 0
    elif kind == "secret":
        checks = 1 if digits and any(c.isalpha() for c in value) else -1
    cue = 1 if _CUES[kind].search(before) else 0
    against = -1 if _AGAINST.search(before) else 0
    variety = len(set(value.lower()))
    varied = -1 if variety <= 3 else (1 if variety >= 6 else 0)
    said = (1 if base else 0, checks, listed, cue, against, varied)
    shape = f"{min(len(value) // 8, 9)}{min(9, 10 * len(digits) // len(value))}"
    return "".join(".+-"[v] for v in said) + shape


_FOUND = "kind int, start int, end int, base boolean, pattern string"


def found(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of candidates in the column ``personal candidates``, stored."""
    names = [*docs.columns, "personal candidates"]
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text.as_py() or ""
                out.append([{"kind": KINDS.index(k), "start": a, "end": b, "base": own, "pattern": votes(text, k, a, b, own)} for k, a, b, own in candidates(text)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kinds)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return staged(docs.mapInArrow(label, f"{schema}, `personal candidates` array<struct<{_FOUND.replace(' ', ': ').replace(',:', ',')}>>"))


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation on (kind, pattern, count): how likely each pattern is personal data, and each labeler's
    shares of votes for, against and none, on personal data and on other text."""
    kind = np.array([k for k, _, _ in patterns])
    count = np.array([n for _, _, n in patterns], float)
    vote = np.array([[".+-".index(c) for c in p[: len(LABELERS)]] for _, p, _ in patterns])
    balance = (vote == 1).sum(1) - (vote == 2).sum(1)
    likely = 1 / (1 + np.exp(-balance.astype(float)))
    table = np.zeros((2, len(LABELERS), 3))
    # A few made-up votes: labelers are taken to be right more often than not until counts say otherwise.
    prior = np.array([[1.0, 1.0, 3.0], [1.0, 3.0, 1.0]])
    for _ in range(rounds):
        for y, weight in enumerate((count * (1 - likely), count * likely)):
            for v in range(3):
                table[y, :, v] = ((vote == v) * weight[:, None]).sum(0) + prior[y, v]
            table[y] /= table[y].sum(1, keepdims=True)
        share = np.array([((count * likely)[kind == k].sum() + 1) / (count[kind == k].sum() + 2) for k in range(len(KINDS))])
        logs = np.log(table)
        at = np.arange(len(LABELERS))
        odds = np.log(share / (1 - share))[kind] + (logs[1, at, vote] - logs[0, at, vote]).sum(1)
        likely = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return likely, table


def _features(kind: int, pattern: str) -> list[float]:
    own = [1.0, *(float(kind == k) for k in range(1, len(KINDS)))]
    for c in pattern[: len(LABELERS)]:
        own += [float(c == "+"), float(c == "-")]
    return [*own, int(pattern[-2]) / 10, int(pattern[-1]) / 10]


def span_classifier(patterns: list[tuple[int, str, int]], rounds: int = 30, ridge: float = 1.0) -> dict[tuple[int, str], float]:
    """Logistic regression on what expectation-maximisation found likely: the probability of each pattern seen."""
    if not patterns:
        return {}
    patterns = sorted(patterns)
    likely, _ = reliabilities(patterns)
    x = np.array([_features(k, p) for k, p, _ in patterns])
    count = np.array([n for _, _, n in patterns], float)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (count * (likely - p)) - ridge * weights
        curve = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights += step / max(1.0, np.abs(step).max() / 4)
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    return {(k, pattern): float(v) for (k, pattern, _), v in zip(patterns, p, strict=True)}


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` (text and any others) with the spans found, an array of (kind, start, end, base) in ``personal spans``.

    Null and empty texts have none. Every row stands for itself, so repeated rows get the same spans. No rows give no
    rows. Offsets are code points; where spans start together they are in the order of ``KINDS``.
    """
    rows = found(docs)
    each = rows.select(F.explode("`personal candidates`").alias("c"))
    # Bounded by kinds, vote patterns and shapes.
    counts = each.groupBy("c.kind", "c.pattern").agg(F.count("*").alias("n")).collect()
    accepted = [(k, p) for (k, p), v in span_classifier([(r.kind, r.pattern, r.n) for r in counts]).items() if v >= ACCEPT]
    wanted = [f"{k} {p}" for k, p in accepted]
    keep = lambda c: c["base"] | F.concat_ws(" ", c["kind"], c["pattern"]).isin(wanted)
    spans = F.transform(
        F.filter("`personal candidates`", keep),
        lambda c: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")),
    )
    return rows.withColumn("personal spans", spans).drop("personal candidates")


def masked_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets, and ``n_chars`` to match; rows without one are as they were."""
    rows = personal_data(docs)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i, spans in enumerate(batch["personal spans"].to_pylist()):
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [texts[i][at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["end"])
                if spans:
                    texts[i] = "".join(out) + texts[i][at:]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch["text"].type)
            del columns["personal spans"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = rows.mapInArrow(mask, schema)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "`personal spans`")
    spans = F.col("`personal spans`")
    base = F.filter(spans, lambda s: s["base"])
    listed = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select("doc_id", *[_count(base, k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
