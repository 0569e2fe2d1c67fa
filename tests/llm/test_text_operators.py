"""Quality rules, scoring, personal data, classifier and page text against plain versions."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.llm import context_trees, page_text, personal_data, quality_classifier, quality_rules
from runledger.llm.registry import oracle_sql

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, row string"
LONG = "the cat of the house and a dog in it. " * 3000


def documents(spark, texts):
    return spark.createDataFrame([(i // 2 if i % 5 else None, t, "en" if i % 3 else None, "s", "x", "y") for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \n\t", "one", LONG, "a b c d e f g h " * 4, "a b c d e f g h " * 4, "x\n\nx\ny\n x\n", "mail a.b@c.de, +1 (234) 567-8901; 10.0.0.1; 4111 1111 1111 1111", "é ü ß 日本"]


# Quality rules


def plain_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(oracle_sql()["op2_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules.query(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    for column in want.columns:
        assert got[column].tolist() == want[column].tolist(), column


def test_rules_of_odd_texts(spark):
    docs = documents(spark, ODD)
    got = quality_rules.quality_rules(docs).collect()
    measures = Counter(tuple(r[quality_rules.MEASURES])[:5] for r in got)
    assert measures == Counter(plain_rules(t) for t in ODD)
    assert [c for c in quality_rules.good_documents(docs).columns] == docs.columns
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_short_texts_are_held_against_their_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    junk = ["a | b | c | d | e | f | " + " | ".join(f"{k} # {k * 7919}" for k in range(n)) for n in (10, 14, 19)]
    plain = docs.select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - k, t, "en") for k, t in enumerate(junk)], "doc_id long, text string, lang string")
    assert all(20 <= len(t.split()) < 100 and len(t) < 500 for t in junk)
    kept = {r.doc_id for r in quality_rules.good_documents(plain.union(more.withColumn("doc_id", more.doc_id.cast(plain.schema["doc_id"].dataType)))).collect()}
    assert not kept & {-1, -2, -3}
    by_rule = {r.doc_id: r["quality verdict"].kept for r in quality_rules.quality_rules(plain).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect() if by_rule[r.doc_id]}
    assert len(good & kept) >= 0.99 * len(good)


def test_a_language_of_short_texts_only_has_a_reference(spark):
    words = "the of and to a river house in that green is it for was on with stone as be walk by are this at from he or his not".split()
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(61)] + [" ".join(f"#{k}|{k}" for k in range(40))]
    kept = [r.text for r in quality_rules.good_documents(documents(spark, texts)).collect()]
    assert sorted(kept) == sorted(texts[:-1])


# Scoring


D = context_trees.DEPTH


def plain_tree(train, texts):
    """Context-tree weighting by recursion over dictionaries, one tree for each decision."""
    counts = defaultdict(lambda: [0, 0])

    def bits(text):
        raw = b"\xff" * D + text + b"\xff"
        for i in range(D, len(raw)):
            place = 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                yield raw[i - D : i], place, bit
                place = place * 2 + bit

    for text in train:
        for context, place, bit in bits(text):
            for depth in range(D + 1):
                counts[place, context[D - depth :]][bit] += 1
    children = defaultdict(set)
    for place, context in counts:
        if context:
            children[place, context[1:]].add((place, context))

    def estimate(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def total(node):
        if node not in memo:
            own = estimate(node)
            memo[node] = own if len(node[1]) == D else math.log(0.5) + np.logaddexp(own, sum(map(total, children[node])))
        return memo[node]

    def one(place, context, depth):
        node = (place, context[D - depth :])
        a, b = counts.get(node, (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if depth == D or (place, context[D - 1 - depth :]) not in counts:
            return p
        w = math.exp(math.log(0.5) + estimate(node) - total(node))
        return w * p + (1 - w) * one(place, context, depth + 1)

    out = []
    for text in texts:
        score = 0.0
        for context, place, bit in list(bits(text)):
            p = one(place, context, 0)
            score += math.log10(p if bit else 1 - p)
        out.append(score)
    return out


def test_scores_equal_a_plain_tree(spark):
    texts = [None, "", "the cat", "THE CAT the cats", "a thé", "zz top the", "cat " * 30, "cat " * 30]
    docs = spark.createDataFrame([(i * 5 if i else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    unseen = [i and zlib.crc32(str(i * 5).encode()) % 7 == 2 for i in range(len(texts))]
    low = [(t or "").encode().lower() for t in texts]
    want = plain_tree([t for t, u in zip(low, unseen, strict=True) if not u], low)
    got = context_trees.scores(docs.repartition(2)).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(want), abs=1e-9)
    counts = Counter(w for t, u in zip(low, unseen, strict=True) if not u for w in [*WORDS.findall(t.decode()), "\n"])
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*WORDS.findall(t.decode()), "\n"]) for t in low]
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(base), abs=1e-9)
    assert {r.train_tokens for r in got} == {n}
    assert context_trees.scores(docs.limit(0)).count() == 0


def test_groups_and_blocks_of_any_size_give_the_same(spark, monkeypatch):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    texts = texts.withColumn("text", F.substring("text", 1, 400))
    found = []
    for group, block in ((1, 1000), (1 << 16, 24 << 20)):
        monkeypatch.setattr(context_trees, "GROUP", group * 500)
        monkeypatch.setattr(context_trees, "BLOCK", block)
        found.append({r.doc_id: (r.score, r.base_score) for r in context_trees.scores(texts).collect()})
    assert found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], abs=1e-6) for k in found[0])


def test_pieces_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(context_trees, "SLICE", 10)
    texts = [b"", b"abcdefghijklmnop qrst uv wx yz 0123456789 a", b"short", b"x" * 50 + b" y"]
    keys, words = defaultdict(list), Counter()
    for owner, before, own in context_trees.pieces(texts):
        at = 0
        found = context_trees.grams(before, own)
        for k, x in zip(owner, own, strict=True):
            keys[k] += found[at : at + len(x)].tolist()
            at += len(x)
        words.update(context_trees.words(own)[0].tolist())
    for k, text in enumerate(texts):
        raw = b"\xff" * D + text + b"\xff"
        assert keys[k] == [int.from_bytes(raw[i - D : i + 1], "big") for i in range(D, len(raw))]
    assert sum(words.values()) == sum(len(t.split()) + 1 for t in texts)


def test_probabilities_of_all_next_bytes_sum_to_one():
    rng = np.random.default_rng(0)
    context = int.from_bytes(b"_abcd"[-D:], "big")
    key = np.r_[(context << 8) | np.arange(256), (int.from_bytes(b"xabcd"[-D:], "big") << 8) | np.arange(256)]
    n = np.where(rng.random(512) < 0.05, rng.integers(1, 50, 512), 0).astype(float)
    mixed, _ = context_trees.subtree(key, n)
    total = np.ones(256)
    for level in range(8):
        _, bit = context_trees.places(np.arange(256), level)
        p = np.where(np.isnan(mixed[:256, level]), 0.5, mixed[:256, level])
        total *= np.where(bit == 1, p, 1 - p)
    assert total.sum() == pytest.approx(1)


# Personal data


def plain_base(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(((k, *m.span()) for k, m in found), key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


@given(st.text(alphabet="a1.@+-% ()4b0", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert personal_data.base_spans(text) == plain_base(text)


def test_long_runs_take_linear_time():
    for run in ("1" * 200_000, "a" * 200_000, "a.@" * 60_000, "+1" + "(" * 100_000, "1." * 100_000, "(at)" * 50_000):
        personal_data.candidates(run)
    for run in ("1:" * 100_000, "1::" * 70_000, ":" * 200_000, "::1 " * 2_000, "1:1::%" * 30_000):
        personal_data._SHORT_IPV6.findall(run)


def test_personal_data_of_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(documents(spark, ODD).select("doc_id", "text"))
    got = personal_data.personal_data(docs).collect()
    for r in got:
        spans = [tuple(s)[:3] for s in r["personal spans"] if s["base"]]
        assert spans == plain_base(r.text or "")
    digest = {r.doc_id: (r.base_sha256, r.spans) for r in personal_data.query(spark, SF).collect()}
    for doc_id, text in docs.where("doc_id > 20").limit(50).collect():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text or ""))
        assert digest[doc_id][0] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(digest[doc_id][1].split(","))
    assert personal_data.personal_data(docs.limit(0)).count() == 0


def test_masking_keeps_columns_and_other_text(spark):
    docs = documents(spark, ODD).withColumn("n_chars", quality_rules.F.length("text"))
    got = personal_data.masked_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    masked = [r.text for r in rows if r.text and "<EMAIL>" in r.text]
    assert masked == ["mail <EMAIL>, <PHONE>; <IP>; <CARD>"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert Counter(r.text for r in rows if not r.text or "<" not in r.text) == Counter(t for t in ODD if not t or "@" not in t)


def test_wider_spans_follow_the_votes():
    texts = [f"call {n} or write joe (at) site (dot) org; password=hunter{n}x" for n in range(40)] + ["version 10 200 3000 4000", "reached 5551234"] * 5
    texts += ["mail a@b.de ip 1.2.3.4"] * 20
    patterns = Counter((personal_data.KINDS.index(k), personal_data.votes(t, k, a, b, own)) for t in texts for k, a, b, own in personal_data.candidates(t))
    scores = personal_data.span_classifier([(k, p, n) for (k, p), n in patterns.items()])
    secret = personal_data.KINDS.index("secret")
    assert all(v >= 0.5 for (k, _), v in scores.items() if k in (secret, 0))


def test_long_secrets_are_masked_whole(spark):
    rng = random.Random(6)
    token = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for _ in range(2_000))
    held = token[:1_000] + ".4111111111111111." + token[1_000:]
    texts = [f"password=hunter{n}x and more" for n in range(40)] + [f"so token: {token} ends", f"so token: '{held}' ends", "key: joe@site.com1 ends"]
    got = [r.text for r in personal_data.masked_documents(documents(spark, texts)).collect()]
    assert {t for t in got if t.startswith("so")} == {"so token: <SECRET> ends", "so token: '<SECRET>' ends"}
    personal_data.candidates("token=" + "a" * 500_000 + " key=b" * 10_000)


def test_compressed_addresses_are_masked(spark):
    found = lambda text: [text[a:b] for k, a, b, own in personal_data.candidates(text) if k == "ip" and not own]
    for address in ("2001:db8::1", "fe80::1%eth0", "2001:db8::", "::1", "2001:db8:0:0:1::1", "2001:DB8:1:2:3:4:5:6"):
        assert found(f"client [{address}], then") == found(f"from {address}.") == [address]
        assert personal_data.votes(address, "ip", 0, len(address), False)[1] == "+"
    assert found("std::add and a :: b at 12:30:45, ::: x::1 1::2::3") == []
    assert personal_data.votes("1:2:3:4:5::6:7:8:9", "ip", 0, 18, False)[1] == "-"
    texts = [f"login from ip 2001:db8:{n:x}::{n + 7:x} at noon" for n in range(30)] + ["mail a@b.de ip 1.2.3.4"] * 20
    got = [r.text for r in personal_data.masked_documents(documents(spark, texts)).collect()]
    assert got.count("login from ip <IP> at noon") == 30


# Quality classifier


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in truth]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())


def test_classifier_of_odd_texts(spark):
    docs, none = documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.classify(docs, none).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.classify(docs, labels).count() == len(ODD)
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality_classifier.fit(x, y, trees=15, depth=3)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)))


# Page text


def article(page):
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1|br)>", found[1]) if found else []
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if t)


def test_page_text_is_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = page_text.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    assert sum(r.text == article(pages[r.page_id]) for r in got) >= 0.99 * len(pages)
    assert all(r.n_chars == len(r.text) for r in got)


def test_labeller_on_layouts_it_was_not_shown():
    rng = random.Random(8)
    spans = [" ".join(rng.choice("alpha beta gamma delta of the and".split()) for _ in range(rng.randint(5, 60))) for _ in range(400)]
    page = lambda: [page_text.Block(("html", "body", "article", "p"), rng.choice(spans), 0) for _ in range(rng.randint(2, 9))] + [page_text.Block(("html", "body", "nav", "a"), "Home", 4)]
    taught = [page_text.rebuilt(p := page(), page_text.markup_labels(p), rng) for _ in range(250)]
    weights = page_text.train([(page_text.vectors(p), np.array(y, np.float32)) for p, y in taught[:200]])
    right = [(m >= 0.5) == (y > 0) for p, ys in taught[200:] for m, y in zip(page_text.probabilities([page_text.vectors(p)], weights)[0], ys, strict=True)]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("tag", ["svg", "noscript", "template", "select", "iframe"])
def test_no_text_after_an_element_that_is_not_closed_is_lost(tag):
    text = lambda page: [b.text for b in page_text.blocks(page)]
    assert text(f"<p>a<{tag} id='x'>b<p>c") == ["ab", "c"]
    assert text(f"<p>a<{tag}><p>b<{tag}>no</{tag}><p>c") == ["a", "b", "c"]
    assert text(f"<p>a<{tag}>no<!-- </{tag}> -->no</{tag}>b<p>c") == ["ab", "c"]
    assert text(f"<p>a<{tag}>" * 20_000) == ["a"] * 20_000


def test_self_closed_drawings_and_formulas_are_read_past():
    text = lambda page: [b.text for b in page_text.blocks(page)]
    assert text("<p>a<svg viewBox='0 0 1 1'/>b<p>c<svg>no<svg/>no<svg>no</svg>no</svg>d") == ["ab", "cd"]
    assert text("<p>a<math/>b<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<p>c<math>y") == ["ab", "so x=2 holds", "cy"]
    assert text("<p>a<script>no<p>no") == text("<p>a<style>no") == ["a"]


def test_every_element_around_a_block_counts():
    deep = lambda opened: "<html><body>" + "<div>" * 10 + opened + "<ul><li><div>" * 12 + "<p>text"
    for opened in ('<section class="comments">', "<aside>", "<article>", '<div class="story">'):
        page, plain = page_text.blocks(deep(opened)), page_text.blocks(deep("<div>"))
        assert (page_text.vectors(page) != page_text.vectors(plain)).any()
    assert page_text.markup_labels(page_text.blocks(deep("<article>"))) == [1.0]
    assert page_text.markup_labels(page_text.blocks("<article>" + deep("<form>"))) == [0.0]
    rng = random.Random(2)
    for _ in range(100):
        around = [rng.choice(["div", "article", "aside", "div a b", "ul", "li", f"div c{rng.randint(0, 400)}", "main x", "section comment"]) for _ in range(rng.randint(0, 60))]
        page = page_text.blocks("".join(f"<{t.partition(' ')[0]} class='{t.partition(' ')[2]}'>" for t in around) + "text")
        whole = [page_text.Block(tuple(around), "text", 0)]
        assert page_text.markup_labels(page) == page_text.markup_labels(whole)
        assert (page_text.vectors(page) == page_text.vectors(whole)).all()
    assert len(page_text.blocks("".join(f"<div class=c{k}>x" for k in range(50_000)))) == 50_000


def test_blocks_of_odd_pages(spark):
    assert [b.text for b in page_text.blocks("a<b>b</b> &amp;c<p>d\n e<script>x('</p>')</script><br>f<!-- <p>no --> g")] == ["ab &c", "d e", "f g"]
    assert [b.text for b in page_text.blocks("1 < 2 <p title='>'>x &lt;p&gt; &#65;")] == ["1 < 2", "x <p> A"]
    page_text.blocks("<" * 50_000)
    page_text.blocks("<b>" * 50_000 + "</i>" * 50_000)
    page_text.blocks("<a href='" * 20_000)
    rows = spark.createDataFrame([(1, "u", None, "z"), (1, "u", "", "z"), (None, None, "<p>" + "word " * 100_000, "z")], "page_id long, url string, html string, text string")
    got = page_text.page_texts(rows).collect()
    assert len(got) == 3 and sorted(r.n_chars for r in got)[:2] == [0, 0]
    assert page_text.page_texts(rows.limit(0)).count() == 0
