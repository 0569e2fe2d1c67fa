"""Token files and packing against plain encoding of each text."""

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runledger.llm import encoding, packing, token_files
from runledger.llm.encoding import Encoder, vocabulary

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "a  b\n c", " x y", "x\x1cy \x1d", "é ́a", "<|endoftext|> it's 12 345", "日本 語　x", "a᠎b"]


@functools.cache
def plain(name):
    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85  　'sA1.é́")), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=150, deadline=None)
def test_units_have_the_ids_of_the_text(name, spaces, text):
    own = both(name, spaces)
    assert np.frombuffer(own[0].encode(text), "<u4").tolist() == own[1](text)


@functools.cache
def both(name, spaces):
    return Encoder(name, spaces), plain(name)


def rows_of(spark, texts, **more):
    return spark.createDataFrame([(i * 3 % 7 if i < 3 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, frame string")


def test_round_trip(spark, tmp_path):
    docs = rows_of(spark, [*ODD, "word " * 3000, *ODD]).unionByName(spark.createDataFrame([(None, "no id", "x")], "doc_id long, text string, frame string"))
    path = str(tmp_path / "files")
    token_files.encode(docs.repartition(3), path)
    got = token_files.digests(spark, path).orderBy("start").collect()
    ids = plain(token_files.VOCABULARY)
    want = Counter()
    for r in docs.collect():
        x = np.array([*ids(r.text), 0], "<u4")
        want[(r.doc_id, len(x), zlib.crc32(x.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    found = token_files.lookup(spark, path, token_files.F.col("doc_id") == 9).collect()
    assert [r.ids for r in found] == [[*ids(ODD[9]), 0]]


def test_another_dictionary_is_refused(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.encode(docs, str(tmp_path / "a"))
    token_files.encode(docs.where("doc_id < 3"), str(tmp_path / "b"))
    other = spark.read.parquet(str(tmp_path / "b/dictionary"))
    assert spark.read.parquet(str(tmp_path / "a/dictionary")).first().hash != other.first().hash
    other.write.mode("overwrite").parquet(str(tmp_path / "a/dictionary"))
    with pytest.raises(Exception, match="another dictionary"):
        token_files.digests(spark, str(tmp_path / "a")).collect()


def test_empty_tables(spark, tmp_path):
    docs = rows_of(spark, []).limit(0)
    token_files.encode(docs, str(tmp_path / "none"))
    assert token_files.digests(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(docs).count() == 0


def check_packing(rows, docs, capacity=packing.CAPACITY):
    ids = plain(packing.VOCABULARY)
    want = Counter()
    for doc, text in docs:
        x = [*ids(text), 0]
        for k, begin in enumerate(range(0, len(x), capacity)):
            own = np.array(x[begin : begin + capacity], "<u4")
            want[(doc, k, begin, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows) / capacity


def test_packing_places_every_piece(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.query(spark, SF).collect()
    used, least = check_packing(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= 1.02 * least + 2


def test_packing_of_odd_texts(spark):
    docs = rows_of(spark, [*ODD, *ODD, "word " * 3000])
    check_packing(packing.pack(docs.repartition(3), capacity=8).collect(), [(r.doc_id, r.text) for r in docs.collect()], 8)


@given(st.dictionaries(st.integers(1, 24), st.integers(0, 40)), st.just(24))
@settings(max_examples=200, deadline=None)
def test_plan_is_gapless_and_whole(counts, capacity):
    sequences, got = defaultdict(list), Counter()
    for length, first, last, each, sequence, offset in packing.plan(counts, capacity):
        for rank in range(first, last):
            sequences[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
            got[length] += 1
    assert got == Counter({k: v for k, v in counts.items() if v})
    for placed in sequences.values():
        assert sum(3 * n > capacity for _, n in placed) <= 2
        assert [o for o, _ in sorted(placed)] == [sum(n for _, n in sorted(placed)[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= capacity


def test_any_mix_of_spaces_marks_and_letters_has_the_tokenizer_ids():
    import random

    from runledger.llm.encoding import encoder

    dice = random.Random(3)
    pieces = [" ", "  ", "\n", "\n\n", "\t", " \n", "a", "The", "é", "ß", ",", ".", "'s", "'", "$$", "12", "3.4", "€", "日本", "\U0001f600", "x'll", "-", "word", "Word,", "\r\n", "\xa0", "don't", "(a)", "×"]
    texts = ["".join(dice.choices(pieces, k=dice.randint(0, 14))) for _ in range(8000)]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = encoder(name, spaces)
        assert [own.encode(text) for text in texts] == own.whole(texts)


SPACED = [" ", " ", " ", "  ", "   ", "\n", "\n\n", "\t", " \n", "\n ", "\r\n", "\x0b", "\x85", "\xa0", "\u3000", "\x1c", "\u180e", "a", "The", "é", "ß", "e\u0301", "×", ",", ".", "'s", "'", "$$", "[\\]", "^_`", "12", "3.4", "€", "日本", "\U0001f600", "word", "Word,", "don't", "-"]


@pytest.mark.parametrize(("group", "part", "words"), [(16 << 20, 1 << 20, 1_000_000), (200, 1 << 20, 3), (30, 10, 5), (0, 1, 0)])
def test_texts_together_have_the_tokenizer_ids(monkeypatch, group, part, words):
    import random

    dice = random.Random(7)
    texts = ["", *("".join(dice.choices(SPACED, k=dice.randint(0, 14))) for _ in range(4000)), "", "words, " * 50, "x" * 300]
    for name, value in (("GROUP", group), ("SLICE", part), ("KEPT_WORDS", words)):
        monkeypatch.setattr(encoding, name, value)
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = both(name, spaces)[0]
        want = own.whole(texts)
        assert list(own.encode_all(pa.array(texts))) == want
        assert list(own.encode_all(pa.array(["left out", *texts, "left out"]).slice(1, len(texts)))) == want
        assert len(own.kept[0]) == len(own.kept[1]) <= words


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85  　'sA1.é́")), st.characters(codec="utf-8")), max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_texts_together_have_the_tokenizer_ids(texts):
    own = both("byte_bpe_50k.json", True)[0]
    assert list(own.encode_all(pa.array(texts, pa.string()))) == own.whole(texts)


def test_a_word_goes_to_the_tokenizer_once_and_to_no_look_up_of_its_own(monkeypatch):
    """Finding of round 3: a look-up for each word and one for each form with marks or line breaks took most of the time."""
    own, asked = Encoder("byte_bpe_50k.json", True), []
    merged = own.merged
    monkeypatch.setattr(own, "merged", lambda words: asked.extend(words.to_pylist()) or merged(words))
    words = [f"{a}{b}ing" for a in ("th", "on", "re", "é") for b in ("an", "er", "st")]
    texts = [f"{a} {b}, {a}. {b}\n{a};\n    {b}  {a}   {b}" for a in words for b in words]
    for _ in range(2):
        assert list(own.encode_all(pa.array(texts))) == own.whole(texts)
    assert Counter(asked) == Counter([*words, *(f" {word}" for word in words)])
    assert not own.known
