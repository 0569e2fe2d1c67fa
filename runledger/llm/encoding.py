"""Token ids of whole texts with a public tokenizer, at the cost of a look-up for each repeated word.

Both kinds of tokenizer used here cut a text into words before merging, and always cut between a character that is no
white space and one that is. A text therefore has the ids of its units one after the other, where a unit is a word with
the white space before it (byte-level vocabularies) or a word alone (vocabularies that drop white space).

Many texts are encoded together (``encode_all``): Arrow cuts them at spaces and numbers the different pieces, cuts these
into words and marks and numbers them again. Only words that were not seen lately go to the tokenizer, one by one.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Control characters that Python counts as white space and Unicode does not: texts with one are encoded whole.
_ODD = re.compile("[\x1c-\x1f᠎]")
_LED = re.compile(r"\s*\S+|\s+\Z")
_BREAK = re.compile(r"(?<=\S)\s")
# White space other than a space, Latin letters with or without a space before them, marks but for the apostrophe.
_SIMPLE = re.compile(r"([\n\r\t]?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
# For Arrow: Latin letters with or without a space before them; cuts between letters and marks and around a single line
# break or tab.
_PLAIN_WORD = "^ ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"
_CUT = "\x1c"
_CUTS = (
    ("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])([!-&(-/:-@\\[-`{-~])", f"\\1{_CUT}\\2"),
    ("([!-~\xc0-\xd6\xd8-\xf6\xf8-\xff])([\n\r\t])([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])", f"\\1{_CUT}\\2{_CUT}\\3"),
)
# How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on, in order.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_BYTES = "".join(chr(_SHOWN.get(b, b)) for b in range(256))
# Units in each of the two generations of a worker's cache, and characters cut into units at a time.
KEPT_UNITS = 300_000
SLICE = 1 << 20
# Bytes of texts encoded together, a longer text being encoded in slices, and words kept from group to group.
GROUP = 8 << 20
KEPT_WORDS = 600_000


def vocabulary(name: str) -> str:
    """Place of a vocabulary file on the machine that runs this, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. ``spaces`` tells whether the vocabulary encodes white space."""

    def __init__(self, name: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else vocabulary(name))
        self.tokenizer.encode_special_tokens = True
        self.spaces = spaces
        self.lower = not spaces
        self.model = self.tokenizer.model
        self.known = Known(self.unit)
        self.kept = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def parts(self, text: str) -> Iterator[str]:
        """The text cut before white space about every ``SLICE`` characters, so that unit lists stay small."""
        at = 0
        while len(text) - at > SLICE and (cut := _BREAK.search(text, at + SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def unit(self, unit: str) -> tuple[bytes, bool]:
        """Ids of one unit, and whether to keep them. Both kinds of tokenizer cut it between white space other than one
        space, Latin letters and the ASCII marks after them, so these are looked up on their own; letters go to the merges
        directly. A unit of several parts is kept if its word was seen before: most words are never seen again."""
        split = _SIMPLE.fullmatch(unit)
        if split is None:
            return self.ids(unit), True
        lead, word, marks = split.groups()
        low = word.lower() if self.lower else word
        if low is word or low == unit:
            if not (lead or marks):
                return self.letters(unit), True
        seen = low in self.known or low in self.known.older
        ids = self.known[low]
        if lead:
            ids = self.known[lead] + ids
        return (ids + self.known[marks] if marks else ids), seen

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, unit: str) -> bytes:
        if unit.isascii():
            shown = "\u0120" + unit[1:] if unit[0] == " " else unit
        else:
            shown = unit.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole([text])[0]
        cut = _LED.findall if self.spaces else str.split
        return b"".join([b"".join(map(self.known.__getitem__, cut(part))) for part in self.parts(text)])

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each of the texts, none of them null, in order."""
        if not self.spaces:
            yield from (self.encode(text.as_py()) for text in texts)
            return
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype="int64"), 0
        while at < len(texts):
            n = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, "right")) - at
            if n:
                yield from self.group(texts.slice(at, n))
            else:
                yield b"".join([next(self.group(pa.array([part]))) for part in self.parts(texts[at].as_py())])
            at += max(n, 1)

    def group(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts cut at every space, which belongs to what follows it, but for spaces within longer runs of white space.
        Texts with odd characters are encoded one by one."""
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()
        coded = pc.dictionary_encode(split.flatten())
        unique, places = coded.dictionary, coded.indices.to_numpy()
        odd = np.logical_or.reduceat(_true(pc.match_substring_regex(unique, _ODD.pattern))[places], starts[:-1])
        blank, first = _true(pc.equal(unique, "")), np.zeros(len(places), bool)
        first[starts[:-1]] = True
        begins, ends = (
            (blank | _true(pc.not_equal(pc.binary_length(trim(unique)), pc.binary_length(unique))))[places]
            for trim in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace)
        )
        # An empty first piece has no white space before it.
        ends &= ~(first & blank[places])
        heads = np.flatnonzero(first | ~begins | ~np.concatenate([[False], ends[:-1]]))
        sizes = np.diff(heads, append=len(places))
        # Pieces put together again, and first ones, which have no space before them.
        own = np.flatnonzero((sizes > 1) | first[heads])
        offsets = np.concatenate([[0], np.cumsum(sizes[own])])
        members = np.repeat(heads[own] - offsets[:-1], sizes[own]) + np.arange(offsets[-1])
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), unique.take(pa.array(places[members]))), " ")
        leads = pa.array(np.where(first[heads[own]], "", " "))
        pieces = pa.concat_arrays([pc.binary_join_element_wise(x, y, "") for x, y in ((" ", unique), (leads, runs))])
        places = places[heads]
        places[own] = len(unique) + np.arange(len(own))
        taken = self.piece_ids(pieces).take(pa.array(places))
        bounds, flat = _bounds(taken)[np.searchsorted(heads, starts)].tolist(), memoryview(taken.buffers()[2])
        for k, whole in enumerate(odd.tolist()):
            yield self.whole([texts[k].as_py()])[0] if whole else bytes(flat[bounds[k] : bounds[k + 1]])

    def piece_ids(self, pieces: pa.Array) -> pa.Array:
        for pattern, cut in _CUTS:
            pieces = pc.replace_substring_regex(pieces, pattern, cut)
        split = pc.split_pattern(pieces, _CUT)
        coded = pc.dictionary_encode(split.flatten())
        taken = self.word_ids(coded.dictionary).take(coded.indices)
        bounds = _bounds(taken)[split.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(bounds), taken.buffers()[2]])

    def word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of different words. Of those asked for before, the latest are kept."""
        at = pc.index_in(words, value_set=self.kept[0])
        new = words.filter(at.is_null())
        plain = pc.match_substring_regex(new, _PLAIN_WORD)
        fresh = [new.filter(plain), new.filter(pc.invert(plain))]
        found = [self.merged(fresh[0]), pa.array([self.ids(word) for word in fresh[1].to_pylist()], pa.large_binary())]
        kept, ids = pa.concat_arrays([self.kept[0], *fresh]), pa.concat_arrays([self.kept[1], *found])
        places, missing = at.fill_null(0).to_numpy().astype("int64"), np.flatnonzero(_true(at.is_null()))
        places[np.concatenate([missing[_true(plain)], missing[~_true(plain)]])] = len(self.kept[0]) + np.arange(len(new))
        rest = np.ones(len(kept), bool)
        rest[places] = False
        order = pa.array(np.concatenate([places, np.flatnonzero(rest)])[:KEPT_WORDS])
        self.kept = kept.take(order), ids.take(order)
        return ids.take(pa.array(places))

    def merged(self, words: pa.Array) -> pa.Array:
        """Ids of Latin words, with or without a space before them."""
        if not len(words):
            return pa.array([], pa.large_binary())
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), _CUT)[0].as_buffer()
        ids, ends = array("I"), array("q", [0])
        for shown in codecs.charmap_decode(joined, "strict", _BYTES)[0].split(_BYTES[ord(_CUT)]):
            ids.extend([t.id for t in self.model.tokenize(shown)])
            ends.append(4 * len(ids))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def _true(flags: pa.Array) -> np.ndarray:
    return flags.to_numpy(zero_copy_only=False)


def _bounds(rows: pa.Array) -> np.ndarray:
    return np.frombuffer(rows.buffers()[1], "<i8", len(rows) + 1)


class Known(dict):
    """Ids by unit, found when first asked for. When there are too many, those not asked for since the last time go."""

    def __init__(self, find: Callable[[str], tuple[bytes, bool]]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, unit: str) -> bytes:
        if (ids := self.older.get(unit)) is None:
            ids, keep = self.find(unit)
            if not keep:
                return ids
        if len(self) >= KEPT_UNITS:
            self.older = dict(self)
            self.clear()
        self[unit] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(name: str, spaces: bool) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(name, spaces)
