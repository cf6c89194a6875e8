"""Token ids of whole texts, by the tokenizers library, with each stretch of text encoded once.

Byte-level BPE splits a text before it merges, and some places always lie between two pieces of it: in front of a single
blank, around a line feed, and between a letter or digit and the mark behind it. So a text without longer runs of white space
is the concatenation of the parts that these places cut it into. Parts repeat a great deal; each distinct one goes to the
library once, and a text's ids are gathered from what it gave. Parts that are one word of letters (a piece of their own) skip the
library's splitting, and go to its merging as the characters that stand for their bytes. Texts for which that reasoning
does not hold (three blanks running, two at the end, a special token's string) go to the library whole, and so does every
text if the tokenizer's file asks for any other normalization or splitting.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import spread, text_buffers

#: White space as any of the library's patterns may see it, and what may stand in its place.
_BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_ODD = _BLANK + "{3}|" + _BLANK + r"{2}\z"
#: One word of letters with or without the space in front.
_WORD = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
#: Distinct parts, and their ids, that a worker keeps; beyond that it forgets those that it did not meet again, and a third at least.
PARTS, IDS = 600_000, 4_000_000
#: Words that the library gets as one text.
_TOGETHER = 2000

#: What a byte can be, as bits: a mark, a letter or digit, the second byte of a letter from U+00C0 to U+00FF (all but the signs of
#: multiplication and division are), the byte in front of those, a space or line feed, a line feed.
_MARK, _ALNUM, _LATIN, _LEAD, _GAP, _FEED = (np.uint8(1 << k) for k in range(6))
_KIND = bytes(
    _MARK * (33 <= c < 127 and not chr(c).isalnum()) | _ALNUM * (c < 128 and chr(c).isalnum()) | _LATIN * (0x80 <= c < 0xC0 and c not in (0x97, 0xB7)) | _LEAD * (c == 0xC3) | _GAP * (c in (10, 32)) | _FEED * (c == 10)
    for c in range(256)
)
#: What keeps the first bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


def _characters() -> np.ndarray:
    """The code points that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on;
    a line feed stays, to part words."""
    shown = [c for c in range(256) if 33 <= c < 127 or 161 <= c and c != 173]
    table = np.arange(256, dtype="<u4")
    hidden = np.setdiff1d(np.arange(256), shown)
    table[hidden] = 256 + np.arange(len(hidden))
    table[10] = 10
    return table


_CHARACTER = _characters()


def _binary(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Ids one after another, and how many each row has, as a column of their bytes."""
    at = 4 * np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids, np.uint32))])


class _Known:
    """Distinct parts in the order in which they were learned, the ids of each as bytes, and in how many calls it was met (half of
    them, for those kept since)."""

    def __init__(self, kind: pa.DataType):
        self.names, self.codes, self.met = pa.array([], kind), pa.array([], pa.large_binary()), np.zeros(0, np.int32)

    def find(self, parts: pa.Array, learn) -> np.ndarray:
        """The number of each part; learn() gives the ids of those that are new."""
        if not len(parts):
            return np.zeros(0, np.int32)
        # known parts come first, so that each keeps its number, and those that are new stand behind
        found = pa.chunked_array([self.names, parts]).dictionary_encode().chunks[-1]
        known, names, number = len(self.names), found.dictionary, found.indices.to_numpy()
        if len(names) > known:
            self.codes = pa.concat_arrays([self.codes, learn(names.slice(known))])
        self.names = names
        here = np.zeros(len(names), np.int32)
        here[number] = 1
        here[:known] += self.met
        self.met = here
        return number

    def forget(self, most: int) -> None:
        """Keeps the parts that were met most often, and more than once, and no more than `most`."""
        often = np.flatnonzero(self.met > 1)
        often = np.sort(often[np.argsort(-self.met[often], kind="stable")[:most]])
        kept = pa.array(often)
        self.names, self.codes, self.met = self.names.take(kept), self.codes.take(kept), self.met[often] // 2

    @property
    def used(self) -> int:
        """Ids of all parts."""
        at, _ = text_buffers(self.codes)
        return int(at[-1] - at[0]) // 4


def _unpacked(keys: pa.Array) -> pa.Array:
    """Short parts of the numbers that stand for them: their bytes, and the length in the highest one."""
    number = keys.to_numpy()
    lengths = (number >> np.uint64(56)).astype(np.int64)
    data = number.astype("<u8").view(np.uint8).reshape(-1, 8)[np.arange(8) < lengths[:, None]]
    return pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(np.concatenate(([0], np.cumsum(lengths)))), pa.py_buffer(data))


class Encoder:
    """encode(texts) gives (ids of all texts one after another, how many each has), as the library's encode() with
    add_special_tokens=False does."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
        #: Whether the file asks for the splitting that parts rely on, and nothing else.
        self.by_parts = (
            not any(told.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
        )
        if self.by_parts:
            #: Which ids begin with a space.
            self.spaced = np.zeros(1 + max(model["vocab"].values()), bool)
            self.spaced[[i for t, i in model["vocab"].items() if t.startswith("\u0120")]] = True
            self.merger = Tokenizer(self.tokenizer.model)
            self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    @classmethod
    def clear_all(cls) -> None:
        for x in cls._own.values():
            x.clear()

    def clear(self) -> None:
        """Forgets all parts."""
        #: Those of up to seven bytes, as numbers, which are found several times faster, and longer ones.
        self.short, self.long = _Known(pa.uint64()), _Known(pa.large_string())

    def _forget(self) -> None:
        """Keeps the parts that were met most often."""
        self.short.forget(PARTS // 3)
        self.long.forget(PARTS // 3)
        if self.short.used + self.long.used > IDS // 2:
            self.clear()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    def _words(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """As _library() of words of letters, all or none with a space in front: their bytes' characters, many words to a
        text, parted by line feeds. Where a word's ids begin, one says that stands for a space, or the library."""
        at, data = text_buffers(words)
        lengths = np.diff(at)
        joined = np.full(int(lengths.sum()) + len(words), 10, np.uint8)
        ends = np.cumsum(lengths + 1)
        joined[spread(ends - lengths - 1, lengths)] = data[at[0] : at[-1]]
        cuts = [0, *ends[_TOGETHER - 1 : -1 : _TOGETHER].tolist(), len(joined)]
        texts = [_CHARACTER[joined[i:j]].tobytes().decode("utf-32-le") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        if spaced:
            got = [x.ids for x in self.merger.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
            return ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        got = [(x.ids, x.word_ids) for x in self.merger.encode_batch(texts, add_special_tokens=False)]
        ids = np.concatenate([np.array(x, np.uint32) for x, _ in got])
        return ids, np.concatenate([np.bincount(np.array(x, np.int64)) for _, x in got])

    def _learn(self, new: pa.Array) -> pa.Array:
        """The ids of distinct parts, as bytes."""
        word, spaced = pc.match_substring_regex(new, _WORD), pc.starts_with(new, " ")
        order, ids, lengths = [], [], []
        for which, take in (
            (pc.and_(word, spaced), lambda x: self._words(x, True)),
            (pc.and_not(word, spaced), lambda x: self._words(x, False)),
            (pc.invert(word), lambda x: self._library(x.to_pylist())),
        ):
            some = new.filter(which)
            if len(some):
                for whole, got in zip((order, ids, lengths), (np.flatnonzero(which.to_numpy(zero_copy_only=False)), *take(some)), strict=True):
                    whole.append(got)
        place = np.empty(len(new), np.int64)
        place[np.concatenate(order)] = np.arange(len(new))
        return _binary(np.concatenate(ids), np.concatenate(lengths)).take(pa.array(place))

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of the parts of all texts, one after another, as bytes, and how many parts each text has."""
        at, data = text_buffers(texts)
        data = data[at[0] : at[-1]]
        at = at - at[0]
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        letter = (kind & _ALNUM) > 0
        letter[1:] |= ((kind[1:] & _LATIN) > 0) & ((kind[:-1] & _LEAD) > 0)
        begin = (kind & _GAP) > 0
        begin[1:] |= (kind[:-1] & _FEED) > 0
        begin[1:] |= ((kind[1:] & _MARK) > 0) & letter[:-1]
        begin[at[:-1][np.diff(at) > 0]] = True
        places = np.flatnonzero(begin)
        ends = np.concatenate((places, [len(data)]))
        parts = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(data))
        lengths = np.diff(ends)
        short, long = np.flatnonzero(lengths < 8), np.flatnonzero(lengths >= 8)
        # eight bytes from each place on, of which the part's own stay
        eight, n = np.ndarray((len(data) + 1,), "<u8", raw + bytes(8), 0, (1,)), lengths.take(short)
        keys = eight[places.take(short)] & _FIRST.take(n) | n.astype(np.uint64) << np.uint64(56)
        number = np.empty(len(places), np.int64)
        number[short] = self.short.find(pa.array(keys), lambda new: self._learn(_unpacked(new)))
        number[long] = self.long.find(parts.take(pa.array(long)), self._learn)
        number[long] += len(self.short.names)
        codes = pa.concat_arrays([self.short.codes, self.long.codes]).take(pa.array(number))
        return codes, np.diff(np.searchsorted(places, at))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_parts:
            return self._library(texts.to_pylist())
        if len(self.short.names) + len(self.long.names) > PARTS or self.short.used + self.long.used > IDS:
            self._forget()
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        apart = odd.to_numpy(zero_copy_only=False)
        codes, many = self._parts(texts.filter(pc.invert(odd)) if apart.any() else texts)
        at, data = text_buffers(codes)
        run, ids = (at - at[0]) // 4, data[at[0] : at[-1]].view(np.uint32)
        edges = np.concatenate(([0], np.cumsum(many)))
        n = run[edges[1:]] - run[edges[:-1]]
        if not apart.any():
            return ids, n
        more, m = self._library(texts.filter(odd).to_pylist())
        size = np.empty(len(texts), np.int64)
        size[~apart], size[apart] = n, m
        out, starts = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        out[spread(starts[~apart], n)] = ids
        out[spread(starts[apart], m)] = more
        return out, size
