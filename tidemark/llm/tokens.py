"""Token ids of whole texts by a public tokenizer, word by word with a memory of words.

The tokenizer's rules never join characters across white space, so a text's ids are the ids of
its words in a row. The words of a batch are told apart by Arrow, and each different one is looked
up once; most of these were seen before.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: How a pre-tokenizer parts words, and the same for words of ``_SIMPLE`` characters in valid
#: UTF-8: printable ASCII without A-Z and <, and lower-case letters of Latin-1.
_RULES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile(rb"'(?:[stmd]|re|ve|ll)|[a-z\xc3\x9f-\xb6\xb8-\xbf]+|[0-9]|[!-/:-@\[-`{-~]+")
_SIMPLE = re.compile(rb"[a-z\xc3\x9f-\xb6\xb8-\xbf!-;=-@\[-`{-~]+")


def _lowered(text: bytes) -> tuple[bytes, bool]:
    """The text in lower case, and whether it is one that may be changed.

    These are texts of Latin-1 letters, whose lower case is the same everywhere, and without
    anything that could be a special token.
    """
    if b"<|" in text:
        return text, False
    if text.isascii():
        return text.lower(), True
    plain = text.decode()
    try:
        plain.encode("latin-1")
    except UnicodeEncodeError:
        return text, False
    return plain.lower().encode(), True


def _plain(texts: list[bytes]) -> pa.Array:
    """Texts with fewer different words and the same ids: in lower case, stops apart.

    A full stop or comma after a letter and before white space is a token of its own. Each text
    has a line feed more at its end.
    """
    lowered, free = zip(*map(_lowered, texts))
    raw = np.frombuffer(b"".join([b"\n", *(t + b"\n" for t in lowered)]), np.uint8)
    offsets = np.cumsum([1, *(len(t) + 1 for t in lowered)])
    stops = np.flatnonzero((raw == ord(".")) | (raw == ord(",")))
    before, after = raw[stops - 1], raw[stops + 1]
    letter = (before >= ord("a")) & (before <= ord("z"))
    letter |= (raw[stops - 2] == 0xC3) & (before >= 0x9F) & (before <= 0xBF) & (before != 0xB7)
    stops = stops[letter & ((after == ord(" ")) | (after == ord("\n")))]
    stops = stops[np.array(free)[np.searchsorted(offsets, stops, "right") - 1]]
    offsets += np.searchsorted(stops, offsets)
    parts = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.insert(raw, stops, ord(" ")))]
    return pa.Array.from_buffers(pa.large_string(), len(texts), parts)


class Numbers(dict):
    """Numbers words as they are asked for; ``new`` lists those not seen before."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokenizer splits at white space.

    New words are tokenised many at a time with a special token between them, which no rule
    joins to its neighbours, so that it also marks where the ids of the next word begin. Words of
    simple characters, most of the new ones, are already what normalising would make of them: if
    the tokenizer parts words by ``_RULES``, their parts go straight to its merges with spaces
    between, and a part ends where a token has the vocabulary's mark of an end.
    """

    MOST = 600_000
    TOGETHER = 1000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.mark = None, -1
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            if token.special and not (token.normalized or token.lstrip or token.rstrip):
                self.separator, self.mark = token.content, number
        self.merges, suffix = None, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and json.dumps(_RULES) in self.tokenizer.to_str():
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ])
            tokens = self.merges.get_vocab()
            self.closes = np.zeros(max(tokens.values()) + 1, bool)
            self.closes[[n for t, n in tokens.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.ids = np.empty(1 << 20, np.uint32)
        self.start = np.empty(1 << 16, np.int64)
        self.length = np.empty(1 << 16, np.int64)
        self.used = 0

    def _remember(self, numbers: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.at) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(flat)

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has."""
        words = [w.decode() for w in words]
        if self.separator and not any(self.separator[0] in w for w in words):
            flat = np.array(self._ids([self.separator.join(words)])[0], np.uint32)
            ends = np.append(np.flatnonzero(flat == self.mark), len(flat))
            if len(ends) == len(words):
                return flat[flat != self.mark], np.diff(ends, prepend=-1) - 1
        each = self._ids(words)
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32, lengths.sum()), lengths

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of simple characters."""
        parts = [[w] if w.isalpha() else _PARTS.findall(w) for w in words]
        together = [b" ".join(itertools.chain.from_iterable(parts)).decode()]
        found = self.merges.encode_batch_fast(together, add_special_tokens=False)[0].ids
        flat = np.array(found, np.uint32)
        ends = np.flatnonzero(self.closes[flat]) + 1
        last = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        if len(ends) == last[-1] and ends[-1] == len(flat):
            return flat, np.diff(ends[last - 1], prepend=0)
        return self._joined(words)

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > self.MOST:
            self.clear()
        first = len(self.at)
        places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        new, self.at.new = self.at.new, []
        simple = [self.merges is not None and _SIMPLE.fullmatch(w) is not None for w in new]
        for work, own in ((self._merged, simple), (self._joined, [not x for x in simple])):
            mine = list(itertools.compress(new, own))
            numbers = first + np.flatnonzero(own)
            for k in range(0, len(mine), self.TOGETHER):
                self._remember(numbers[k : k + self.TOGETHER], *work(mine[k : k + self.TOGETHER]))
        return places

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, all of it, without special tokens around it."""
        if not texts:
            return []
        split = pc.ascii_split_whitespace(_plain(texts))
        words = pc.dictionary_encode(split.flatten())
        different = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        place = self._places(different.tolist())
        word = words.indices.to_numpy()
        lengths, starts = self.length[place][word], self.start[place][word]
        out, bounds = [], split.offsets.to_numpy().tolist()
        for at, after in zip(bounds, bounds[1:]):
            length, start = lengths[at:after], starts[at:after]
            ends = np.cumsum(length)
            total = int(ends[-1])
            out.append(self.ids[np.arange(total) + np.repeat(start - (ends - length), length)])
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
