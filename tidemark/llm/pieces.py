"""SentencePiece merges without merging: the last token of every prefix, found by automaton.

A sequence of tokens is what merging yields exactly if each two neighbours, encoded alone, stay
as they are. So every prefix of a text has one last token: the suffix of it that ends there and
is compatible with the last token of the prefix before. One pass fills the table, one walk
backwards reads the ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm import shared as S
from tidemark.llm.tokens import vocabulary

SPACE = "▁"
BEGIN, FINISH = 1, 2


class Pieces:
    """Encoder and decoder for a merge-type model with byte fallback and plain normalisation."""

    UNITS = 500_000
    PAIRS = 1_000_000

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        self.text, self.score, self.byte = {}, {}, {}
        self.id: dict[str, int] = {}
        self.out: list[bytes] = []
        joints = set()
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            self.out.append(b"")
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.NORMAL:
                self.id[p.piece], self.text[i], self.score[i] = i, p.piece, p.score
                self.out[i] = p.piece.replace(SPACE, " ").encode()
                joints.update(p.piece[k : k + 2] for k in range(len(p.piece) - 1))
            elif p.type == kinds.UNKNOWN:
                self.out[i] = " ⁇ ".encode()
        for i, piece in self.text.items():
            if self.merge(piece) == [i]:  # others are never the outcome of merging
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.joints = joints
        self.units: dict[str, bytes] = {}
        self.runs: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """Ids by merging the best-scored neighbours, leftmost first; for pairs of tokens only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.id.get(p, 0) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens in a row stay so when they are encoded alone."""
        if self.text[left][-1] + self.text[right][0] not in self.joints:
            return True
        return self.merge(self.text[left] + self.text[right]) == [left, right]

    def last_tokens(self, run: str) -> list[int]:
        """The table: entry k is the unique last token of the first k + 1 characters."""
        last, pairs = [-1] * len(run), self.pairs
        for end, (token, length) in self.automaton.iter(run):
            before = end - length
            if before < 0:
                last[end] = token
                continue
            left = last[before]
            if left < 0:
                continue
            key = (left << 16) | token
            known = pairs.get(key)
            if known is None:
                if len(pairs) >= self.PAIRS:
                    pairs.clear()
                known = pairs[key] = self.compatible(left, token)
            if known:
                last[end] = token
        return last

    def encode_run(self, run: str) -> list[int]:
        """Ids of characters of which each two neighbours stand in some token."""
        known = self.runs.get(run)
        if known is None:
            known = self._backwards(run)
            if len(run) < 64:
                self.runs[run] = known
        return known

    def _backwards(self, run: str) -> list[int]:
        if len(run) == 1:
            i = self.id.get(run)
            return [i] if i is not None else [self.byte[b] for b in run.encode()]
        last, ids, at = self.last_tokens(run), [], len(run) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.text[last[at]])
        return ids[::-1]

    def encode_unit(self, unit: str) -> bytes:
        """A unit's ids; it is cut where no token holds both neighbours, so no merge crosses."""
        if len(self.runs) > self.UNITS:
            self.runs.clear()
        ids, start = [], 0
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in self.joints:
                ids += self.encode_run(unit[start:k])
                start = k
        ids += self.encode_run(unit[start:])
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit numbers, without begin and end."""
        if not text:
            return b""
        if len(self.units) > self.UNITS:
            self.units.clear()
        known, out = self.units, []
        for unit in self._units(text):
            ids = known.get(unit)
            if ids is None:
                ids = self.encode_unit(unit)
                if len(unit) < 64:
                    known[unit] = ids
            out.append(ids)
        return b"".join(out)

    @staticmethod
    def _units(text: str):
        """Words with the spaces before them; tokens hold spaces at their start only."""
        spaces = 1
        for word in text.replace(SPACE, " ").split(" "):
            if word:
                yield SPACE * spaces + word
                spaces = 1
            else:
                spaces += 1
        if spaces > 1:
            yield SPACE * (spaces - 1)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces in a row, bytes as UTF-8, without the space put first."""
        raw = b"".join(map(self.out.__getitem__, ids))
        text = raw.decode(errors="replace")
        return text[1:] if text[:1] == " " else text


_MODELS: dict[str, Pieces] = {}


def model(path: str | None) -> Pieces:
    path = path or vocabulary("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


RESULT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode(path: str | None, with_values: bool):
    def run(batches):
        own = model(path)
        first, final = (np.array([i], "<u4").tobytes() for i in (BEGIN, FINISH))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                raw = first + own.encode(text.as_py() or "") + final
                ids = np.frombuffer(raw, "<u4").tolist()
                decoded = own.decode(ids)
                row = (
                    doc_id.as_py(),
                    len(ids),
                    hashlib.sha256(raw).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )
                rows.append((*row, ids, decoded) if with_values else row)
            yield S.record(rows, RESULT_DDL + VALUES * with_values)

    return run


VALUES = ", ids array<long>, decoded string"


def encode_documents(docs: DataFrame, path: str | None = None, with_values: bool = False):
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on demand, the
    ``ids`` and the ``decoded`` text.

    Ids are those of the sentencepiece library with begin and end ids and without sampling; null
    text is empty and has these two only. Digests are of little-endian 32-bit ids and of UTF-8.
    """
    S.attach(docs.sparkSession)
    return S.texts(docs).mapInArrow(_encode(path, with_values), RESULT_DDL + VALUES * with_values)
