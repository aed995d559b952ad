"""Token counts by greedy longest match, in one pass over an automaton that only counts.

Every state of the vocabulary's trie knows where to go on when it cannot be extended and how
many tokens that pops. The pieces themselves are never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.llm import shared as S
from tidemark.llm.tokens import vocabulary

MARK = "▁"


class Counter:
    """Longest-match automaton of a vocabulary; words are matched behind a start mark."""

    MOST = 1_000_000

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        token_at = [False]
        for token in tokens:
            state = 0
            for c in token:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    token_at.append(False)
                state = self.next[state][c]
            token_at[state] = bool(token)
        # fail: state after popping the longest tokens, -1 where there are none to pop
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        todo = [0]
        for state in todo:
            for c, child in self.next[state].items():
                todo.append(child)
                if token_at[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, popped = self.fail[state], self.popped[state]
                while at >= 0 and c not in self.next[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at][c], popped
        self.known: dict[str, int] = {}

    def length(self, word: str) -> int:
        """Tokens of a word, 0 if no greedy segmentation covers it."""
        nexts, fail, popped = self.next, self.fail, self.popped
        state, n = 0, 0
        for c in word:
            while c not in nexts[state]:
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return 0
            state = nexts[state][c]
        while state:
            n += popped[state]
            state = fail[state]
            if state < 0:
                return 0
        return n

    def count(self, words: list[str]) -> tuple[int, int]:
        """Tokens of all words, an unknown word being one, and how many are unknown."""
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        total = unknown = 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.length(MARK + word)
                if len(word) < 64:
                    known[word] = n
            if n:
                total += n
            else:
                total += 1
                unknown += 1
        return total, unknown


_COUNTERS: dict[str, Counter] = {}


def counter(path: str | None) -> Counter:
    path = path or vocabulary("piece_bpe_32k.model")
    if path not in _COUNTERS:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = proto.ModelProto.SentencePiece.NORMAL
        _COUNTERS[path] = Counter([p.piece for p in model.pieces if p.type == normal])
    return _COUNTERS[path]


RESULT_DDL = "doc_id long, n_words long, n_tokens long, n_unknown long"


def _count(path: str | None):
    def run(batches):
        own = counter(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode()
                words = raw.decode().split() if raw.isascii() else [
                    w.decode() for w in raw.split()
                ]
                if raw.isascii() and any(c in raw for c in b"\x1c\x1d\x1e\x1f"):
                    words = [w.decode() for w in raw.split()]
                rows.append((doc_id.as_py(), len(words), *own.count(words)))
            yield S.record(rows, RESULT_DDL)

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document ``doc_id, n_words, n_tokens, n_unknown``.

    Words are runs of other than ASCII white space, as they are. Each is segmented greedily
    from the left into the longest vocabulary pieces, the first of which carries the start
    mark; a word that cannot be covered counts as one unknown token. Null text has none.
    """
    S.attach(docs.sparkSession)
    return S.texts(docs).mapInArrow(_count(path), RESULT_DDL)
