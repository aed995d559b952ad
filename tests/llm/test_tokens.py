"""Packing, shards, encoding and counts against the libraries and brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import materialise, packing, pieces, tokens, wordpiece
from tidemark.session import written

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  ", "A.B,c.,  x", "<|endoftext|> a<|EndOfText|>.", "It's I'LL don't.",
    "naïve É. ÉÉ, İstanbul Σας ΣΑΣ", "á é. ́x", "12,34.5 ½.", "a\x85b\xa0c d.",
    "日本語。テキスト,", "x..,,.. ,,", "\x00\x1c a", "🙂. 🙂🙂,", "a÷. b×, µ.",
]


def test_word_encoder():
    library, own = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    found = own.encode([t.encode() for t in ODD])
    assert [f.tolist() for f in found] == [
        library.encode(t, add_special_tokens=False).ids for t in ODD
    ]


def test_words_learned_together():
    """Thousands of new words at once, words that hold special tokens among them, and a small memory."""
    rng = random.Random(3)
    letters = "abcxyzABCÄéßİσΣ日本🙂'.,-<|>0123 \t\n\u0301"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    special = ["a<|endoftext|>b <|endoftext|", "<|startoftext|>", "x<|endoftext|><|endoftext|>y"]
    texts[7::500] = [special[i % 3] for i in range(len(texts[7::500]))]
    library, own = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    own.MOST = 3000
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 900):
        found = own.encode([t.encode() for t in texts[k : k + 900]])
        assert [f.tolist() for f in found] == want[k : k + 900]


class Asked(tokens.Numbers):
    """Counts how often a number is asked for."""

    def __init__(self):
        super().__init__()
        self.times = 0

    def __getitem__(self, word):
        self.times += 1
        return super().__getitem__(word)


def test_a_batch_asks_once_for_a_word():
    own = tokens.WordEncoder(WORD)
    own.at = Asked()
    found = own.encode([b"the quick fox, " * 2000, b"The quick " * 3000, b""])
    assert own.at.times <= 6 and list(map(len, found)) == [8000, 6000, 0]


def test_simple_words_go_to_the_merges():
    """Only words with other characters are normalised and split by the tokenizer's rules."""
    library, own = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    rng, by_rules = random.Random(8), []
    joined = own._joined
    own._joined = lambda words: by_rules.extend(words) or joined(words)
    letters = "abcdeinorstußàéñöøÿ"
    texts = ["".join(rng.choices(letters + letters[:-1].upper() + "   ", k=400)) for _ in range(200)]
    marks = "".join(map(chr, range(33, 127))).replace("<", "").lower() + ".,"
    texts += ["".join(rng.choices(marks + "stmdrevlß ", k=400)) for _ in range(100)]
    texts += ["it's I'LL don''t 'RE've 'x's' 's'", "1234.5,6 a1b2 ''s"]
    texts += ["x" * 5000 + " ÿ", "ab 日本 Straße straße\u0301 e\u0301", "µ ªº ÷ ×a <|endoftext|> ab", "a's 1b"]
    found = own.encode([t.encode() for t in texts])
    assert [f.tolist() for f in found] == [
        library.encode(t, add_special_tokens=False).ids for t in texts
    ]
    assert len(own.at) > 5000 and len(by_rules) < 20


def test_stops_are_set_apart_within_their_text():
    library, own = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    texts = [".", ".a", "é", ". b", "a.", ",", "b,\n", "c.\n\n", "ÿ. ÷. ß, 1. A. a.b. x.,", "日本 a. é, B.", "",
             "<| a. b,", "a.\t", "Ö,", "a,"]
    found = own.encode([t.encode() for t in texts])
    assert [f.tolist() for f in found] == [
        library.encode(t, add_special_tokens=False).ids for t in texts
    ]
    assert {b"a", b"."} <= set(own.at) and b"a.b" in own.at and b"1." in own.at
    assert {b"B.", b"b,"} <= set(own.at)  # of texts that are not changed


def brute_pieces(rows):
    library, out = Tokenizer.from_file(WORD), []
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            out.append((d, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_packed(rows, capacity):
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("name", ["documents", "odd", "repeated", "empty"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    rows = packing.packed_documents(df).collect()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = brute_pieces([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted((tuple(r[k] for k in keys) for r in rows), key=repr) == want
    sequences = check_packed(rows, 4096)
    least = packing.lower_bound(packing.feasible_sums(np.array([r["length"] for r in rows]), 4096))
    assert sequences == least


def test_groups_exchange_what_does_not_fit(spark):
    lengths = [3000, 1096] * 30 + [2048] * 11 + [700] * 17
    held = written(
        spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE_DDL),
        "test-pieces",
    )
    rows = packing.pack(held, 4096, group=6).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    assert check_packed(rows, 4096) <= packing.lower_bound(
        packing.feasible_sums(np.array(lengths), 4096)
    ) + 1


def test_groups_stay_bounded(spark):
    """Lengths that leave room everywhere, half of them under one doc_id."""
    rng = random.Random(6)
    lengths = [rng.randint(1000, 2000) for _ in range(600)]
    rows = [(None if i % 2 else i, i // 2, i, n, 0) for i, n in enumerate(lengths)]
    rows = [(d, 0 if d is None else p, *r) for d, p, *r in rows]
    held = written(spark.createDataFrame(rows, packing.PIECE_DDL).coalesce(1), "test-bounded")
    got = packing.pack(held, 4096, group=60, most=60).collect()
    assert sorted(r["start"] for r in got) == list(range(600))
    sequences = check_packed(got, 4096)
    assert sequences <= 1.05 * len(packing.best_fit(lengths, 4096)[2])
    sizes = collections.Counter(r["sequence_id"] >> 20 for r in got)
    assert max(sizes.values()) <= 120


def test_bounds_hold():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 40))]
        bins, offsets, room = packing.best_fit(lengths, capacity)
        assert min(room, default=0) >= 0
        assert packing.lower_bound(packing.feasible_sums(np.array(lengths, np.int64), capacity)) <= len(room)


def test_permutation():
    for size in (1, 2, 3, 17, 1000, 4097):
        order = materialise.Permutation(size, 7)
        slots = order.slots(np.arange(size))
        assert sorted(slots.tolist()) == list(range(size))
        assert order.numbers(slots).tolist() == list(range(size))
    one, two = (materialise.Permutation(1000, k).slots(np.arange(1000)) for k in (1, 2))
    assert (one != two).any()


def test_slots_follow_the_permutation(spark, documents):
    """Numbers count sequences in the order of the rows; slots are the order of their places."""
    docs = documents.select("doc_id", "text").orderBy("doc_id").coalesce(1)
    docs = written(docs, "one-part")
    folder, total = materialise.materialise(docs, length=64, per_shard=50)
    library = Tokenizer.from_file(WORD)
    pieces, most = [], 0
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [materialise.END]
        pieces += [(r["doc_id"], k) for k in range(-(-len(ids) // 64))]
        most += (len((r["text"] or "").encode()) * materialise.MOST_PER_BYTE + 64) // 64
    places = materialise.Permutation(most, materialise.KEY).slots(np.arange(len(pieces)))
    want = [pieces[i] for i in np.argsort(places)]
    rows = sorted(materialise.read_shards(spark, folder, 64).collect(), key=lambda r: r["slot"])
    assert total == len(pieces) and [(r["doc_id"], r["piece"]) for r in rows] == want


def test_numbers_of_shuffled_input(spark, documents):
    """An input that is planned anew for every pass is written first."""
    docs = documents.select("doc_id", "text").repartition(5, "doc_id")
    folder, total = materialise.materialise(docs, length=64, per_shard=50)
    rows = materialise.read_shards(spark, folder, 64).collect()
    assert sorted(r["slot"] for r in rows) == list(range(total))
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == total


def test_shards_round_trip(spark, odd, repeated, empty):
    library = Tokenizer.from_file(WORD)
    for df in (odd, repeated):
        folder, total = materialise.materialise(df, length=32, per_shard=16)
        rows = materialise.read_shards(spark, folder, 32, 16).collect()
        assert sorted(r["slot"] for r in rows) == list(range(total))
        texts = collections.Counter()
        want = collections.Counter()
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [materialise.END]
            for k in range(0, len(ids), 32):
                want[r["doc_id"], k // 32, tuple(ids[k : k + 32])] += 1
        for r in rows:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"]
            texts[r["doc_id"], r["piece"], tuple(np.frombuffer(r["ids"], "<u2").tolist())] += 1
        assert texts == want
        later = materialise.read_shards(spark, folder, 32, 16, first=20)
        assert sorted(r["slot"] for r in later.collect()) == list(range(20, total))
    folder, total = materialise.materialise(empty)
    assert total == 0 and materialise.read_shards(spark, folder).count() == 0


def test_pieces_equal_the_library(documents, odd, repeated, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for df in (documents, odd, repeated, empty):
        want = []
        for r in df.collect():
            ids = [1, *library.encode(r["text"] or ""), 2]
            raw = library.decode(ids).encode()
            want.append(
                (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                 hashlib.sha256(raw).hexdigest())
            )
        got = [tuple(r) for r in pieces.encode_documents(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pieces_on_random_strings():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own, rng = pieces.Pieces(PIECE), random.Random(2)
    words = [library.id_to_piece(i) for i in range(260, 32000)]
    texts = ODD + [" " * n for n in range(1, 40)] + ["aaaa" * n for n in range(20)]
    texts += ["".join(rng.choices(words, k=8)) for _ in range(500)]
    texts += ["".join(rng.choices("abcdeinorst ▁e.", k=40)) for _ in range(500)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == library.encode(t)
        assert own.decode([1, *ids, 2]) == library.decode(ids)


def greedy(word, vocabulary):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_counts(documents, odd, empty):
    proto = sentencepiece.sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PIECE, "rb").read())
    vocabulary = {p.piece for p in proto.pieces if p.type == 1}
    for df in (documents.limit(60), odd, empty):
        want = []
        for r in df.collect():
            words = [w.decode() for w in (r["text"] or "").encode().split()]
            n = [greedy("▁" + w, vocabulary) if len(w) < 5000 else None for w in words]
            if None in n:
                continue
            want.append((r["doc_id"], len(words), sum(x or 1 for x in n), n.count(0)))
        got = {tuple(r) for r in wordpiece.token_counts(df).collect()}
        assert set(want) <= got and len(got) == df.count()


def test_counter_on_a_small_vocabulary():
    vocabulary = ["▁", "▁a", "ab", "a", "abcd", "bc", "c", "d", "▁abcde", "cdx"]
    own, rng = wordpiece.Counter(vocabulary), random.Random(4)
    for _ in range(3000):
        word = "▁" + "".join(rng.choices("abcdex", k=rng.randint(0, 9)))
        assert own.length(word) == greedy(word, set(vocabulary)), word
