"""Quality rules and a calibrated n-gram classifier over whole texts."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared as S

LABELLED = 2000
BUCKETS = 1 << 16
THRESHOLD = 0.5
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_START = np.array([(b & 0xC0) != 0x80 and not SPACE[b] for b in range(256)])


def base_counts(raw: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """Code points in words, symbols, repeated lines, words in repeated 5-word windows."""
    chars = int(_START[np.frombuffer(raw, np.uint8)].sum())
    symbols = sum(raw.count(bytes([s])) for s in SYMBOLS)
    seen, lines = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            lines += bool(line.strip())
        else:
            seen.add(line)
    repeated = 0
    if len(words) > WINDOW:
        windows = S.window_hashes(hashes, WINDOW)
        _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
        often = (count > 1)[place]
        if often.any():
            edge = np.zeros(len(words) + 1, np.int64)
            edge[: len(often)] += often
            edge[WINDOW : WINDOW + len(often)] -= often
            repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    return chars, symbols, lines, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _buckets(values: np.ndarray, kind: int) -> np.ndarray:
    return (S.mix(values + np.uint64(kind << 56)) >> np.uint64(48)).astype(np.int64)


def feature_groups(raw: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Buckets of words, word pairs, and byte n-grams of 3 and 5; each group weighs the same."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    groups = [_buckets(hashes, 1)]
    if len(hashes) > 1:
        groups.append(_buckets(S.window_hashes(hashes, 2), 2))
    for n in (3, 5):
        if len(data) >= n:
            code = np.zeros(len(data) - n + 1, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | data[k : k + len(code)]
            groups.append(_buckets(code, n))
    return groups


def features(raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.float32)
    for group in feature_groups(raw, hashes):
        if len(group):
            total += np.bincount(group, minlength=BUCKETS).astype(np.float32) / len(group)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """Weights of the buckets, and the calibration of their sum."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def margin(self, groups: list[np.ndarray]) -> float:
        return float(sum(self.weights[g].mean() for g in groups if len(g)))

    def probability(self, groups: list[np.ndarray]) -> float:
        z = self.slope * self.margin(groups) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, int]]) -> Model:
    """Logistic regression by averaged-gradient steps, calibrated on rows it did not see.

    Rows are ``(doc_id, buckets, values, label)``; every fifth by hash of the id calibrates.
    With one label only, or none, the model accepts everything.
    """
    labels = {r[3] for r in rows}
    if len(labels) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 10.0)
    apart = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    train = [r for r, a in zip(rows, apart) if not a] or rows
    check = [r for r, a in zip(rows, apart) if a] or rows

    def matrix(part):
        sizes = np.array([len(r[1]) for r in part])
        cols = np.concatenate([r[1] for r in part])
        vals = np.concatenate([r[2] for r in part]).astype(np.float64)
        return np.repeat(np.arange(len(part)), sizes), cols, vals, np.array([r[3] for r in part])

    row, col, val, y = matrix(train)
    scale = np.sqrt(np.bincount(col, val * val, BUCKETS) / len(train)) + 1e-3
    scaled = val / scale[col]
    norm = np.sqrt(np.bincount(row, scaled * scaled, len(train)).mean())
    scaled /= norm
    weights, bias, mean, square = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), np.zeros(BUCKETS)
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for step in range(1, 81):
        z = np.bincount(row, scaled * weights[col], len(train)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * balance / len(train)
        gradient = np.bincount(col, scaled * error[row], BUCKETS) + 1e-4 * weights / len(train)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient * gradient
        ahead = mean / (1 - 0.9**step)
        weights -= 0.05 * ahead / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        bias -= 0.5 * error.sum()
    final = weights / scale / norm
    row, col, val, y = matrix(check)
    z = np.bincount(row, val * final[col], len(check))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, offset = 1.0, bias
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -50, 50)))
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(move[0], -1, 1), offset - np.clip(move[1], -1, 1)
    return Model(final.astype(np.float32), float(slope), float(offset))


EXAMPLE_DDL = "doc_id long, buckets binary, weights binary, label int"


def _examples(batches):
    for batch in batches:
        rows = []
        for doc_id, text, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = (text or "").encode()
            at, values = features(raw, S.hash_words(raw.split()))
            rows.append((doc_id, at.astype(np.uint32).tobytes(), values.tobytes(), label))
        if rows:
            yield S.record(rows, EXAMPLE_DDL)


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Fits on about ``most`` labelled documents at the utmost, whole texts.

    ``most`` is the documented bound: a hash of the id decides which labelled rows are taken.
    Only those few ids are broadcast to the scan and only their features reach the driver.
    """
    S.attach(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)"
    )
    share = min(1.0, most / max(1, usable.count()))
    taken = usable.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    found = S.texts(docs).join(F.broadcast(taken), "doc_id").select("doc_id", "text", "label")
    rows = [
        (
            r["doc_id"],
            np.frombuffer(r["buckets"], np.uint32).astype(np.int64),
            np.frombuffer(r["weights"], np.float32),
            r["label"],
        )
        for r in found.mapInArrow(_examples, EXAMPLE_DDL).toLocalIterator()
    ]
    return fit(sorted(rows, key=lambda r: r[0]))


RESULT_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, probability double"
)


def _judge(shipped, threshold: float):
    def run(batches):
        model = shipped.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                words = raw.split()
                hashes = S.hash_words(words)
                counts = base_counts(raw, words, hashes)
                failed = base_failed(len(words), counts[3])
                p = model.probability(feature_groups(raw, hashes))
                rows.append(
                    (doc_id, len(words), *counts, failed, not failed and p >= threshold, p)
                )
            yield S.record(rows, RESULT_DDL)

    return run


def judge(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept`` and ``probability``.

    Null text has no words and fails. Documents that fail the base are not kept, others are
    when their calibrated probability of good quality reaches the threshold. Without labels of
    both kinds every other document is kept. A null doc_id is judged like any other.
    """
    spark = docs.sparkSession
    S.attach(spark)
    shipped = spark.sparkContext.broadcast(model or learn(docs, labels))
    return S.texts(docs).mapInArrow(_judge(shipped, threshold), RESULT_DDL)
