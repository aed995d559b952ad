"""Language identification: a mixture of languages per document, fitted by EM over its words."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared as S

PER_LANGUAGE = 2000
BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
SMOOTH = 0.5
ROUNDS = 8
SHARE_COST = 2.0

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters in lower case."""
    return [w.encode() for w in LETTERS.findall(text.lower())] if text else []


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out_column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams of spaced words, and the word each belongs to."""
    line = b" " + b" ".join(words) + b" "
    raw = np.frombuffer(line, np.uint8).astype(np.uint64)
    place = np.cumsum(raw == 32) - 1
    cells, owner = [], []
    for n in GRAMS:
        code = np.zeros(len(raw) - n + 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + raw[k : k + len(code)] + np.uint64(1)
        own = place[: len(code)]
        whole = place[n - 1 :][: len(code)]
        # a gram may begin with the space before its word and end with the one after it
        inside = (whole == own) | ((whole == own + 1) & (raw[n - 1 :][: len(code)] == 32) & (n > 1))
        inside &= own < len(words)
        if n == 1:
            inside &= raw[: len(code)] != 32
        hashed = S.mix(code + np.uint64(n << 40)) >> np.uint64(48)
        cells.append(hashed[inside].astype(np.int64))
        owner.append(own[inside])
    return np.concatenate(cells), np.concatenate(owner)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if words:
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(grams(words)[0], minlength=BUCKETS)
    for lang, own in counts.items():
        rows = [(lang, int(i), int(own[i])) for i in np.flatnonzero(own)]
        for k in range(0, len(rows), 10_000):
            yield S.record(rows[k : k + 10_000], "lang string, bucket long, n long")


class Model:
    """Log probability of every n-gram bucket in every language."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p.astype(np.float32)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Counts n-grams of at most about ``per_language`` documents of each language, whole texts.

    ``per_language`` is the documented bound of the sample: a hash of the id decides, so the
    same rows are taken in any order. Rows that are held out, without language or id are left
    out. The model has one number per language and bucket.
    """
    S.attach(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out_column()
    )
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    taken = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    counted = (
        taken.select("text", "lang")
        .mapInArrow(_count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    languages = sorted({r["lang"] for r in counted})
    table = np.full((BUCKETS, len(languages)), SMOOTH)
    at = {lang: k for k, lang in enumerate(languages)}
    for r in counted:
        table[r["bucket"], at[r["lang"]]] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=0)) if languages else table)


class Scorer:
    """Word likelihoods, remembered, and the mixture of each document."""

    MOST = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.likelihood = np.empty((1 << 14, len(self.model.languages)), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        cells, owner = grams(words)
        log_p = np.zeros((len(words), len(self.model.languages)), np.float32)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        log_p = np.add.reduceat(self.model.log_p[cells[order]], starts, axis=0)
        log_p -= log_p.max(axis=1, keepdims=True)
        n = len(self.at)
        while n + len(words) > len(self.likelihood):
            self.likelihood = np.concatenate([self.likelihood, np.empty_like(self.likelihood)])
        self.likelihood[n : n + len(words)] = np.exp(np.maximum(log_p, -20))
        for k, word in enumerate(words):
            self.at[word] = n + k

    def rows(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new and len(self.at) + len(new) > self.MOST:
            self.clear()
            new = list(dict.fromkeys(words))
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def mixtures(self, documents: list[list[bytes]]) -> list[tuple[str, float, list[str]]]:
        """For documents that have words: most likely language, its share, the chosen set.

        EM fits each document's shares of all languages, however many there are. Taken in order of their shares, more
        languages explain the words better; the set with the best likelihood after a penalty
        for each language is chosen, and shares are those within the set.
        """
        counts = np.array([len(d) for d in documents])
        starts = np.cumsum(counts) - counts
        rows = self.rows([w for d in documents for w in d])
        like = self.likelihood[rows]
        doc = np.repeat(np.arange(len(documents)), counts)
        share = np.full((len(documents), like.shape[1]), 1 / like.shape[1], np.float32)
        for _ in range(ROUNDS):
            part = like * share[doc]
            part /= part.sum(axis=1, keepdims=True)
            share = np.add.reduceat(part, starts, axis=0) / counts[:, None]
        order = np.argsort(-share, axis=1, kind="stable")
        best = np.full(len(documents), -np.inf)
        chosen = np.ones(len(documents), np.int64)
        cost = SHARE_COST + 0.5 * np.log(counts)
        keep = np.zeros_like(share)
        for k in range(like.shape[1]):
            np.put_along_axis(
                keep, order[:, k : k + 1], np.take_along_axis(share, order[:, k : k + 1], 1), 1
            )
            own = keep / keep.sum(axis=1, keepdims=True)
            fit = np.log(np.einsum("ij,ij->i", like, own[doc]) + 1e-30)
            value = np.add.reduceat(fit, starts) - (k + 1) * cost
            better = value > best
            best[better], chosen[better] = value[better], k + 1
        out = []
        for i, k in enumerate(chosen.tolist()):
            own = share[i, order[i, :k]]
            names = [self.model.languages[j] for j in order[i, :k]]
            out.append((names[0], float(min(1.0, own[0] / own.sum())), names))
        return out


RESULT_DDL = "lang_pred string, score double, languages string"


def _predict(shipped, keep_rows: bool):
    """Over batches whose last column is the text."""

    def run(batches):
        scorer = Scorer(shipped.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if keep_rows:
                if scorer.model.languages:
                    mask = [f[0] != "und" for f in predict_texts(scorer, texts)]
                else:
                    mask = [bool(words_of(t)) for t in texts]
                rows = batch.select(range(batch.num_columns - 1))
                yield rows.filter(S.pa.array(mask, S.pa.bool_()))
            else:
                got = S.record(predict_texts(scorer, texts), RESULT_DDL)
                yield S.pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), *got.columns],
                    names=["doc_id", "held_out", *got.schema.names],
                )

    return S.settled(run)


def predict_texts(scorer: Scorer, texts: list[str | None]) -> list[tuple[str, float, str]]:
    """Language, score and chosen set per text; ``und`` and 0 without a letter or a model."""
    documents = [words_of(t) for t in texts]
    out: list = [("und", 0.0, "")] * len(texts)
    at, held = [], 0
    todo: list[list[int]] = []
    for i, words in enumerate(documents):
        if words and scorer.model.languages:
            at.append(i)
            held += len(words)
            if held > 200_000:
                todo.append(at)
                at, held = [], 0
    for group in [*todo, *([at] if at else [])]:
        for i, (name, score, names) in zip(group, scorer.mixtures([documents[j] for j in group])):
            out[i] = (name, score, ",".join(names))
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, languages``.

    Predictions use the text alone. Null text and text without a letter are ``und`` with score
    0, as is everything when there was nothing to learn from. A null doc_id is not held out.
    ``languages`` is the chosen set, largest share first.
    """
    spark = docs.sparkSession
    S.attach(spark)
    shipped = spark.sparkContext.broadcast(model or learn(docs))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        held_out_column().alias("held_out"),
        F.col("text").cast("string").alias("_text"),
    )
    return rows.mapInArrow(
        _predict(shipped, False), "doc_id long, held_out boolean, " + RESULT_DDL
    )


def drop_unknown(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs``, all columns, without rows whose language cannot be told (``und``).

    That is a verdict on the text: one without a letter has no likelihood under any language.
    Where nothing could be learned, texts with letters stay all the same.
    """
    spark = docs.sparkSession
    S.attach(spark)
    shipped = spark.sparkContext.broadcast(model or learn(docs))
    rows = docs.select("*", F.col("text").cast("string").alias(S.fresh(docs, "text")[0]))
    return rows.mapInArrow(_predict(shipped, True), docs.schema)
