"""Line dedup with DataFrame functions only: lines are hashed and counted over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower
from tidemark.session import written

# Fixed value: the characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2

#: Keys with more than 1/HOT of all repeated lines are salted: at most HOT of them exist.
HOT = 100_000
#: Lines that one salt of a key holds at least.
SALT_LINES = 2_000


def line_key(line):
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _two_hashes(*columns):
    """128 bits as two numbers; xxhash64 folds from left to right, so the first value is a seed."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    exploded = rows.select("r1", "r2", "doc_id", F.posexplode("lines").alias("place", "line"))
    keyed = exploded.select("r1", "r2", "doc_id", "place", line_key(F.col("line")).alias("key"))
    h1, h2 = _two_hashes("key")
    keyed = keyed.where(F.char_length("key") >= min_chars)
    return keyed.select("r1", "r2", "doc_id", "place", h1.alias("h1"), h2.alias("h2"))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_text``.

    A key of at least ``min_chars`` code points that ``min_docs`` or more documents hold loses
    its lines everywhere but in the smallest doc_id that holds it, where all of them stay.
    Null and empty texts are one empty line. Rows that repeat a doc_id are one document to the
    count, and each is returned with its own text. Rows without doc_id are one document that
    comes after all others, so they lose lines to any document with an id and to no other.

    Keys are 128-bit hashes. Counting distinct documents folds before each shuffle. Lines then
    meet the repeated keys on the hash and a salt: the keys that need more than one salt hold
    over 1/``HOT`` of the repeated lines each, so there are fewer than ``HOT`` of them to
    broadcast. Rows are found again by a hash of id and text, which is the same in every run.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    r1, r2 = _two_hashes(F.col("doc_id").isNull(), "doc_id", "text")
    rows = rows.select(
        "doc_id", F.split("text", "\n", -1).alias("lines"), r1.alias("r1"), r2.alias("r2")
    )
    lines = _lines(rows, min_chars)
    holders = lines.groupBy("h1", "h2").agg(
        F.count_distinct(F.struct("doc_id")).alias("n_docs"),
        F.min("doc_id").alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    repeated = holders.where(F.col("n_docs") >= min_docs).select("h1", "h2", "first", "n")
    repeated = written(repeated, "repeated-lines")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    each = max(SALT_LINES, -(-total // HOT))
    salts = F.ceil(F.col("n") / each).cast("long")
    hot = repeated.where(F.col("n") > each).select("h1", "h2", salts.alias("salts"))
    salted = repeated.select(
        "h1", "h2", "first", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")
    )
    spread = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn(
        "salt", F.coalesce(F.pmod("r1", "salts"), F.lit(0).cast("long"))
    )
    gone = (
        spread.join(salted, ["h1", "h2", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("r1", "r2")
        .agg(F.collect_set("place").alias("gone"))
    )
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda i: F.get("lines", i))
    )
    return rows.join(gone, ["r1", "r2"], "left").select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.concat_ws("\n", kept).alias("kept_text"),
    )
