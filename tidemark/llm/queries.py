"""The registered queries of this subpackage: name -> (query, SQL check or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    exact,
    extraction,
    jaccard,
    language,
    lines,
    manifest,
    materialise,
    packing,
    pieces,
    quality,
    runs,
    substrings,
    wordpiece,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written shards hold, read back from them."""
    folder, _ = materialise.materialise(table(spark, sf_dir, "documents"))
    return materialise.read_shards(spark, folder, with_ids=False)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, s, list_slice(w, s, s + 12) AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words)),
firsts AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i
  FROM windows JOIN firsts USING (x) WHERE first < doc_id),
single AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, s, s + 4) AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM words
        WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * common.n >= 80 * (s.n + t.n - common.n)),
reach AS (
  SELECT a, b FROM links
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT words.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles,
       least(words.doc_id, coalesce(min(reach.b), words.doc_id))::BIGINT AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = words.doc_id
GROUP BY words.doc_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP11_SQL = """
WITH lines AS (
  SELECT row, doc_id, i, l[i] AS line, translate(
      trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT row_number() OVER () AS row, doc_id,
                     string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
repeated AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT row, doc_id, i, line, first IS NOT NULL AND first <> doc_id AS gone
  FROM lines LEFT JOIN repeated USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by a checksum of its id, is proven with its text lower-cased."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = manifest.manifest(table(spark, sf_dir, "documents"), altered)
    rows = rows.withColumn("folded_root", manifest.folded(F.coalesce("other", "leaf")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(manifest.proof_text(), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def merkle_sql(depth: int = 8) -> str:
    """Trees of up to 16^depth leaves, level by level; a path is a list of siblings."""

    def tree(name: str, start: str) -> tuple[str, str, str]:
        steps = [f"{name}_0 AS MATERIALIZED ({start})"]
        for k in range(1, depth + 1):
            steps.append(
                f"{name}_{k} AS MATERIALIZED (SELECT tree, i // 16 AS i, any_value(n) AS n, "
                f"string_agg(d, '' ORDER BY i) AS run, sha256(string_agg(d, '' ORDER BY i)) AS d "
                f"FROM {name}_{k - 1} WHERE n > power(16, {k - 1}) GROUP BY tree, i // 16)"
            )
        ends = " UNION ALL ".join(
            f"SELECT tree, d FROM {name}_{k} WHERE n <= power(16, {k})" for k in range(depth + 1)
        )
        joins, beside = "", []
        for k in range(1, depth + 1):
            joins += (
                f" LEFT JOIN {name}_{k} p{k} ON p{k}.tree = x.tree"
                f" AND p{k}.i = x.i // power(16, {k})::BIGINT"
            )
            at = f"(x.i // power(16, {k - 1})::BIGINT) % 16"
            beside.append(
                f"CASE WHEN p{k}.run IS NULL THEN [] ELSE [{{'a': p{k}.run[1:64 * ({at})], "
                f"'b': p{k}.run[64 * ({at}) + 65:]}}] END"
            )
        return ", ".join(steps), ends, f"{' || '.join(beside)} AS path FROM {name}_0 x{joins}"

    def leaf(text: str) -> str:
        parts = [
            f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)
        ]
        return f"sha256({' || '.join(parts)})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform("
        "string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: "
        "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: "
        "xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
    )
    steps, ends, paths = tree(
        "s",
        "SELECT coalesce('+' || source, '') AS tree, doc_id, leaf AS d, other, "
        "row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves "
        "WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)",
    )
    top, top_ends, top_paths = tree(
        "t",
        "SELECT 0 AS tree, tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS i, "
        "count(*) OVER () AS n FROM subroots",
    )
    return f"""
WITH leaves AS MATERIALIZED (
  SELECT source, doc_id, {leaf("text")} AS leaf,
         CASE WHEN {crc} % 5 = 0 AND text IS NOT NULL THEN {leaf(low)} END AS other
  FROM documents),
{steps},
subroots AS MATERIALIZED ({ends}),
{top},
top AS (SELECT d AS root FROM ({top_ends})),
top_paths AS MATERIALIZED (SELECT x.name, x.d AS subroot, {top_paths}),
paths AS MATERIALIZED (SELECT x.tree AS name, x.doc_id, x.d AS leaf, x.other, {paths}),
whole AS (
  SELECT p.doc_id, p.leaf, p.other, t.subroot, top.root, p.path || t.path AS path
  FROM paths p JOIN top_paths t USING (name), top),
folds AS (
  SELECT *, list_reduce(list_prepend({{'a': '', 'b': coalesce(other, leaf)}}, path),
    lambda d, s: {{'a': '', 'b': sha256(s.a || d.b || s.b)}}).b AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root,
       sha256(list_aggregate(list_transform(path, lambda s: s.a || s.b) || [''], 'string_agg', ''))
         AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folds
"""


OP12_SQL = merkle_sql()


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a checksum of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the planted documents and the digests of what they leave."""
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    order = lambda r: F.struct(-r["length"], r["start"], r["period"])
    best = F.array_min(F.transform("runs", order))
    listed = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    found = found.withColumn("best", best)
    length, period = -F.col("best.col1"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


CATALOG = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_html_extraction": (op2_html_extraction, None),
    "op3_quality_rules": (op3_quality_rules, None),
    "op4_token_output": (op4_token_output, None),
    "op5_substring_dedup": (op5_substring_dedup, OP5_SQL),
    "op6_sentencepiece": (op6_sentencepiece, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_ngram_jaccard": (op8_ngram_jaccard, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_exact_dedup": (op10_exact_dedup, OP10_SQL),
    "op11_line_dedup": (op11_line_dedup, OP11_SQL),
    "op12_merkle_manifest": (op12_merkle_manifest, OP12_SQL),
    "op13_periodic_runs": (op13_periodic_runs, None),
    "pipeline": (pipeline, corpus_pipeline.ORACLE_SQL),
}
