"""The queries of this subpackage, their SQL where SQL can express them, and the rows they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.workspace import new_folder, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.license_scan import with_licenses

    found = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"__pl_licenses.{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "usable")])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.line_dedup import grouped_lines

    return grouped_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), max_bits=None).drop("text_hash")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.warc import page_id, read_archive, write_archive

    path = new_folder(spark, "archive")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = read_archive(spark, path, payload=False, verify=True).where(F.col("warc_type").isin("response", "revisit"))
    digest = F.regexp_extract("payload_digest", "^sha1:(.*)$", 1).alias("payload_digest")
    return found.select(page_id(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest, F.col("warc_type").alias("record_type"), page_id(F.col("refers_to")).alias("refers_to"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with merge-dropout and the text that they decode to, as digests: lossless is true for every row."""
    from paperloom.llm.pieces import with_text, with_tokens

    found = with_text(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("token_hash"), F.octet_length("decoded").cast("long").alias("n_bytes"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.exact_dedup import group_duplicates

    return group_duplicates(table(spark, sf_dir, "documents"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.toxicity import train, with_score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    scored = with_score(docs, train(docs, labels), name="score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.sharding import shard

    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.mixing import mix

    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("__pl_copies") * F.col("__pl_size")).alias("taken")
    return found.select("doc_id", F.col("__pl_size").alias("size"), F.col("__pl_total").alias("source_size"), F.col("__pl_target").alias("target"), taken)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}

    def run(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return query

    return {k: run(f) for k, f in found.items()}


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach GROUP BY vec_id
"""


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS hexed FROM pages),
digits AS (
  SELECT page_id, body, list_transform(range(0, 32), lambda i: ((
    16 * (strpos('0123456789ABCDEF', substr(hexed || '0', 1 + (5 * i) // 4, 1)) - 1) + strpos('0123456789ABCDEF', substr(hexed || '0', 2 + (5 * i) // 4, 1)) - 1
  ) >> (3 - (5 * i) % 4)) & 31) AS d FROM p),
kept AS (
  SELECT page_id, strlen(body) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS best,
         list_reduce(list_transform(d, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), lambda a, b: a || b) AS payload_digest FROM digits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op5_warc": OP5_SQL, "op7_exact_dedup": OP7_SQL}
