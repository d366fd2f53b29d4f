"""Registered queries of the corpus operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .url_filter import oracle_sql

#: The registered queries' key; a deployment passes its own secret.
PII_KEY = b"registered-query-key"


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import TokenStore, read_back

    docs = table(spark, sf_dir, "documents")
    return read_back(docs, TokenStore.write(docs, public_tokenizers.path("word_bpe_49k.json")))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    return plan(table(spark, sf_dir, "documents")).per_document()


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op6_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_png import media_features, store_media

    rows = media_features(store_media(table(spark, sf_dir, "documents")))
    return rows.withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents"), PII_KEY)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return identify(docs, *learn(docs, ~held_out)).withColumn("held_out", held_out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.withColumns({"held_out": held_out, "predicted": (F.col("score") >= 0.5).cast("int")})


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filter": op2_url_filter,
    "op4_pii": op4_pii,
    "op6_media_png": op6_media_png,
    "op8_language_id": op8_language_id,
    "op5_toxicity": op5_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op7_fingerprints": op7_fingerprints,
    "op10_mixing": op10_mixing,
    "op3_token_store": op3_token_store,
}
ORACLE: dict[str, str] = {
    "op2_url_filter": oracle_sql(),
    "op9_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, shingle FROM (
                SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
        r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, x.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) x ON x.id = d.doc_id
    """,
}
