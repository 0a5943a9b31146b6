"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.core.storage import table
from quarrylight.llm import credentials, docpairs, handwritten, mixing, mojibake, neighbours, packing, splitting

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return credentials.find_credentials(table(spark, base, "files")).select("file_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, base: str) -> DataFrame:
    redacted = credentials.redact(table(spark, base, "files"))
    return redacted.select("file_id", F.length("redacted").alias("n_chars"), F.sha2("redacted", 256).alias("sha256"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, base, "files"), table(spark, base, "upstream_files"), full=True).select("file_id")


def p2_reasons(spark: SparkSession, base: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, base, "files"), table(spark, base, "upstream_files"), full=True)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, base, "chunk_embeddings")).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_recall(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.recall(table(spark, base, "chunk_embeddings"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return docpairs.code_description_pairs(table(spark, base, "symbols")).select("symbol_id")


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    return docpairs.code_description_pairs(table(spark, base, "symbols"))


def p4_functions(spark: SparkSession, base: str) -> DataFrame:
    return docpairs.extract_functions(table(spark, base, "files"), whole=True)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return splitting.faulty_pieces(table(spark, base, "chunks"), table(spark, base, "files")).select(F.col("piece_id").alias("chunk_id"))


def p5_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_files(table(spark, base, "files"))


def p6_packed(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack_documents(table(spark, base, "documents"))


def p7_mixed(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_documents(table(spark, base, "documents"), table(spark, base, "mix_targets"))


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    targets = table(spark, base, "mix_targets")
    return mixing.reached_shares(mixing.mix_documents(table(spark, base, "documents"), targets), targets)


def p7_shares_whole(spark: SparkSession, base: str) -> DataFrame:
    targets = table(spark, base, "mix_targets")
    return mixing.reached_shares(mixing.mix_documents(table(spark, base, "documents"), targets, whole=True), targets)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.repair_documents(table(spark, base, "documents")).where("garbled").select("doc_id").distinct()


def p8_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.repair_documents(table(spark, base, "documents")).where("garbled").select("doc_id", "restored").distinct()


def queries() -> dict[str, Query]:
    named = (p1_found, p1_redacted, p2_found, p2_reasons, p3_found, p3_recall, p4_found, p4_pairs, p4_functions, p5_found, p5_pieces, p6_packed, p7_mixed, p7_shares, p7_shares_whole, p8_found, p8_restored)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            WITH v AS (SELECT DISTINCT chunk_id, model, CAST(vector AS DOUBLE[64]) AS x FROM chunk_embeddings
                       WHERE vector IS NOT NULL AND len(vector) = 64 AND list_sum(list_transform(vector, lambda e: abs(e))) > 0),
            s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, array_cosine_similarity(a.x, b.x) AS sim
                  FROM v a JOIN v b ON a.model = b.model AND a.chunk_id <> b.chunk_id),
            r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rn FROM s)
            SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE rn <= 10 AND sim >= 0.9""",
        "p5_found": """
            WITH f AS (SELECT id, string_split(content_text, chr(10)) AS ls FROM files),
            c AS (SELECT id, file_id, start_line, end_line, content_text,
                         row_number() OVER w AS rn, lag(end_line) OVER w AS prev
                  FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY start_line NULLS LAST, id))
            SELECT c.id AS chunk_id FROM c LEFT JOIN f ON f.id = c.file_id
            WHERE coalesce(length(c.content_text) > 1500, false)
               OR c.content_text IS NULL OR c.start_line IS NULL OR c.end_line IS NULL OR f.ls IS NULL
               OR c.start_line < 1 OR c.end_line < c.start_line OR c.end_line > len(f.ls)
               OR array_to_string(f.ls[c.start_line:c.end_line], chr(10)) <> c.content_text
               OR (c.rn = 1 AND c.start_line <> 1) OR (c.rn > 1 AND c.start_line <> c.prev - 1)""",
    }
