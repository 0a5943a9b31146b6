"""Evaluation of retrieval on the corpus: a chunk should find the file it is from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import evaluate
from quarrylight.plans import searching
from quarrylight.plans.registry import Plans

P = Plans()
JUDGED_SQL = f"""WITH {searching.TERMS_SQL}, res AS (SELECT query_id, f.path, rank FROM lex JOIN chunks c ON c.id = lex.id JOIN files f ON f.id = c.file_id WHERE rank <= 10), ex AS (SELECT c.id AS query_id, f.path AS expected FROM chunks c JOIN files f ON f.id = c.file_id WHERE c.id % 100 = 0),
    pr AS (SELECT ex.query_id, expected, bool_or(coalesce(res.path = expected OR ends_with(res.path, '/' || expected) OR ends_with(expected, '/' || res.path) OR (NOT contains(expected, '.') AND NOT contains(expected, '/') AND starts_with(split_part(res.path, '/', -1), expected)), false)) AS found,
        min(CASE WHEN res.path = expected OR ends_with(res.path, '/' || expected) OR ends_with(expected, '/' || res.path) OR (NOT contains(expected, '.') AND NOT contains(expected, '/') AND starts_with(split_part(res.path, '/', -1), expected)) THEN rank END) AS first FROM ex LEFT JOIN res ON res.query_id = ex.query_id GROUP BY ALL),
    j AS (SELECT query_id, avg(CAST(found AS INT)) AS recall, coalesce(1.0::DOUBLE / min(first), 0) AS reciprocal_rank FROM pr GROUP BY 1)"""


def _results(t):
    hits = searching._lexical(t, 10).select("query_id", "id", "rank")
    return hits.join(t.chunks.select("id", "file_id"), "id").join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("query_id", "path", "rank")


def _judged(t):
    expected = t.chunks.where("id % 100 = 0").select(F.col("id").alias("query_id"), "file_id").join(t.files.select(F.col("id").alias("file_id"), F.col("path").alias("expected")), "file_id").select("query_id", "expected")
    return evaluate.judged(_results(t), expected, 10)


@P.add("ev_path_match", "SELECT f.id FROM files f WHERE regexp_matches('/' || path || '/', '/outbox/') OR starts_with(split_part(path, '/', -1), 'outbox')")
def _(t):
    return t.files.where(evaluate.path_matches(F.col("path"), F.lit("outbox/"))).select("id")


@P.add("ev_recall_at_k", f"{JUDGED_SQL} SELECT query_id, round(recall, 6) AS recall FROM j")
def _(t):
    return _judged(t).select("query_id", F.round("recall", 6).alias("recall"))


@P.add("ev_rr", f"{JUDGED_SQL} SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM j")
def _(t):
    return _judged(t).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@P.add("ev_mrr", f"{JUDGED_SQL} SELECT round(avg(reciprocal_rank), 6) AS mrr, count(*) AS queries FROM j")
def _(t):
    return _judged(t).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count("*").alias("queries"))


@P.add("ev_hit_rate", f"{JUDGED_SQL} SELECT count(*) AS queries, count(*) FILTER (WHERE recall > 0) AS hits, round(avg(CAST(recall > 0 AS INT)), 6) AS rate, avg(CAST(recall > 0 AS INT)) >= 0.9 AS passed FROM j")
def _(t):
    return evaluate.hit_rate(_judged(t))


@P.add("ev_required_forbidden", f"""WITH {searching.TERMS_SQL} SELECT a.query_id, a.query_id AS id, 'missing' AS fault FROM (SELECT DISTINCT query_id FROM asked) a WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.query_id = a.query_id AND lex.id = a.query_id AND rank <= 10)
    UNION ALL SELECT DISTINCT a.query_id, c.id, 'forbidden' FROM asked a JOIN chunks q ON q.id = a.query_id JOIN chunks c ON c.file_id = q.file_id AND c.id <> q.id JOIN lex ON lex.query_id = a.query_id AND lex.id = c.id AND rank <= 10""")
def _(t):
    """Every chunk asked for by its own words must be among its ten best, and no other chunk of its file."""
    hits = searching._lexical(t, 10).select("query_id", "id")
    asked = searching._asked(t).where(F.size("terms") > 0).select("query_id", F.col("query_id").alias("id"))
    other = t.chunks.select("id", "file_id")
    forbidden = asked.select("query_id").join(other.select(F.col("id").alias("query_id"), "file_id"), "query_id").join(other, "file_id").where("id <> query_id").select("query_id", "id")
    return evaluate.required_forbidden(hits, asked, forbidden)


@P.add("ev_manifest_compare", "SELECT coalesce(language, 'none') AS name, coalesce(language, 'none') <> 'go' AS agrees FROM files GROUP BY 1")
def _(t):
    a = t.files.groupBy(F.coalesce("language", F.lit("none")).alias("name")).agg(F.count("*").cast("double").alias("value")).withColumn("timed", F.lit(False))
    return evaluate.compare_runs(a, a.withColumn("value", F.col("value") + F.when(F.col("name") == "go", 1).otherwise(0)))


@P.add("ev_label_quality", "SELECT label, count(*) AS n, round(avg(len(embedding)), 6) AS mean_size FROM embeddings GROUP BY 1")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size("embedding")), 6).alias("mean_size"))
