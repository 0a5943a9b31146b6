"""How good ranked lists are: path matches, recall, reciprocal rank, hit rate, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(path: Column) -> Column:
    bare = F.regexp_replace(F.trim(path), "/+$", "")
    return F.regexp_replace(bare, r"^\./", "")


def path_matches(result: Column, expected: Column) -> Column:
    """Exact, one the end of the other, within an expected folder (ends with a slash), or beginning with a bare stem."""
    r, e = _plain(result), _plain(expected)
    folder = F.trim(expected).endswith("/") & F.concat(F.lit("/"), r, F.lit("/")).contains(F.concat(F.lit("/"), e, F.lit("/")))
    stem = ~e.contains(".") & ~e.contains("/") & F.substring_index(r, "/", -1).startswith(e)
    return (r == e) | r.endswith(F.concat(F.lit("/"), e)) | e.endswith(F.concat(F.lit("/"), r)) | folder | stem


def judged(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, reciprocal_rank``: ranked results (query_id, path, rank) against expected paths (query_id, expected).

    A query that expects nothing scores 1 if it has no results, else 0.
    """
    top = results.where(F.col("rank") <= k)
    wanted = expected.select("query_id", "expected").distinct()
    pairs = wanted.where("expected is not null").join(top, "query_id", "left").withColumn("hit", F.coalesce(path_matches(F.col("path"), F.col("expected")), F.lit(False)))
    per = pairs.groupBy("query_id", "expected").agg(F.max("hit").alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    scored = per.groupBy("query_id").agg(F.avg(F.col("found").cast("double")).alias("recall"), F.coalesce(1 / F.min("first"), F.lit(0.0)).alias("reciprocal_rank"))
    nothing = wanted.groupBy("query_id").agg(F.max("expected").alias("any")).where("any is null").select("query_id").join(top.select("query_id").distinct().withColumn("has", F.lit(True)), "query_id", "left")
    none = F.when(F.col("has").isNull(), 1.0).otherwise(0.0)
    return scored.unionByName(nothing.select("query_id", none.alias("recall"), none.alias("reciprocal_rank")))


def hit_rate(scores: DataFrame, least: float = 0.9) -> DataFrame:
    """``queries, hits, rate, passed``: the share of queries with any expected path found."""
    rate = F.avg((F.col("recall") > 0).cast("double"))
    return scores.agg(F.count("*").alias("queries"), F.count_if(F.col("recall") > 0).alias("hits"), F.round(rate, 6).alias("rate"), (rate >= least).alias("passed"))


def required_forbidden(hits: DataFrame, required: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``query_id, id, fault``: required hits that are missing and forbidden ones that are there."""
    missing = required.join(hits, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit("missing").alias("fault"))
    return missing.unionByName(forbidden.join(hits, ["query_id", "id"], "left_semi").select("query_id", "id", F.lit("forbidden").alias("fault")))


def compare_runs(a: DataFrame, b: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """``name, agrees``: measures (name, value, timed) of two runs: equal, or for times within the tolerance."""
    j = a.select("name", F.col("value").alias("x"), "timed").join(b.select("name", F.col("value").alias("y")), "name", "full")
    near = F.abs(F.col("x") - F.col("y")) <= tolerance * F.greatest(F.abs("x"), F.abs("y"))
    return j.select("name", F.coalesce(F.when(F.col("timed"), near).otherwise(F.col("x") == F.col("y")), F.lit(False)).alias("agrees"))
