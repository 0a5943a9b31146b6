"""Filters, joins, aggregates, windows, sorting and set operations over the corpus's own tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.core import parts
from quarrylight.operators import access
from quarrylight.plans.registry import Plans

P = Plans()
TENANT = "(SELECT min(user_id) FROM sources)"
GRANTS = [("u1", 1, None, True), ("u1", 2, "2020-01-01", True), ("u2", 3, None, True), ("u2", 4, None, False), ("u1", 5, "2099-01-01", True)]
ROLE_GRANTS = [("reader", 6, None, True), ("reader", 1, None, True), ("writer", 7, "2021-01-01", True), ("writer", 8, None, True)]
ROLES = [("u1", "reader"), ("u2", "writer"), ("u3", "reader")]


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def _grants(t):
    g = t.spark.createDataFrame(GRANTS, "user_id string, source_id long, until string, can_read boolean").withColumn("expires", F.to_timestamp("until"))
    r = t.spark.createDataFrame(ROLE_GRANTS, "role string, source_id long, until string, can_read boolean").withColumn("expires", F.to_timestamp("until"))
    return access.accessible(t.sources, g, r, t.spark.createDataFrame(ROLES, "user_id string, role string"), F.lit("2025-01-01").cast("timestamp"))


GRANTED_SQL = f"""(SELECT DISTINCT user_id, source_id FROM (SELECT user_id, source_id, until, ok FROM {_values(GRANTS)} AS g(user_id, source_id, until, ok) UNION ALL
    SELECT user_id, source_id, until, ok FROM {_values(ROLE_GRANTS)} AS g(role, source_id, until, ok) JOIN {_values(ROLES)} AS r(user_id, role) USING (role))
    WHERE ok AND (until IS NULL OR CAST(until AS TIMESTAMP) > TIMESTAMP '2025-01-01') AND source_id IN (SELECT id FROM sources))"""


@P.add("flt_tenant", f"SELECT f.id FROM files f JOIN sources s ON s.id = f.source_id WHERE s.user_id = {TENANT}")
def _(t):
    user = t.sources.agg(F.min("user_id").alias("u")).first()["u"]
    return access.of_tenant(t.files, t.sources, user).select("id")


@P.add("flt_source", "SELECT id, path FROM files WHERE source_id = 5")
def _(t):
    return t.files.where("source_id = 5").select("id", "path")


@P.add("flt_acl", f"SELECT user_id, source_id FROM {GRANTED_SQL}")
def _(t):
    return _grants(t)


@P.add("flt_rls_row_policies", f"SELECT c.id FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.source_id IN (SELECT source_id FROM {GRANTED_SQL} WHERE user_id = 'u1')")
def _(t):
    rows = t.chunks.select("id", "file_id").join(t.files.select(F.col("id").alias("file_id"), "source_id"), "file_id")
    return access.secured(rows, _grants(t), "u1").select("id")


@P.add("flt_optional_param", "SELECT DISTINCT id FROM symbols WHERE type = 'method'")
def _(t):
    wanted = {"type": "method", "language": None}
    rows = t.symbols
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.select("id").distinct()


@P.add("flt_any_array", "SELECT id FROM files WHERE language IN ('go', 'rust', 'lua')")
def _(t):
    return t.files.where(F.col("language").isin("go", "rust", "lua")).select("id")


@P.add("flt_array_contains", "SELECT id FROM files WHERE list_contains(string_split(path, '/'), 'outbox') AND list_has_all(string_split(path, '/'), ['lib', 'outbox'])")
def _(t):
    parts = F.split("path", "/")
    return t.files.where(F.array_contains(parts, "outbox") & (F.size(F.array_except(F.array(F.lit("lib"), F.lit("outbox")), parts)) == 0)).select("id")


@P.add("flt_jsonb_contains", "SELECT id FROM sources WHERE json_extract(config, '$.is_test') = 'true'")
def _(t):
    return t.sources.where(F.get_json_object("config", "$.is_test") == "true").select("id")


@P.add("flt_jsonb_path", "SELECT id, json_extract_string(metadata, '$.lang') AS lang, CAST(json_extract_string(metadata, '$.n') AS BIGINT) AS n FROM chunks WHERE json_extract(metadata, '$.lang') IS NOT NULL")
def _(t):
    v = F.try_parse_json("metadata")
    return t.chunks.select("id", F.try_variant_get(v, "$.lang", "string").alias("lang"), F.try_variant_get(v, "$.n", "bigint").alias("n")).where("lang is not null")


@P.add("flt_path_prefix", "SELECT id FROM files WHERE starts_with(path, 'src/')")
def _(t):
    return t.files.where(F.col("path").startswith("src/")).select("id")


@P.add("flt_time", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def _(t):
    return t.events.where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-10'").select("event_id")


@P.add("flt_score_floor", "SELECT event_id, value / 1000 AS score FROM events WHERE value / 1000 >= 0.005")
def _(t):
    return t.events.select("event_id", (F.col("value") / 1000).alias("score")).where("score >= 0.005")


@P.add("flt_exists", "SELECT id FROM files f WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = f.id AND c.level = 1)")
def _(t):
    return t.files.select("id").join(t.chunks.where("level = 1").select(F.col("file_id").alias("id")), "id", "left_semi")


@P.add("flt_not_exists", "SELECT id FROM files f WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = f.id)")
def _(t):
    return t.files.select("id").join(t.chunks.select(F.col("file_id").alias("id")), "id", "left_anti")


@P.add("flt_not_in", "SELECT id FROM files WHERE source_id NOT IN (SELECT id FROM sources WHERE type = 'git') AND source_id IS NOT NULL")
def _(t):
    return t.files.where("source_id is not null").select("id", "source_id").join(t.sources.where("type = 'git'").select(F.col("id").alias("source_id")), "source_id", "left_anti").select("id")


@P.add("flt_all", "SELECT id FROM files WHERE language <> ALL (['go', 'rust'])")
def _(t):
    return t.files.where(~F.col("language").isin("go", "rust")).select("id")


@P.add("flt_test_scope", "SELECT f.id FROM files f JOIN sources s ON s.id = f.source_id WHERE coalesce(json_extract_string(s.config, '$.is_test'), 'false') <> 'true'")
def _(t):
    real = t.sources.where(F.coalesce(F.get_json_object("config", "$.is_test"), F.lit("false")) != "true").select(F.col("id").alias("source_id"))
    return t.files.join(real, "source_id", "left_semi").select("id")


@P.add("flt_noise_names", "SELECT DISTINCT callee_name FROM call_graph WHERE callee_name NOT IN ('trace', 'assert', 'equals', 'toString', 'exec', 'deprecated')")
def _(t):
    return t.call_graph.where(~F.col("callee_name").isin("trace", "assert", "equals", "toString", "exec", "deprecated")).select("callee_name").distinct()


@P.add("prj_basic", "SELECT id, coalesce(language, 'unknown') AS language, CASE WHEN size_original > 2000 THEN 'large' ELSE 'small' END AS class, CAST(size_original AS BIGINT) AS bytes FROM files")
def _(t):
    return t.files.select("id", F.coalesce("language", F.lit("unknown")).alias("language"), F.when(F.col("size_original") > 2000, "large").otherwise("small").alias("class"), F.col("size_original").cast("long").alias("bytes"))


# --- joins ------------------------------------------------------------------------------------------------------------


@P.add("join_inner_equi", "SELECT c.id, f.path, s.name FROM chunks c JOIN files f ON f.id = c.file_id JOIN sources s ON s.id = f.source_id")
def _(t):
    return t.chunks.select("id", "file_id").join(t.files.select(F.col("id").alias("file_id"), "path", "source_id"), "file_id").join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id").select("id", "path", "name")


@P.add("join_left_outer", "SELECT c.id, e.model FROM chunks c LEFT JOIN chunk_embeddings e ON e.chunk_id = c.id")
def _(t):
    return t.chunks.select("id").join(t.chunk_embeddings.select(F.col("chunk_id").alias("id"), "model"), "id", "left")


@P.add("join_full_outer", """
    WITH a AS (SELECT source AS name, count(*) AS docs FROM documents GROUP BY 1), b AS (SELECT s.name, count(*) AS files FROM files f JOIN sources s ON s.id = f.source_id GROUP BY 1)
    SELECT coalesce(a.name, b.name) AS name, coalesce(docs, 0) AS docs, coalesce(files, 0) AS files FROM a FULL JOIN b ON a.name = b.name""")
def _(t):
    a = t.documents.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("docs"))
    b = t.files.join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy("name").agg(F.count("*").alias("files"))
    zero = F.lit(0).cast("long")
    return a.join(b, "name", "full").select("name", F.coalesce("docs", zero).alias("docs"), F.coalesce("files", zero).alias("files"))


@P.add("join_cross", "SELECT o.o_orderkey, o.o_totalprice > s.m AS above FROM orders o CROSS JOIN (SELECT avg(o_totalprice) AS m FROM orders) s")
def _(t):
    return t.orders.crossJoin(F.broadcast(t.orders.agg(F.avg("o_totalprice").alias("m")))).select("o_orderkey", (F.col("o_totalprice") > F.col("m")).alias("above"))


@P.add("join_theta_containment", "SELECT DISTINCT c.id AS chunk_id, s.id AS symbol_id FROM chunks c JOIN symbols s ON s.file_id = c.file_id AND s.line_start <= c.start_line AND c.start_line <= s.line_end")
def _(t):
    s = t.symbols.select(F.col("id").alias("symbol_id"), "file_id", "line_start", "line_end").distinct()
    return t.chunks.select(F.col("id").alias("chunk_id"), "file_id", "start_line").join(s, "file_id").where("line_start <= start_line and start_line <= line_end").select("chunk_id", "symbol_id").distinct()


@P.add("join_smallest_cover", """
    WITH s AS (SELECT DISTINCT id, file_id, line_start FROM symbols),
    r AS (SELECT s.id AS symbol_id, c.id AS chunk_id, row_number() OVER (PARTITION BY s.id ORDER BY c.end_line - c.start_line, c.id) AS rn FROM s JOIN chunks c ON c.file_id = s.file_id AND c.start_line <= s.line_start AND s.line_start <= c.end_line)
    SELECT symbol_id, chunk_id FROM r WHERE rn = 1""")
def _(t):
    s = t.symbols.select(F.col("id").alias("symbol_id"), "file_id", "line_start").distinct()
    cover = s.join(t.chunks.select(F.col("id").alias("chunk_id"), "file_id", "start_line", "end_line"), "file_id").where("start_line <= line_start and line_start <= end_line")
    return cover.groupBy("symbol_id").agg(F.min_by("chunk_id", F.struct(F.col("end_line") - F.col("start_line"), "chunk_id")).alias("chunk_id"))


@P.add("join_lateral_left", "SELECT f.id, n.n FROM files f LEFT JOIN LATERAL (SELECT count(*) AS n FROM chunks c WHERE c.file_id = f.id) n ON true")
def _(t):
    n = t.chunks.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    return t.files.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@P.add("join_lateral_unnest", "SELECT id, unnest(string_split(path, '/')) AS part FROM files")
def _(t):
    return t.files.select("id", F.explode(F.split("path", "/")).alias("part"))


@P.add("join_unnest_zip", "SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode(F.arrays_zip("embedding")).alias("p", "z")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.col("z.embedding").alias("x"))


@P.add("join_self_parent", "SELECT a.id, a.start_line AS start_line, b.start_line AS parent_line FROM chunks a JOIN chunks b ON a.parent_chunk_id = b.id")
def _(t):
    b = t.chunks.select(F.col("id").alias("parent_chunk_id"), F.col("start_line").alias("parent_line"))
    return t.chunks.select("id", "start_line", "parent_chunk_id").join(b, "parent_chunk_id").select("id", "start_line", "parent_line")


@P.add("join_or_null_safe", """
    WITH a AS (SELECT language, count(*) AS files FROM files GROUP BY 1), b AS (SELECT language, count(*) AS symbols FROM (SELECT DISTINCT id, language FROM symbols) GROUP BY 1)
    SELECT a.language, files, symbols FROM a JOIN b ON a.language IS NOT DISTINCT FROM b.language""")
def _(t):
    a = t.files.groupBy("language").agg(F.count("*").alias("files"))
    b = t.symbols.select("id", "language").distinct().groupBy(F.col("language").alias("other")).agg(F.count("*").alias("symbols"))
    return a.join(b, F.col("language").eqNullSafe(F.col("other"))).select("language", "files", "symbols")


@P.add("join_row_compare", "SELECT a.id, b.id AS later FROM files a JOIN files b ON a.source_id = b.source_id AND a.path = b.path AND a.id < b.id WHERE (a.language, a.size_original, a.created_at) IS DISTINCT FROM (b.language, b.size_original, b.created_at)")
def _(t):
    b = t.files.select("source_id", "path", F.col("id").alias("b_id"), F.struct("language", "size_original", "created_at").alias("b_row"))
    a = t.files.select("source_id", "path", "id", F.struct("language", "size_original", "created_at").alias("row"))
    return a.join(b, ["source_id", "path"]).where("id < b_id").where(~F.col("row").eqNullSafe(F.col("b_row"))).select("id", F.col("b_id").alias("later"))


@P.add("join_range_interval", "SELECT e.event_id, w.w FROM events e JOIN (VALUES (1, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08'), (2, TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-20')) AS w(w, a, b) ON e.ts >= w.a AND e.ts < w.b")
def _(t):
    w = t.spark.sql("select * from values (1, timestamp_ntz '2024-01-01', timestamp_ntz '2024-01-08'), (2, timestamp_ntz '2024-01-08', timestamp_ntz '2024-01-20') as w(w, a, b)")
    return t.events.join(F.broadcast(w), (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b"))).select("event_id", "w")


# --- aggregates -------------------------------------------------------------------------------------------------------


@P.add("agg_basic", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@P.add("agg_count_distinct", "SELECT callee_name, count(DISTINCT caller_symbol_id) AS callers FROM call_graph GROUP BY 1")
def _(t):
    # Two steps with partial aggregation each, so that a name called everywhere doesn't meet in one task.
    return t.call_graph.select("callee_name", "caller_symbol_id").distinct().groupBy("callee_name").agg(F.count("caller_symbol_id").alias("callers"))


@P.add("agg_filter", "SELECT count(*) FILTER (WHERE callee_symbol_id IS NULL) AS open, count(*) FILTER (WHERE is_external) AS external, count(*) AS calls FROM call_graph")
def _(t):
    return t.call_graph.agg(F.count_if(F.col("callee_symbol_id").isNull()).alias("open"), F.count_if("is_external").alias("external"), F.count("*").alias("calls"))


@P.add("agg_max_merge", "SELECT user_id, max(s) AS best FROM (SELECT user_id, value AS s FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 0.8 * value FROM events WHERE event_type = 'view') GROUP BY 1")
def _(t):
    a = t.events.where("event_type = 'click'").select("user_id", F.col("value").alias("s"))
    b = t.events.where("event_type = 'view'").select("user_id", (F.col("value") * 0.8).alias("s"))
    return a.unionByName(b).groupBy("user_id").agg(F.max("s").alias("best"))


@P.add("agg_bool", "SELECT file_id, bool_and(coalesce(chunk_type, '') = 'function') AS all_functions, bool_or(level = 1) AS any_inner FROM chunks GROUP BY 1")
def _(t):
    return t.chunks.groupBy("file_id").agg(F.bool_and(F.coalesce("chunk_type", F.lit("")) == "function").alias("all_functions"), F.bool_or(F.col("level") == 1).alias("any_inner"))


@P.add("agg_array", "SELECT file_id, list_sort(list(DISTINCT type)) AS types FROM symbols GROUP BY 1")
def _(t):
    return t.symbols.groupBy("file_id").agg(F.array_sort(F.collect_set("type")).alias("types"))


@P.add("agg_string", "SELECT file_id, string_agg(chunk_type, ',' ORDER BY start_line, id) AS kinds FROM chunks GROUP BY 1")
def _(t):
    ordered = F.array_sort(F.collect_list(F.when(F.col("chunk_type").isNotNull(), F.struct("start_line", "id", "chunk_type"))))
    kinds = F.array_join(F.transform(ordered, lambda x: x["chunk_type"]), ",")
    return t.chunks.groupBy("file_id").agg(F.when(F.count("chunk_type") > 0, kinds).alias("kinds"))


@P.add("agg_json", "SELECT file_id, CAST(to_json(list({'line_start': line_start, 'id': id, 'name': name} ORDER BY line_start, id, name)) AS VARCHAR) AS outline FROM (SELECT DISTINCT * FROM symbols) GROUP BY 1")
def _(t):
    return t.symbols.distinct().groupBy("file_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("line_start", "id", "name")))).alias("outline"))


@P.add("agg_having", "SELECT file_id, count(*) AS pieces FROM chunks GROUP BY 1 HAVING count(*) > 2 AND min(start_line) = 1")
def _(t):
    return t.chunks.groupBy("file_id").agg(F.count("*").alias("pieces"), F.min("start_line").alias("first")).where("pieces > 2 and first = 1").select("file_id", "pieces")


@P.add("agg_first_per_group", "SELECT source_id, path, max(id) AS latest FROM files GROUP BY ALL")
def _(t):
    order = Window.partitionBy("source_id", "path").orderBy(F.col("id").desc())
    return t.files.withColumn("n", F.row_number().over(order)).where("n = 1").select("source_id", "path", F.col("id").alias("latest"))


@P.add("agg_scalar_subquery", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunk_embeddings) AS vectors")
def _(t):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(t.files, "files").crossJoin(n(t.chunks, "chunks")).crossJoin(n(t.chunk_embeddings, "vectors"))


@P.add("agg_merkle_root", """
    SELECT source_id, sha256(string_agg(d, '' ORDER BY b)) AS root, CAST(sum(n) AS BIGINT) AS items FROM (
        SELECT source_id, substr(sha256(path), 1, 3) AS b, sha256(string_agg(lpad(lower(to_hex(strlen(path))), 16, '0') || path || lower(hex(hash)), '' ORDER BY path, id)) AS d, count(*) AS n FROM files GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    leaf = F.concat(F.lpad(F.lower(F.hex(F.octet_length("path"))), 16, "0"), "path", F.lower(F.hex("hash")))
    return parts.digest_tree(t.files, ["source_id"], leaf, F.struct("path", "id"), F.substring(F.sha2("path", 256), 1, 3))


@P.add("agg_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(t):
    found = parts.percentiles(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("event_type", *[F.round(n, 6).alias(n) for n in ("p50", "p95", "p99")])


@P.add("agg_mean_stdev", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))


@P.add("agg_group_by_language", "SELECT language, count(*) AS symbols FROM (SELECT DISTINCT id, language FROM symbols) GROUP BY 1")
def _(t):
    return t.symbols.select("id", "language").distinct().groupBy("language").agg(F.count("*").alias("symbols"))


# --- windows, order, sets ---------------------------------------------------------------------------------------------


@P.add("win_row_number_partition", "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def _(t):
    return t.events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))).where("rn <= 5").select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


@P.add("win_row_number_global", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rn FROM events ORDER BY value DESC, event_id LIMIT 100")
def _(t):
    top = t.events.orderBy(F.col("value").desc(), "event_id").limit(100)  # ranked only after the cut: one small partition
    return top.select("event_id", F.row_number().over(Window.orderBy(F.col("value").desc(), "event_id")).cast("long").alias("rn"))


@P.add("win_row_number_bucket", "SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 256 AS block FROM events")
def _(t):
    ranked = parts.running_before(t.events.select("event_type", "event_id"), ["event_type"], "event_id", F.lit(1))
    return ranked.select("event_type", "event_id", F.floor(F.col("before") / 256).alias("block"))


@P.add("win_lag_adjacent", "SELECT id, prev IS NOT NULL AND start_line > prev + 1 AS gap FROM (SELECT id, start_line, lag(end_line) OVER (PARTITION BY file_id ORDER BY start_line, id) AS prev FROM chunks)")
def _(t):
    prev = F.lag("end_line").over(Window.partitionBy("file_id").orderBy("start_line", "id"))
    return t.chunks.select("id", "start_line", prev.alias("prev")).select("id", (F.col("prev").isNotNull() & (F.col("start_line") > F.col("prev") + 1)).alias("gap"))


@P.add("win_lag_default", "SELECT id, lag(start_line, 1, 1) OVER (PARTITION BY file_id ORDER BY start_line, id) AS before FROM chunks")
def _(t):
    return t.chunks.select("id", F.lag("start_line", 1, 1).over(Window.partitionBy("file_id").orderBy("start_line", "id")).alias("before"))


@P.add("win_running_sum", "SELECT id, CAST(coalesce(sum(strlen(content_text)) OVER (PARTITION BY file_id ORDER BY start_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM chunks")
def _(t):
    w = Window.partitionBy("file_id").orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    return t.chunks.select("id", F.coalesce(F.sum(F.octet_length("content_text")).over(w), F.lit(0)).cast("long").alias("at"))


@P.add("sort_stable_ties", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def _(t):
    return t.events.orderBy(F.col("value").desc(), "event_id").limit(50).select("event_id", "value")


@P.add("topk_per_channel", """
    WITH a AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 500), b AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 500)
    SELECT event_id, value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 20)""")
def _(t):
    channel = lambda kind: t.events.where(F.col("event_type") == kind).orderBy(F.col("value").desc(), "event_id").limit(500)
    tenants = t.events.where("event_type = 'purchase' and value > 20").select("user_id")
    return channel("click").unionByName(channel("view")).join(tenants, "user_id", "left_semi").select("event_id", "value")


@P.add("topk_boundary_ties", "SELECT event_id, v FROM (SELECT event_id, floor(value) AS v, rank() OVER (ORDER BY floor(value) DESC) AS r FROM events) WHERE r <= 20")
def _(t):
    # The k-th best value is found first, then everything at least as good is kept: nothing is ranked in one task.
    rows = t.events.select("event_id", F.floor("value").cast("double").alias("v"))
    bound = rows.orderBy(F.col("v").desc()).limit(20).agg(F.min("v").alias("least"))
    return rows.crossJoin(F.broadcast(bound)).where("v >= least").select("event_id", "v")


@P.add("topk_group_best_fragment", """
    SELECT id FROM (SELECT c.id, row_number() OVER (PARTITION BY CASE WHEN n > 1 THEN c.file_id END, CASE WHEN n > 1 THEN -1 ELSE c.id END ORDER BY length(content_text) DESC, c.id) AS rn
    FROM chunks c JOIN (SELECT file_id, count(*) AS n FROM chunks GROUP BY 1) k USING (file_id)) WHERE rn = 1""")
def _(t):
    n = t.chunks.groupBy("file_id").agg(F.count("*").alias("n"))
    j = t.chunks.join(n, "file_id").withColumn("g", F.when(F.col("n") > 1, F.lit(-1)).otherwise(F.col("id")))
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("file_id", "g").orderBy(F.length("content_text").desc_nulls_last(), "id"))).where("rn = 1").select("id")


@P.add("page_offset", "SELECT id FROM files ORDER BY id LIMIT 20 OFFSET 40")
def _(t):
    return t.files.select("id").orderBy("id").offset(40).limit(20)


@P.add("sort_nulls_last", "SELECT id, user_id FROM sources ORDER BY user_id DESC NULLS LAST, id LIMIT 100")
def _(t):
    return t.sources.select("id", "user_id").orderBy(F.col("user_id").desc_nulls_last(), "id").limit(100)


@P.add("set_union_all", "SELECT file_id FROM chunks UNION ALL SELECT file_id FROM symbols")
def _(t):
    return t.chunks.select("file_id").unionByName(t.symbols.select("file_id"))


@P.add("set_union_distinct", "SELECT file_id FROM chunks UNION SELECT file_id FROM symbols")
def _(t):
    return t.chunks.select("file_id").union(t.symbols.select("file_id")).distinct()


@P.add("set_except_all", "SELECT * FROM (SELECT file_id FROM symbols EXCEPT ALL SELECT file_id FROM chunks)")
def _(t):
    return t.symbols.select("file_id").exceptAll(t.chunks.select("file_id"))


@P.add("set_intersect", "SELECT file_id FROM chunks INTERSECT SELECT file_id FROM symbols")
def _(t):
    return t.chunks.select("file_id").intersect(t.symbols.select("file_id"))


@P.add("fn_math", "SELECT event_id, round(ln(value + 1), 6) AS l, round(log2(value + 1), 6) AS l2, round(sqrt(value), 6) AS r, greatest(value, 10.0) AS g, abs(value - 10) AS a, CAST(floor(value / 3) AS BIGINT) AS f FROM events")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(F.log(v + 1), 6).alias("l"), F.round(F.log2(v + 1), 6).alias("l2"), F.round(F.sqrt(v), 6).alias("r"), F.greatest(v, F.lit(10.0)).alias("g"), F.abs(v - 10).alias("a"), F.floor(v / 3).alias("f"))


@P.add("fn_date", "SELECT event_id, epoch_us(ts) AS us, ts - INTERVAL 5 MINUTE AS before FROM events")
def _(t):
    return t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.expr("ts - interval 5 minutes").alias("before"))


@P.add("fn_hash_encoding", "SELECT id, sha256(path) AS digest, base64(encode(path)) AS encoded FROM files")
def _(t):
    return t.files.select("id", F.sha2("path", 256).alias("digest"), F.regexp_replace(F.base64(F.encode("path", "UTF-8")), r"\s", "").alias("encoded"))
