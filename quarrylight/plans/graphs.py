"""Call graphs, code intelligence, enrichment and mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import enrich, graph
from quarrylight.plans.registry import Plans

P = Plans()
LAYERS = [("path_contains", "/admin/", "admin"), ("path_contains", "/storage/", "storage"), ("path_contains", "/ingest/", "ingest"), ("class_name_suffix", "Vector", "vector"), ("default", "", "core")]
EFFECTS = [("(?i)^(delete|prune|trim|drop)", "delete"), ("(?i)^(create|publish|commit|emit|flush)", "write"), ("(?i)^(get|load|fetch|scan|lookup|decode)", "read")]
RESOURCES = [("outbox", "queue"), ("cache", "cache"), ("storage", "disk"), ("search", "index")]
LAYER_SQL = "CASE WHEN contains(path, '/admin/') THEN 'admin' WHEN contains(path, '/storage/') THEN 'storage' WHEN contains(path, '/ingest/') THEN 'ingest' WHEN name LIKE '%Vector' THEN 'vector' ELSE 'core' END"
LAYER_SURE_SQL = "CASE WHEN contains(path, '/admin/') OR contains(path, '/storage/') OR contains(path, '/ingest/') THEN 0.85 WHEN name LIKE '%Vector' THEN 0.80 ELSE 0.3 END::DOUBLE"
PLAIN_SQL = "((length(name) <= 4 AND NOT regexp_matches(substr(name, 2), '[A-Z]')) OR NOT regexp_matches(name, '[a-z][A-Z]|^[a-z]{4,}'))"
EFFECT_SQL = f"CASE WHEN regexp_matches(name, '(?i)^(delete|prune|trim|drop)') THEN 'delete' WHEN regexp_matches(name, '(?i)^(create|publish|commit|emit|flush)') THEN 'write' WHEN regexp_matches(name, '(?i)^(get|load|fetch|scan|lookup|decode)') THEN 'read' WHEN {PLAIN_SQL} THEN 'unknown' END"
EFFECT_SURE_SQL = f"CASE WHEN regexp_matches(name, '(?i)^(delete|prune|trim|drop|create|publish|commit|emit|flush|get|load|fetch|scan|lookup|decode)') THEN 0.9 WHEN {PLAIN_SQL} THEN 0.2 ELSE 0.1 END::DOUBLE"
RESOURCE_SQL = "CASE WHEN contains(path || '/' || name, 'outbox') THEN 'queue' WHEN contains(path || '/' || name, 'cache') THEN 'cache' WHEN contains(path || '/' || name, 'storage') THEN 'disk' WHEN contains(path || '/' || name, 'search') THEN 'index' END"
RESOURCE_SURE_SQL = f"CASE WHEN {RESOURCE_SQL} IS NULL THEN 0.1 ELSE 0.85 END::DOUBLE"
NAMED_SQL = "(SELECT DISTINCT s.id, s.name, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name IS NOT NULL)"
EDGES_SQL = "e AS (SELECT DISTINCT g.caller_symbol_id AS caller_id, g.callee_symbol_id AS callee_id, g.callee_name AS callee, s.name AS caller FROM call_graph g JOIN symbols s ON s.id = g.caller_symbol_id)"
NOISE_SQL = "('SWC', 'r3B', 'assert', 'equals', 'toString', 'isControlSurfaceThread', 'isDocumentThread', 'exec', 'deprecated')"
ROLE_SQL = "CASE WHEN callee_name IN ('trace') OR starts_with(callee_name, 'trace(') THEN 'dispatch' WHEN regexp_matches(callee_name, '(?i)^(commit|publish|delete|prune)') THEN 'mutation' WHEN regexp_matches(s.name, '(?i)(proxy|remote)') THEN 'proxy' ELSE 'unknown' END"
ROLE_SURE_SQL = "CASE WHEN callee_name IN ('trace') OR starts_with(callee_name, 'trace(') THEN 0.9 WHEN regexp_matches(callee_name, '(?i)^(commit|publish|delete|prune)') THEN 0.85 WHEN regexp_matches(s.name, '(?i)(proxy|remote)') THEN 0.8 WHEN length(callee_name) <= 4 AND NOT regexp_matches(callee_name, '[a-z][A-Z]') THEN 0.2 ELSE 0.4 END::DOUBLE"


def _start(t):
    """The most called resolved name's caller with the most calls: a start that leads somewhere, the same in SQL."""
    row = graph.edges(t.symbols, t.call_graph).where("callee_id is not null").groupBy("caller").agg(F.countDistinct("callee_id").alias("n")).orderBy(F.col("n").desc(), "caller").first()
    return row["caller"] if row else ""


START_SQL = "(SELECT caller FROM e WHERE callee_id IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT callee_id) DESC, caller LIMIT 1)"


@P.add("g_callers", "SELECT path, call_line, caller, symbol_id FROM (SELECT DISTINCT f.path, g.call_line, s.name AS caller, s.id AS symbol_id FROM call_graph g JOIN symbols s ON s.id = g.caller_symbol_id JOIN files f ON f.id = s.file_id WHERE g.callee_name = 'trace') ORDER BY path, call_line, symbol_id LIMIT 100")
def _(t):
    return graph.callers("trace", t.symbols, t.call_graph, t.files)


@P.add("g_callees", f"WITH {EDGES_SQL} SELECT DISTINCT g.caller_symbol_id AS symbol_id, g.callee_name AS callee, g.call_line, g.callee_symbol_id IS NOT NULL AS resolved FROM call_graph g JOIN symbols s ON s.id = g.caller_symbol_id WHERE s.name = {START_SQL}")
def _(t):
    return graph.callees(_start(t), t.symbols, t.call_graph)


@P.add("g_symbol_callgraph", """
    SELECT s.id AS symbol_id, s.name, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM (SELECT DISTINCT id, name FROM symbols) s
    LEFT JOIN (SELECT callee_symbol_id AS id, count(DISTINCT caller_symbol_id) AS n FROM call_graph WHERE callee_symbol_id IS NOT NULL GROUP BY 1) i ON i.id = s.id
    LEFT JOIN (SELECT caller_symbol_id AS id, count(DISTINCT callee_name) AS n FROM call_graph GROUP BY 1) o ON o.id = s.id""")
def _(t):
    return graph.neighbourhood(t.symbols, t.call_graph)


@P.add("g_file_symbols", "SELECT DISTINCT s.id, s.name, f.path, s.line_start, s.line_end FROM symbols s JOIN files f ON f.id = s.file_id")
def _(t):
    return t.symbols.select("id", "name", "file_id", "line_start", "line_end").distinct().join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "path", "line_start", "line_end")


@P.add("g_chain_bfs")
def _(t):
    return graph.chain(_start(t), t.symbols, t.call_graph)


@P.add("g_chain_recursive", f"""
    WITH RECURSIVE {EDGES_SQL}, st AS (SELECT caller_id, callee_id FROM (SELECT caller_id, callee_id, row_number() OVER (PARTITION BY caller_id ORDER BY callee_id) AS n FROM (SELECT DISTINCT caller_id, callee_id FROM e WHERE callee_id IS NOT NULL AND callee_id <> caller_id)) WHERE n <= 10),
    r AS (SELECT 0 AS depth, id AS symbol_id, [id] AS path FROM (SELECT DISTINCT id FROM symbols WHERE name = {START_SQL}) UNION ALL
        SELECT depth + 1, st.callee_id, list_append(path, st.callee_id) FROM r JOIN st ON st.caller_id = r.symbol_id WHERE depth < 4 AND NOT list_contains(path, st.callee_id))
    SELECT depth, symbol_id, path FROM r""")
def _(t):
    return graph.resolved_chain(_start(t), t.symbols, t.call_graph)


@P.add("g_chain_v2")
def _(t):
    walk = graph.chain(_start(t), t.symbols, t.call_graph, depth=6, per_level=50, most=200)
    return walk.select("depth", "name", F.when(F.col("symbol_id").isNull(), "unresolved").when(F.col("depth") == 6, "depth_limit").otherwise("entry").alias("state"))


@P.add("g_resolve_calls", """
    WITH n AS (SELECT name, count(DISTINCT id) AS k, min(id) AS single FROM symbols WHERE type IN ('function', 'method') GROUP BY 1)
    SELECT c.name AS callee, coalesce(CASE WHEN k = 1 THEN single END, -1) AS symbol_id, coalesce(k = 1, false) AS proven, coalesce(k, 0) AS candidates FROM (SELECT DISTINCT callee_name AS name FROM call_graph) c LEFT JOIN n ON n.name = c.name""")
def _(t):
    return graph.proven_calls(t.symbols, t.call_graph).withColumn("symbol_id", F.coalesce("symbol_id", F.lit(-1)))


@P.add("g_pick_primary", f"""
    WITH c AS (SELECT DISTINCT s.id AS symbol_id, s.name, g.callee_name AS callee, {ROLE_SQL} AS role, {ROLE_SURE_SQL} AS confidence FROM call_graph g JOIN (SELECT DISTINCT id, name FROM symbols) s ON s.id = g.caller_symbol_id WHERE g.callee_name IS NOT NULL),
    w AS (SELECT *, CASE WHEN length(name) > 3 AND length(callee) > 3 AND (contains(lower(name), lower(callee)) OR contains(lower(callee), lower(name))) THEN 1 WHEN role IN ('dispatch', 'mutation') THEN 2 WHEN role <> 'unknown' THEN 3 ELSE 4 END AS why FROM c)
    SELECT symbol_id, callee, why FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY why, confidence DESC NULLS LAST, callee) AS n FROM w) WHERE n = 1""")
def _(t):
    return graph.primary_targets(_targets(t))


def _targets(t):
    s = t.symbols.select(F.col("id").alias("caller_symbol_id"), "name").distinct()
    role, sure = enrich.delegation_role(F.col("callee_name"), F.col("name"), ["trace"], ["(?i)^(commit|publish|delete|prune)"], ["(?i)(proxy|remote)"])
    return t.call_graph.where("callee_name is not null").join(s, "caller_symbol_id").select(F.col("caller_symbol_id").alias("symbol_id"), "name", F.col("callee_name").alias("callee"), role.alias("role"), sure.alias("confidence")).distinct()


@P.add("g_delegation", f"""
    WITH RECURSIVE {EDGES_SQL}, c AS (SELECT DISTINCT s.id AS symbol_id, s.name, g.callee_name AS callee, {ROLE_SQL} AS role, {ROLE_SURE_SQL} AS confidence FROM call_graph g JOIN (SELECT DISTINCT id, name FROM symbols) s ON s.id = g.caller_symbol_id WHERE g.callee_name IS NOT NULL),
        w AS (SELECT *, CASE WHEN length(name) > 3 AND length(callee) > 3 AND (contains(lower(name), lower(callee)) OR contains(lower(callee), lower(name))) THEN 1 WHEN role IN ('dispatch', 'mutation') THEN 2 WHEN role <> 'unknown' THEN 3 ELSE 4 END AS why FROM c),
    p AS (SELECT symbol_id, callee FROM (SELECT symbol_id, callee, row_number() OVER (PARTITION BY symbol_id ORDER BY why, confidence DESC NULLS LAST, callee) AS n FROM w) WHERE n = 1),
    s AS (SELECT p.symbol_id, p.callee, min(g.callee_symbol_id) AS next FROM p LEFT JOIN call_graph g ON g.caller_symbol_id = p.symbol_id AND g.callee_name = p.callee AND g.callee_symbol_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT st.id AS start, 1 AS hop, s.callee, s.next FROM (SELECT DISTINCT id FROM symbols WHERE name = {START_SQL}) st JOIN s ON s.symbol_id = st.id
        UNION ALL SELECT r.start, hop + 1, s.callee, s.next FROM r JOIN s ON s.symbol_id = r.next WHERE r.next <> r.start AND hop < 10)
    SELECT start, hop, callee FROM r""")
def _(t):
    """The walk over primary targets from every symbol of the start name, at most ten steps."""
    primary = graph.primary_targets(_targets(t)).select("symbol_id", "callee")
    resolved = t.call_graph.where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("symbol_id"), F.col("callee_name").alias("callee"), F.col("callee_symbol_id").alias("next")).groupBy("symbol_id", "callee").agg(F.min("next").alias("next"))
    step = primary.join(resolved, ["symbol_id", "callee"], "left")
    at = t.symbols.where(F.col("name") == _start(t)).select(F.col("id").alias("start"), F.col("id").alias("symbol_id")).distinct()
    out = None
    for hop in range(1, 11):
        moved = at.join(step, "symbol_id").select("start", F.lit(hop).alias("hop"), "callee", "next")
        out = moved if out is None else out.unionByName(moved)
        at = moved.where("next is not null and next <> start").select("start", F.col("next").alias("symbol_id"))
    return out.select("start", "hop", "callee")


@P.add("g_ownership", "WITH r AS (SELECT DISTINCT caller_symbol_id AS a, callee_symbol_id AS b FROM call_graph WHERE callee_symbol_id IS NOT NULL) SELECT a AS symbol_id, 'out' AS direction, b AS other FROM r UNION ALL SELECT b, 'in', a FROM r")
def _(t):
    r = t.call_graph.where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("a"), F.col("callee_symbol_id").alias("b")).distinct()
    out = r.select(F.col("a").alias("symbol_id"), F.lit("out").alias("direction"), F.col("b").alias("other"))
    return out.unionByName(r.select(F.col("b").alias("symbol_id"), F.lit("in").alias("direction"), F.col("a").alias("other")))


@P.add("g_cards", f"SELECT id, name, {LAYER_SQL} AS layer, {EFFECT_SQL} AS effect, round(({LAYER_SURE_SQL} * 0.3 + {EFFECT_SURE_SQL} * 0.4 + {RESOURCE_SURE_SQL} * 0.3) / 1.0, 6) AS confidence FROM {NAMED_SQL} WHERE name ILIKE '%vector%'")
def _(t):
    return _cards(t).where(F.col("name").ilike("%vector%")).select("id", "name", "layer", "effect", F.round("confidence", 6).alias("confidence"))


def _cards(t):
    n = t.symbols.select("id", "name", "file_id").distinct().join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id").where("name is not null")
    layer, ls = enrich.layer(F.col("path"), F.col("name"), LAYERS)
    effect, es = enrich.side_effect(F.col("name"), EFFECTS)
    res, rs = enrich.resource(F.col("path"), F.col("name"), RESOURCES)
    return n.select("id", "name", "path", layer.alias("layer"), ls.alias("layer_sure"), effect.alias("effect"), es.alias("effect_sure"), res.alias("resource"), rs.alias("resource_sure"), enrich.confidence(ls, es, rs).alias("confidence"))


@P.add("g_explore", f"""
    WITH k AS (SELECT id, name, {LAYER_SQL} AS layer, {EFFECT_SQL} AS effect FROM {NAMED_SQL}), h AS (SELECT *, CASE WHEN effect = 'read' AND name ILIKE '%frontier%' THEN 1 WHEN effect = 'read' THEN 2 ELSE 3 END AS stage FROM k WHERE name ILIKE '%frontier%' OR name ILIKE '%cursor%')
    SELECT layer, id, name, stage FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY stage, name, id) AS n FROM h) WHERE n <= 3""")
def _(t):
    from pyspark.sql import Window

    stage = F.when((F.col("effect") == "read") & F.col("name").ilike("%frontier%"), 1).when(F.col("effect") == "read", 2).otherwise(3)
    hits = _cards(t).where(F.col("name").ilike("%frontier%") | F.col("name").ilike("%cursor%")).withColumn("stage", stage)
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("layer").orderBy("stage", "name", "id"))).where("n <= 3").select("layer", "id", "name", "stage")


@P.add("g_negative_evidence", "SELECT doc_id FROM documents WHERE kind = 'issue' AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])cursor|frontiers([^\\p{L}\\p{N}_]|$)')")
def _(t):
    return t.documents.where("kind = 'issue'").where(F.lower("text").rlike(r"(^|[^\p{L}\p{N}_])cursor|frontiers([^\p{L}\p{N}_]|$)")).select("doc_id")


@P.add("g_stable_key", """
    WITH s AS (SELECT DISTINCT ON (s.id) s.id, f.path, coalesce(s.language, '') AS language, s.type, coalesce(s.qualified_name, s.name, '') AS q, regexp_replace(coalesce(s.signature, ''), '\\s+', '', 'g') AS flat, s.line_start FROM symbols s JOIN files f ON f.id = s.file_id ORDER BY s.id),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY path, language, type, q, flat ORDER BY line_start, id) - 1 AS VARCHAR) AS n FROM s)
    SELECT id AS symbol_id, sha256(unhex(array_to_string(list_transform([path, language, type, q, flat, n], lambda x: lpad(lower(to_hex(strlen(x))), 16, '0') || lower(hex(encode(x)))), ''))) AS key FROM n""")
def _(t):
    return graph.stable_keys(t.symbols, t.files)


@P.add("g_stats", "SELECT (SELECT count(DISTINCT id) FROM symbols) AS symbols, (SELECT count(DISTINCT id) FROM call_graph) AS calls, (SELECT count(DISTINCT id) FROM call_graph WHERE callee_symbol_id IS NOT NULL) AS resolved")
def _(t):
    calls = t.call_graph.groupBy("id").agg(F.max(F.col("callee_symbol_id").isNotNull()).alias("r")).agg(F.count("*").alias("calls"), F.count_if("r").alias("resolved"))
    return t.symbols.select("id").distinct().agg(F.count("*").alias("symbols")).crossJoin(calls)


@P.add("g_content_reconstruct", "SELECT f.id, sha256(string_agg(p, '' ORDER BY n)) = lower(hex(f.hash)) AS whole FROM (SELECT id, hash, unnest(generate_series(0, CAST(ceil(greatest(length(content_text), 1) / 500.0) AS BIGINT) - 1)) AS n, content_text FROM files WHERE content_text IS NOT NULL) f, LATERAL (SELECT substr(f.content_text, f.n * 500 + 1, 500) AS p) GROUP BY f.id, f.hash")
def _(t):
    nodes = t.files.where("content_text is not null").select("id", "hash", "content_text", F.explode(F.sequence(F.lit(0), (F.ceil(F.greatest(F.length("content_text"), F.lit(1)) / 500) - 1).cast("int"))).alias("n"))
    parts = nodes.select("id", "hash", "n", F.substring(F.col("content_text"), F.col("n") * 500 + 1, F.lit(500)).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), "")
    return parts.groupBy("id", "hash").agg(joined.alias("text")).select("id", (F.sha2("text", 256) == F.lower(F.hex("hash"))).alias("whole"))


@P.add("g_reachability_gc", """
    WITH RECURSIVE l AS (SELECT DISTINCT caller_symbol_id AS a, callee_symbol_id AS b FROM call_graph WHERE callee_symbol_id IS NOT NULL),
    r AS (SELECT id FROM symbols WHERE visibility = 'pub' UNION SELECT l.b FROM r JOIN l ON l.a = r.id) SELECT DISTINCT id FROM symbols WHERE id NOT IN (SELECT id FROM r)""")
def _(t):
    links = t.call_graph.where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("here"), F.col("callee_symbol_id").alias("there")).distinct()
    kept = graph.reachable(t.symbols.where("visibility = 'pub'").select("id"), links)
    return t.symbols.select("id").distinct().join(kept, "id", "left_anti")


# --- enrichment -------------------------------------------------------------------------------------------------------


@P.add("en_layer", f"SELECT id, {LAYER_SQL} AS layer, {LAYER_SURE_SQL} AS confidence FROM {NAMED_SQL}")
def _(t):
    return _cards(t).select("id", "layer", F.col("layer_sure").alias("confidence"))


@P.add("en_side_effect", f"SELECT id, {EFFECT_SQL} AS effect, {EFFECT_SURE_SQL} AS confidence FROM {NAMED_SQL}")
def _(t):
    return _cards(t).select("id", "effect", F.col("effect_sure").alias("confidence"))


@P.add("en_resource", f"SELECT id, {RESOURCE_SQL} AS resource, {RESOURCE_SURE_SQL} AS confidence FROM {NAMED_SQL}")
def _(t):
    return _cards(t).select("id", "resource", F.col("resource_sure").alias("confidence"))


@P.add("en_confidence", f"SELECT id, round(({LAYER_SURE_SQL} * 0.3 + {EFFECT_SURE_SQL} * 0.4 + {RESOURCE_SURE_SQL} * 0.3) / 1.0, 6) AS confidence FROM {NAMED_SQL}")
def _(t):
    return _cards(t).select("id", F.round("confidence", 6).alias("confidence"))


@P.add("en_summary", f"SELECT id, concat_ws(' ', name, CASE WHEN {EFFECT_SQL} <> 'unknown' THEN '[' || {EFFECT_SQL} || ']' END, CASE WHEN {LAYER_SQL} <> 'unknown' THEN 'in ' || {LAYER_SQL} END, CASE WHEN {RESOURCE_SQL} IS NOT NULL THEN '(' || {RESOURCE_SQL} || ')' END) AS summary FROM {NAMED_SQL}")
def _(t):
    return _cards(t).select("id", enrich.summary(F.col("name"), F.col("layer"), F.col("effect"), F.col("resource")).alias("summary"))


@P.add("en_role", f"SELECT DISTINCT s.id AS symbol_id, g.callee_name AS callee, {ROLE_SQL} AS role, {ROLE_SURE_SQL} AS confidence FROM call_graph g JOIN (SELECT DISTINCT id, name FROM symbols) s ON s.id = g.caller_symbol_id WHERE g.callee_name IS NOT NULL")
def _(t):
    return _targets(t).select("symbol_id", "callee", "role", "confidence")


@P.add("en_callee_cap", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY caller_symbol_id ORDER BY call_line, id) AS n FROM (SELECT DISTINCT id, caller_symbol_id, call_line FROM call_graph)) WHERE n <= 2")
def _(t):
    return enrich.first_callees(t.call_graph, 2).select("id")


@P.add("en_annotations", """
    WITH l AS (SELECT id, start_line, unnest(string_split(content_text, chr(10))) AS line, generate_subscripts(string_split(content_text, chr(10)), 1) - 1 AS n FROM chunks)
    SELECT id, 'todo' AS annotation_type, regexp_extract(line, 'TODO\\s+(\\w+)', 1) AS value, start_line + n AS evidence_line FROM l WHERE regexp_matches(line, 'TODO\\s+(\\w+)')
    UNION ALL SELECT id, 'thread', 'threads', start_line + n FROM l WHERE regexp_matches(line, '(threads)')""")
def _(t):
    return enrich.annotations(t.chunks, [("todo", r"TODO\s+(\w+)", 1), ("thread", "(threads)", 1)]).select("id", "annotation_type", "value", F.col("evidence_line").cast("long").alias("evidence_line"))


@P.add("en_entities", """
    SELECT name, type, path, id FROM (SELECT s.name, s.type, f.path, s.id, row_number() OVER (PARTITION BY s.name, s.type, f.path ORDER BY s.line_end - s.line_start DESC, s.id) AS n FROM (SELECT DISTINCT * FROM symbols) s JOIN files f ON f.id = s.file_id WHERE s.type IN ('class', 'struct')) WHERE n = 1""")
def _(t):
    rows = t.symbols.distinct().where("type in ('class', 'struct')").join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    best = F.max_by("id", F.struct(F.col("line_end") - F.col("line_start"), -F.col("id")))
    return rows.groupBy("name", "type", "path").agg(best.alias("id"))


def _classes(t):
    s = t.symbols.where("type in ('class', 'struct')").select("name", "file_id", "line_start", "line_end").distinct()
    c = t.chunks.where("content_text is not null").select("file_id", "id", "start_line", "end_line", "content_text")
    parts = s.join(c, "file_id").where("start_line <= line_end and end_line >= line_start")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "content_text"))), lambda x: x["content_text"]), "\n")
    return parts.groupBy("name", "file_id", "line_start").agg(body.alias("body"))


RELATIONS_SQL = " UNION ALL ".join(f"SELECT name, unnest(regexp_extract_all(body, '{p}', 1)) AS target, '{r}' AS relation, {c}::DOUBLE AS confidence FROM b" for _, p, r, c in enrich.RELATIONS)


# Classes of every relation beside those of the tables, which own nothing.
MORE_CLASSES = [
    ("Holder", "public class Holder {\n  private final List<Item> items;\n  protected Map<String, Part> parts;\n  private final Real target;\n  public Owner getParent() { return owner; }\n  private Owner owner;\n  void put(Item item, Other other) {}\n}"),
    ("Item", "class Item {\n  private Holder holder = null;\n  public String getDocument() { return null; }\n  Item copy(Item item) {}\n}"),
]
MORE_CLASSES_SQL = ", ".join(f"('{n}', '{b}')" for n, b in MORE_CLASSES)


@P.add("en_relations", f"""
    WITH s AS (SELECT DISTINCT name, file_id, line_start, line_end FROM symbols WHERE type IN ('class', 'struct')),
    b AS (SELECT name, s.file_id, line_start, string_agg(content_text, chr(10) ORDER BY start_line, id) AS body FROM s JOIN chunks c ON c.file_id = s.file_id AND c.start_line <= s.line_end AND c.end_line >= s.line_start
        WHERE content_text IS NOT NULL GROUP BY ALL UNION ALL SELECT name, -1, -1, body FROM (VALUES {MORE_CLASSES_SQL}) AS m(name, body))
    SELECT name, target, relation, max(confidence) AS confidence FROM ({RELATIONS_SQL}) WHERE target NOT IN ({", ".join(f"'{x}'" for x in enrich.PLAIN_TYPES)}) AND target <> name AND target <> '' GROUP BY ALL""")
def _(t):
    more = t.spark.createDataFrame(MORE_CLASSES, "name string, body string")
    return enrich.relations(_classes(t).select("name", "body").unionByName(more))


@P.add("en_delegates", "SELECT DISTINCT split_part(a.qualified_name, '.', 2) AS owner, b.name AS target FROM call_graph g JOIN symbols a ON a.id = g.caller_symbol_id JOIN symbols b ON b.id = g.callee_symbol_id WHERE a.qualified_name LIKE '%.%.%'")
def _(t):
    a = t.symbols.where("qualified_name like '%.%.%'").select(F.col("id").alias("caller_symbol_id"), F.split_part("qualified_name", F.lit("."), F.lit(2)).alias("owner"))
    b = t.symbols.select(F.col("id").alias("callee_symbol_id"), F.col("name").alias("target"))
    return t.call_graph.join(a, "caller_symbol_id").join(b, "callee_symbol_id").select("owner", "target").distinct()


IDENT_SQL = "list_filter(list_transform(string_split(CASE WHEN contains(name, '_') THEN name ELSE regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g') END, '_'), lambda p: trim(lower(p))), lambda p: length(p) >= 3 AND regexp_matches(p, '^\\p{L}+$'))"
FREQUENCY_SQL = f"""fr AS (SELECT word, sum(n) AS weight FROM (SELECT unnest({IDENT_SQL}) AS word, 3 AS n FROM (SELECT DISTINCT name FROM symbols) UNION ALL
    SELECT unnest(list_filter(regexp_split_to_array(lower(doc_comment), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^\\p{{L}}+$'))), 2 FROM (SELECT DISTINCT id, doc_comment FROM symbols)) GROUP BY 1)"""


def _frequency(t):
    return enrich.word_frequency(t.symbols.select("name"), t.symbols.select("id", F.col("doc_comment").alias("text")).distinct())


@P.add("en_ident_split", f"SELECT DISTINCT name, {IDENT_SQL} AS words FROM symbols")
def _(t):
    from quarrylight.functions.text import identifier_words

    return t.symbols.select("name", identifier_words(F.col("name")).alias("words")).distinct()


PLAIN_NAME_SQL = "(NOT starts_with(name, '_') AND upper(name) = name AND lower(name) <> name OR regexp_matches(name, '^\\p{Ll}'))"
IDENTIFIERS_SQL = " UNION ALL ".join(
    f"SELECT id, name FROM (SELECT id, unnest(regexp_extract_all(content_text, '{p}', 1)) AS name FROM files WHERE language IN ({', '.join(repr(x) for x in languages)})){' WHERE ' + PLAIN_NAME_SQL if assigned else ''}"
    for languages, rules in enrich.IDENTIFIERS for p, assigned in rules
)


@P.add("en_ident_extract", f"SELECT DISTINCT id, name FROM ({IDENTIFIERS_SQL})")
def _(t):
    return enrich.identifiers(t.files.select("id", "language", F.col("content_text").alias("text")))


@P.add("en_word_freq", f"WITH {FREQUENCY_SQL} SELECT word, CAST(weight AS BIGINT) AS weight FROM fr")
def _(t):
    return _frequency(t)


SEED_SQL = ", ".join(f"('{g}', '{w}')" for g, ws in enrich.SEED_GROUPS.items() for w in ws)


@P.add("en_synonym_groups", f"""WITH {FREQUENCY_SQL}, g AS (SELECT seed, list(word ORDER BY weight DESC, word) AS ws FROM fr JOIN (VALUES {SEED_SQL}) AS s(seed, word) USING (word) WHERE weight >= 2 GROUP BY 1 HAVING count(*) >= 2)
    SELECT ws[1] AS term, ws[2:6] AS aliases FROM g""")
def _(t):
    return enrich.synonym_groups(_frequency(t))


@P.add("en_similar_words")
def _(t):
    return enrich.similar_words(_frequency(t))


@P.add("en_merge_synonyms", f"""WITH {FREQUENCY_SQL}, g AS (SELECT word AS term, weight FROM fr WHERE weight >= 100 UNION ALL SELECT lower(name), 1 FROM (SELECT DISTINCT name FROM symbols WHERE type = 'class')) SELECT term, CAST(max(weight) AS BIGINT) AS weight, count(*) AS origins FROM g GROUP BY 1""")
def _(t):
    a = _frequency(t).where("weight >= 100").select(F.col("word").alias("term"), "weight")
    b = t.symbols.where("type = 'class'").select(F.lower("name").alias("term"), "name").distinct().select("term", F.lit(1).cast("long").alias("weight"))
    return a.unionByName(b).groupBy("term").agg(F.max("weight").alias("weight"), F.count("*").alias("origins"))


@P.add("en_golden_templates", "SELECT DISTINCT 'find ' || k || ' in ' || name AS query, name || '-' || k AS id FROM sources, (VALUES ('handler'), ('config'), ('test')) AS t(k)")
def _(t):
    kinds = t.spark.createDataFrame([("handler",), ("config",), ("test",)], "k string")
    return t.sources.select("name").crossJoin(F.broadcast(kinds)).select(F.concat(F.lit("find "), "k", F.lit(" in "), "name").alias("query"), F.concat("name", F.lit("-"), "k").alias("id")).distinct()


@P.add("g_annotations", "SELECT c.id, c.file_id, c.start_line FROM chunks c WHERE regexp_matches(c.content_text, 'TODO[ \\t]+\\w+')")
def _(t):
    found = enrich.annotations(t.chunks, [("todo", r"TODO\s+(\w+)", 1)]).select("id").distinct()
    return t.chunks.select("id", "file_id", "start_line").join(found, "id", "left_semi")


@P.add("g_profile_facts", "SELECT id, count(*) AS n FROM symbols GROUP BY 1 HAVING count(*) > 1")
def _(t):
    """Symbols for which a fact would be set twice."""
    return t.symbols.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
