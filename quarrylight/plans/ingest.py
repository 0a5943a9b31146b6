"""Incremental ingest, versions and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.core import parts
from quarrylight.operators import versions
from quarrylight.plans import searching
from quarrylight.plans.registry import Plans

P = Plans()
# Snapshot 1 is what had been delivered by the first date, snapshot 2 by the second without what went stale before.
ONE, TWO, STALE = "2025-01-01 00:00:00", "2025-09-01 00:00:00", "2024-04-01 00:00:00"
FIRST_SQL = f"a AS (SELECT source_id || ':' || path AS k, arg_max(lower(hex(hash)), id) AS h FROM files WHERE created_at <= TIMESTAMPTZ '{ONE}+00' AND source_id IS NOT NULL AND path IS NOT NULL GROUP BY 1)"
SECOND_SQL = f"b AS (SELECT source_id || ':' || path AS k, arg_max(lower(hex(hash)), id) AS h FROM files WHERE created_at <= TIMESTAMPTZ '{TWO}+00' AND updated_at > TIMESTAMPTZ '{STALE}+00' AND source_id IS NOT NULL AND path IS NOT NULL GROUP BY 1)"


def _members(files):
    return files.where("source_id is not null and path is not null").groupBy(F.concat_ws(":", "source_id", "path").alias("item_key")).agg(F.max_by(F.lower(F.hex("hash")), "id").alias("identity"))


def _one(t):
    return _members(t.files.where(f"created_at <= timestamp '{ONE} UTC'"))


def _two(t):
    return _members(t.files.where(f"created_at <= timestamp '{TWO} UTC' and updated_at > timestamp '{STALE} UTC'"))


def _intervals(t):
    first = _one(t).select("item_key", "identity", F.lit(1).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return versions.commit(first, _two(t), 2)


@P.add("in_skip_unchanged", """
    WITH latest AS (SELECT source_id, path, arg_max(hash, id) AS h FROM files GROUP BY ALL), first AS (SELECT source_id, path, arg_min(hash, id) AS h FROM files GROUP BY ALL)
    SELECT l.source_id, l.path, l.h = f.h AS skip FROM latest l JOIN first f ON f.source_id = l.source_id AND f.path = l.path""")
def _(t):
    new = t.files.groupBy("source_id", "path").agg(F.max_by("hash", "id").alias("hash"))
    old = t.files.groupBy("source_id", "path").agg(F.min_by("hash", "id").alias("hash"))
    return versions.unchanged(new, old)


@P.add("in_append_detect", "SELECT a.id, b.id AS later, length(b.content_text) > length(a.content_text) AND starts_with(b.content_text, a.content_text) AS appended FROM files a JOIN files b ON a.source_id = b.source_id AND a.path = b.path AND a.id < b.id WHERE a.content_text IS NOT NULL AND b.content_text IS NOT NULL")
def _(t):
    a = t.files.where("content_text is not null").select("source_id", "path", "id", F.col("content_text").alias("old"))
    b = t.files.where("content_text is not null").select("source_id", "path", F.col("id").alias("later"), F.col("content_text").alias("new"))
    return a.join(b, ["source_id", "path"]).where("id < later").select("id", "later", versions.appended(F.col("old"), F.col("new")).alias("appended"))


@P.add("in_delete_detect", f"WITH {FIRST_SQL}, {SECOND_SQL} SELECT k AS item_key FROM a WHERE k NOT IN (SELECT k FROM b)")
def _(t):
    return versions.deleted(_one(t), _two(t), ["item_key"]).select("item_key")


@P.add("in_source_stats", "SELECT source_id, count(*) AS files, CAST(sum(size_original) AS BIGINT) AS bytes FROM files GROUP BY 1")
def _(t):
    return t.files.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("size_original").alias("bytes"))


@P.add("in_sync_ledger", """
    WITH c AS (SELECT f.source_id, count(*) AS left_count FROM chunks c JOIN files f ON f.id = c.file_id GROUP BY 1), e AS (SELECT f.source_id, count(*) AS right_count FROM chunk_embeddings e JOIN chunks c ON c.id = e.chunk_id JOIN files f ON f.id = c.file_id GROUP BY 1)
    SELECT coalesce(c.source_id, e.source_id) AS source_id, coalesce(left_count, 0) AS left_count, coalesce(right_count, 0) AS right_count, abs(coalesce(left_count, 0) - coalesce(right_count, 0)) AS drift,
        CASE WHEN coalesce(left_count, 0) = coalesce(right_count, 0) THEN 'in_sync' ELSE 'drifted' END AS status FROM c FULL JOIN e ON c.source_id = e.source_id""")
def _(t):
    chunks = t.chunks.select("id", "file_id").join(t.files.select(F.col("id").alias("file_id"), "source_id"), "file_id")
    vectors = t.chunk_embeddings.select(F.col("chunk_id").alias("id")).join(chunks, "id")
    return versions.drift(chunks, vectors, "source_id")


@P.add("in_orphans", "SELECT id FROM chunks WHERE id NOT IN (SELECT chunk_id FROM chunk_embeddings)")
def _(t):
    return t.chunks.select("id").join(t.chunk_embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti")


@P.add("in_pending_intel", "SELECT id FROM files WHERE coalesce(intelligence_symbols_count, 0) = 0 ORDER BY updated_at, id LIMIT 200")
def _(t):
    return t.files.where("coalesce(intelligence_symbols_count, 0) = 0").orderBy("updated_at", "id").limit(200).select("id")


@P.add("ve_delta_plan", f"WITH {FIRST_SQL}, {SECOND_SQL} SELECT coalesce(a.k, b.k) AS item_key, CASE WHEN a.k IS NULL THEN 'open' WHEN b.k IS NULL THEN 'close' WHEN a.h = b.h THEN 'unchanged' ELSE 'replace' END AS action FROM a FULL JOIN b ON a.k = b.k")
def _(t):
    return versions.delta_plan(_one(t), _two(t))


COMMITTED_SQL = f"""WITH {FIRST_SQL}, {SECOND_SQL}, m AS (SELECT a.k AS item_key, a.h AS identity, 1::BIGINT AS valid_from, CASE WHEN b.k IS NULL THEN 2 END::BIGINT AS valid_to FROM a LEFT JOIN b ON a.k = b.k AND a.h = b.h
    UNION ALL SELECT b.k, b.h, 2, NULL FROM b LEFT JOIN a ON a.k = b.k AND a.h = b.h WHERE a.k IS NULL)"""


@P.add("ve_commit", f"{COMMITTED_SQL} SELECT item_key, identity, valid_from, coalesce(valid_to, -1) AS valid_to FROM m")
def _(t):
    return _intervals(t).select("item_key", "identity", "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


@P.add("flt_snapshot_visible", f"{COMMITTED_SQL} SELECT item_key, identity FROM m WHERE valid_from <= 2 AND (valid_to IS NULL OR valid_to > 2)")
def _(t):
    return versions.visible(_intervals(t), 2).select("item_key", "identity")


@P.add("ve_overlap_check", f"""{COMMITTED_SQL}, c AS (SELECT item_key, valid_from, valid_to FROM m UNION ALL SELECT item_key, 2, 3 FROM m WHERE identity < '8')
    SELECT DISTINCT item_key FROM (SELECT *, lead(valid_from) OVER (PARTITION BY item_key ORDER BY valid_from, valid_to NULLS LAST) AS next FROM c) WHERE next IS NOT NULL AND (valid_to IS NULL OR next < valid_to)""")
def _(t):
    """A second history is laid over half of the items; those that were open are found, those that were closed aren't."""
    held = _intervals(t)
    second = held.where("identity < '8'").select("item_key", F.lit(2).cast("long").alias("valid_from"), F.lit(3).cast("long").alias("valid_to"))
    return versions.overlaps(held.select("item_key", "valid_from", "valid_to").unionByName(second))


@P.add("ve_resolve", f"{COMMITTED_SQL} SELECT max(valid_from) AS seq, count(*) FILTER (WHERE valid_to IS NULL) AS items FROM m")
def _(t):
    return _intervals(t).agg(F.max("valid_from").alias("seq"), F.count_if(F.col("valid_to").isNull()).alias("items"))


@P.add("ve_activate_set", "SELECT source_id, seq, sha256(source_id || ':' || seq) AS receipt FROM (SELECT id AS source_id, CASE WHEN type = 'git' THEN 2 ELSE 1 END AS seq FROM sources)")
def _(t):
    pointers = t.sources.select(F.col("id").alias("source_id"), F.lit(1).alias("seq"))
    return versions.activate(pointers, t.sources.where("type = 'git'").select(F.col("id").alias("source_id"), F.lit(2).alias("seq")))


@P.add("ve_append_verify", """
    SELECT a.id AS item_key, CASE WHEN strlen(b.content_text) < strlen(a.content_text) THEN 'shrunken' WHEN sha256(substr(b.content_text, 1, length(a.content_text))) <> sha256(a.content_text) THEN 'drifted' WHEN strlen(b.content_text) = strlen(a.content_text) THEN 'same' ELSE 'grown' END AS verdict
    FROM files a JOIN files b ON a.source_id = b.source_id AND a.path = b.path AND a.id < b.id WHERE a.content_text IS NOT NULL AND b.content_text IS NOT NULL""")
def _(t):
    a = t.files.where("content_text is not null").select("source_id", "path", F.col("id").alias("item_key"), F.col("content_text").alias("old"))
    b = t.files.where("content_text is not null").select("source_id", "path", F.col("id").alias("later"), F.col("content_text").alias("new"))
    rows = a.join(b, ["source_id", "path"]).where("item_key < later")
    prefix = F.substring(F.col("new"), F.lit(1), F.length("old"))
    return versions.verify_append(rows.select("item_key", F.octet_length("old").alias("old_size"), F.sha2("old", 256).alias("old_prefix_hash"), F.octet_length("new").alias("new_size"), F.sha2(prefix, 256).alias("new_prefix_hash")))


@P.add("ve_frontier_copy", f"{COMMITTED_SQL} SELECT item_key FROM m WHERE valid_from = 1 AND valid_to IS NULL")
def _(t):
    return _intervals(t).where("valid_from = 1 and valid_to is null").select("item_key")


@P.add("ve_source_metrics", """
    SELECT s.id AS source_id, (SELECT count(DISTINCT path) FROM files f WHERE f.source_id = s.id) AS paths, (SELECT count(*) FROM files f WHERE f.source_id = s.id) AS items, (SELECT count(*) FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.source_id = s.id) AS views,
    (SELECT count(DISTINCT y.id) FROM symbols y JOIN files f ON f.id = y.file_id WHERE f.source_id = s.id) AS symbols FROM sources s""")
def _(t):
    key = t.files.select(F.col("id").alias("file_id"), "source_id")
    a = t.files.select("source_id", "path").distinct().groupBy("source_id").agg(F.count("path").alias("paths"))
    b = t.files.groupBy("source_id").agg(F.count("*").alias("items"))
    c = t.chunks.select("file_id").join(key, "file_id").groupBy("source_id").agg(F.count("*").alias("views"))
    d = t.symbols.select("id", "file_id").distinct().join(key, "file_id").groupBy("source_id").agg(F.count("*").alias("symbols"))
    out = t.sources.select(F.col("id").alias("source_id"))
    for part in (a, b, c, d):
        out = out.join(part, "source_id", "left")
    return out.na.fill(0)


@P.add("ve_idempotent_run", f"WITH {FIRST_SQL} SELECT k AS item_key, h AS identity, 1 AS valid_from, -1 AS valid_to FROM a")
def _(t):
    """Committing the same snapshot again opens and closes nothing: all intervals are as they were."""
    first = _one(t).select("item_key", "identity", F.lit(1).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return versions.commit(first, _one(t), 2).select("item_key", "identity", "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


@P.add("st_body_dedup", "SELECT sha256(text) AS digest, strlen(text) AS size, count(*) AS uses, min(doc_id) AS first_id, false AS clash FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def _(t):
    return versions.bodies(t.documents.where("text is not null").select(F.col("doc_id").alias("id"), "text"))


@P.add("st_pack_offsets", "SELECT source_id, id, CAST(coalesce(sum(size_compressed) OVER (PARTITION BY source_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM files")
def _(t):
    return versions.pack_offsets(t.files.select("source_id", "id", F.col("size_compressed").alias("size")), "source_id")


PACKS_SQL = "p AS (SELECT source_id, CAST(sum(size_compressed) AS BIGINT) AS stored, CAST(sum(CASE WHEN dead THEN size_compressed ELSE 0 END) AS BIGINT) AS dead FROM (SELECT source_id, size_compressed, id < max(id) OVER (PARTITION BY source_id, path) OR content_text IS NULL AS dead FROM files) GROUP BY 1)"


def _packs(t):
    latest = t.files.groupBy("source_id", "path").agg(F.max("id").alias("latest"))
    rows = t.files.select("source_id", "path", "id", "size_compressed", F.col("content_text").isNull().alias("empty")).join(latest, ["source_id", "path"])
    gone = (F.col("id") < F.col("latest")) | F.col("empty")
    return rows.groupBy("source_id").agg(F.sum("size_compressed").alias("stored"), F.sum(F.when(gone, F.col("size_compressed")).otherwise(0)).alias("dead")).withColumn("live", F.col("stored") - F.col("dead"))


@P.add("st_pack_metrics", f"WITH {PACKS_SQL} SELECT source_id, stored, dead, stored - dead AS live FROM p WHERE source_id IS NOT NULL")
def _(t):
    return _packs(t).where("source_id is not null").select("source_id", "stored", "dead", "live")


@P.add("st_repack_policy", f"WITH {PACKS_SQL} SELECT source_id FROM p WHERE dead >= 0.02 * stored AND source_id IS NOT NULL")
def _(t):
    return versions.repack(_packs(t), 0.02).where("source_id is not null").select("source_id")


@P.add("st_align_hits", """
    SELECT c.id AS piece_id, CASE WHEN p > 0 AND instr(substr(w, p + 1), x) = 0 THEN p ELSE -1 END AS at, CASE WHEN p = 0 THEN 'absent' WHEN instr(substr(w, p + 1), x) > 0 THEN 'ambiguous' ELSE 'unique' END AS state
    FROM (SELECT c.id, c.content_text AS x, f.content_text AS w, instr(f.content_text, c.content_text) AS p FROM chunks c JOIN files f ON f.id = c.file_id WHERE length(c.content_text) > 0 AND f.content_text IS NOT NULL) c""")
def _(t):
    pieces = t.chunks.where("length(content_text) > 0").select(F.col("id").alias("piece_id"), "file_id", F.col("content_text").alias("piece"))
    return versions.align(pieces, t.files.where("content_text is not null").select(F.col("id").alias("file_id"), F.col("content_text").alias("whole"))).withColumn("at", F.coalesce("at", F.lit(-1)))


@P.add("st_map_order", """
    SELECT symbol_id, chunk_id, rn FROM (SELECT s.id AS symbol_id, c.id AS chunk_id, row_number() OVER (PARTITION BY s.id ORDER BY least(s.line_end, c.end_line) - greatest(s.line_start, c.start_line) DESC, c.start_line, c.id) AS rn
    FROM (SELECT DISTINCT id, file_id, line_start, line_end FROM symbols) s JOIN chunks c ON c.file_id = s.file_id AND c.start_line <= s.line_end AND c.end_line >= s.line_start)""")
def _(t):
    from pyspark.sql import Window

    s = t.symbols.select(F.col("id").alias("symbol_id"), "file_id", "line_start", "line_end").distinct()
    j = s.join(t.chunks.select(F.col("id").alias("chunk_id"), "file_id", "start_line", "end_line"), "file_id").where("start_line <= line_end and end_line >= line_start")
    shared = F.least("line_end", "end_line") - F.greatest("line_start", "start_line")
    return j.select("symbol_id", "chunk_id", F.row_number().over(Window.partitionBy("symbol_id").orderBy(shared.desc(), "start_line", "chunk_id")).cast("long").alias("rn"))


@P.add("st_dual_read_diff", f"""WITH {searching.SEMANTIC_SQL}, {searching.TERMS_SQL}, a AS (SELECT * FROM lex WHERE rank <= 20), b AS (SELECT * FROM sem WHERE rank <= 20)
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, CASE WHEN a.rank IS NULL THEN 'missing_old' WHEN b.rank IS NULL THEN 'missing_new' WHEN a.rank <> b.rank THEN 'score_order' ELSE 'same' END AS verdict
    FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id""")
def _(t):
    old = searching._lexical(t, 20)
    new = searching._semantic(t, 20).select("query_id", "id", F.col("similarity").alias("score"), "rank")
    return versions.dual_read(old, new)


@P.add("st_export_import", "SELECT CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM (SELECT id // 10000 AS b, count(*) AS n, sha256(string_agg(id || ':' || sha256(coalesce(name, '')), '' ORDER BY id)) AS d FROM (SELECT DISTINCT id, name FROM symbols) GROUP BY 1)")
def _(t):
    """Records with one digest over all, as an import checks it: of the digests of blocks, so no task gets all names."""
    rows = t.symbols.select(F.lit(1).alias("all"), "id", "name").distinct()
    leaf = F.concat(F.col("id").cast("string"), F.lit(":"), F.sha2(F.coalesce("name", F.lit("")), 256))
    return parts.digest_tree(rows, ["all"], leaf, F.col("id"), F.floor(F.col("id") / 10000)).select(F.col("items").alias("records"), F.col("root").alias("digest"))


@P.add("sink_bulk_upsert", "SELECT id, name, CASE WHEN type = 'git' THEN upper(type) ELSE type END AS type FROM sources")
def _(t):
    stored = t.sources.select("id", "name", "type")
    return versions.upsert(stored, stored.where("type = 'git'").withColumn("type", F.upper("type")), ["id"])


@P.add("sink_vector_upsert", "SELECT model, count(*) AS vectors FROM chunk_embeddings WHERE vector IS NOT NULL GROUP BY 1")
def _(t):
    import uuid

    from quarrylight.core.storage import checkpoint_dir

    place = f"{checkpoint_dir(t.spark)}/vectors-{uuid.uuid4().hex}"
    t.chunk_embeddings.where("vector is not null").write.partitionBy("model").parquet(place)
    return t.spark.read.parquet(place).groupBy("model").agg(F.count("*").alias("vectors"))


@P.add("ve_state_machine", "SELECT * FROM (VALUES ('building', 'sealed', true), ('sealed', 'active', false), ('active', 'superseded', true), ('superseded', 'building', false)) AS x(state, target, allowed)")
def _(t):
    def allowed(a: str, b: str) -> bool:
        try:
            return versions.advance(a, b) == b
        except versions.VersionError:
            return False

    steps = [("building", "sealed"), ("sealed", "active"), ("active", "superseded"), ("superseded", "building")]
    return t.spark.createDataFrame([(a, b, allowed(a, b)) for a, b in steps], "state string, target string, allowed boolean")
