"""Hybrid retrieval and exact boolean retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.core.storage import cut
from quarrylight.functions import scoring
from quarrylight.functions import text as tx
from quarrylight.operators import enrich, exact, retrieval
from quarrylight.plans import graphs
from quarrylight.plans.registry import Plans
from quarrylight.plans.texts import sql_words

P = Plans()

VECTORS_SQL = """v AS (SELECT chunk_id AS id, model, CAST(vector AS DOUBLE[64]) AS x FROM chunk_embeddings WHERE vector IS NOT NULL AND len(vector) = 64 AND list_sum(list_transform(vector, lambda e: abs(e))) > 0)"""
SEMANTIC_SQL = f"""{VECTORS_SQL}, sem AS (SELECT query_id, id, sim, rank FROM (SELECT q.id AS query_id, b.id AS id, round(array_cosine_similarity(q.x, b.x), 9) AS sim,
    row_number() OVER (PARTITION BY q.id ORDER BY round(array_cosine_similarity(q.x, b.x), 9) DESC, b.id) AS rank FROM v q JOIN v b ON q.model = b.model AND q.id <> b.id WHERE q.id % 100 = 0) WHERE rank <= 100)"""
TERMS_SQL = f"""tok AS (SELECT id, {sql_words('content_text')} AS ws FROM chunks WHERE content_text IS NOT NULL),
    asked AS (SELECT id AS query_id, unnest(list_distinct({sql_words("regexp_extract(content_text, '\\S[^\\n]*', 0)")})) AS term FROM chunks WHERE id % 100 = 0 AND content_text IS NOT NULL),
    st AS (SELECT count(*) AS n, avg(len(ws)) AS average FROM tok WHERE len(ws) > 0),
    p AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT id, len(ws) AS length, unnest(ws) AS term FROM tok) GROUP BY id, term),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    sc AS (SELECT query_id, p.id, round(sum(ln(1 + (n + 1) / (df + 1)) * tf / (tf + 0.5 + 0.5 * length / average)), 9) AS score FROM asked JOIN p USING (term) JOIN d USING (term), st GROUP BY ALL),
    lex AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 100)"""
FUSED_SQL = """fu AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.id, l.id) AS id,
    (coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0)) * CASE WHEN s.rank IS NOT NULL AND l.rank IS NOT NULL THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS fused, s.rank AS semantic_rank, l.rank AS lexical_rank
    FROM sem s FULL JOIN lex l ON s.query_id = l.query_id AND s.id = l.id)"""
TYPE_SQL = "CASE coalesce(chunk_type, 'code') WHEN 'function' THEN 1.4 WHEN 'class' THEN 1.35 WHEN 'module' THEN 1.3 WHEN 'type' THEN 1.25 WHEN 'code' THEN 1.2 WHEN 'conversation' THEN 1.1 WHEN 'text' THEN 0.7 ELSE 1.0 END::DOUBLE"
LEVEL_SQL = "CASE coalesce(level, 1) WHEN 2 THEN 1.15 WHEN 1 THEN 1.05 WHEN 0 THEN 0.9 ELSE 1.0 END::DOUBLE"
LENGTH_SQL = "CASE WHEN b <= 30 THEN 0.3 WHEN b <= 80 THEN 0.6 WHEN b <= 200 THEN 0.85 WHEN b <= 3000 THEN 1.0 WHEN b <= 6000 THEN 0.9 ELSE 0.75 END::DOUBLE"
PATH_SQL = r"""CASE WHEN regexp_matches(lower(path), 'changelog|changes') THEN 0.15 WHEN regexp_matches(lower(path), 'golden-set|golden_set') OR (contains(lower(path), '/eval/') AND lower(path) LIKE '%.jsonl') THEN 0.1
    WHEN regexp_matches(lower(path), 'license|support\.md|contributing|code_of_conduct') THEN 0.2 WHEN regexp_matches(lower(path), '/testdata/|/test/fixtures/|_testdata') THEN 0.15
    WHEN regexp_matches(lower(path), '/test|_test\.|\.test\.|/spec/|_test_') THEN 0.4 WHEN regexp_matches(lower(path), '/vendor/|/third_party/|/node_modules/') THEN 0.6 WHEN regexp_matches(lower(path), '\.pb\.|generated|\.gen\.') THEN 0.5
    WHEN regexp_matches(lower(path), 'openapi-spec|swagger') OR (contains(lower(path), 'openapi') AND lower(path) LIKE '%.json') THEN 0.3
    ELSE CASE split_part(path, '.', -1) WHEN 'rs' THEN 1.2 WHEN 'go' THEN 1.2 WHEN 'py' THEN 1.2 WHEN 'ts' THEN 1.2 WHEN 'js' THEN 1.2 WHEN 'java' THEN 1.2 WHEN 'c' THEN 1.2 WHEN 'cpp' THEN 1.2 WHEN 'cs' THEN 1.2 WHEN 'rb' THEN 1.2 WHEN 'php' THEN 1.2 WHEN 'lua' THEN 1.2 WHEN 'zig' THEN 1.2 WHEN 'swift' THEN 1.2 WHEN 'kt' THEN 1.2
      WHEN 'sql' THEN 1.0 WHEN 'toml' THEN 1.0 WHEN 'yaml' THEN 1.0 WHEN 'yml' THEN 1.0 WHEN 'json' THEN 1.0 WHEN 'sh' THEN 0.95 WHEN 'bash' THEN 0.95 WHEN 'zsh' THEN 0.95 WHEN 'md' THEN 0.6 WHEN 'txt' THEN 0.6 WHEN 'rst' THEN 0.6 WHEN 'adoc' THEN 0.6 WHEN 'jsonl' THEN 0.85 WHEN 'csv' THEN 0.5 WHEN 'xml' THEN 0.5 WHEN 'html' THEN 0.8 WHEN 'css' THEN 0.8 WHEN 'scss' THEN 0.8 ELSE 0.9 END END::DOUBLE"""
CALLERS_SQL = """called AS (SELECT callee_symbol_id AS sid, count(*) AS n FROM (SELECT DISTINCT id, callee_symbol_id FROM call_graph WHERE callee_symbol_id IS NOT NULL) GROUP BY 1),
    cal AS (SELECT c.id, sum(n) AS callers FROM chunks c JOIN (SELECT DISTINCT id, file_id, line_start, line_end FROM symbols) s ON s.file_id = c.file_id AND s.line_start <= c.start_line AND c.start_line <= s.line_end JOIN called ON called.sid = s.id
    WHERE c.chunk_type IN ('function', 'class', 'type') GROUP BY 1)"""
BOOST_SQL = f"""bo AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, fu.id, round(fused * {TYPE_SQL} * {PATH_SQL} * {LENGTH_SQL} * {LEVEL_SQL} * CASE WHEN coalesce(callers, 0) > 0 THEN 1 + 0.1::DOUBLE * log2(callers + 1) ELSE 1.0::DOUBLE END, 9) AS score
    FROM fu JOIN (SELECT id, file_id, chunk_type, level, coalesce(strlen(content_text), 0) AS b FROM chunks) c ON c.id = fu.id JOIN (SELECT id AS fid, path FROM files) f ON f.fid = c.file_id LEFT JOIN cal ON cal.id = fu.id) WHERE score >= 0.005)"""


def _queries(t):
    return t.chunk_embeddings.where("chunk_id % 100 = 0 and size(vector) = 64").select(F.col("chunk_id").alias("query_id"), "model", "vector")


def _base(t):
    return t.chunk_embeddings.where("size(vector) = 64").select(F.col("chunk_id").alias("id"), "model", "vector")


def _texts(t):
    return t.chunks.where("content_text is not null").select("id", F.col("content_text").alias("text"))


def _asked(t):
    """The first line of every hundredth chunk as a query, with all its words."""
    line = F.regexp_extract("content_text", r"\S[^\n]*", 0)
    return t.chunks.where("id % 100 = 0 and content_text is not null").select(F.col("id").alias("query_id"), F.array_distinct(tx.words(line)).alias("terms"))


def _semantic(t, k=100):
    return retrieval.nearest(_queries(t), _base(t), k)


def _lexical(t, k=100):
    return retrieval.word_channel(_asked(t), _texts(t), k)


def _fused(t):
    return retrieval.fuse(_semantic(t), _lexical(t))


def _callers(t):
    return retrieval.caller_counts(t.chunks, t.symbols, t.call_graph)


def _boosted(t):
    return retrieval.boosted(_fused(t), t.chunks, t.files, _callers(t))


def flagship(t):
    return retrieval.diverse(_boosted(t), _texts(t), vectors=_base(t))


@P.add("knn_cosine", f"WITH {SEMANTIC_SQL} SELECT query_id, id, rank FROM sem WHERE rank <= 10")
def _(t):
    return _semantic(t, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@P.add("semantic_search", f"WITH {SEMANTIC_SQL} SELECT query_id, sem.id, round(sim, 6) AS similarity, f.path FROM sem JOIN chunks c ON c.id = sem.id JOIN files f ON f.id = c.file_id WHERE rank <= 10")
def _(t):
    hits = _semantic(t, 10).join(t.chunks.select("id", "file_id"), "id").join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return hits.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "path")


@P.add("knn_postfilter", f"""WITH {SEMANTIC_SQL} SELECT query_id, id FROM (SELECT query_id, sem.id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM sem JOIN chunks c ON c.id = sem.id JOIN files f ON f.id = c.file_id
    JOIN sources s ON s.id = f.source_id WHERE s.type = 'git' AND rank <= 100) WHERE r <= 10""")
def _(t):
    from pyspark.sql import Window

    allowed = t.sources.where("type = 'git'").select(F.col("id").alias("source_id"))
    hits = _semantic(t, 100).join(t.chunks.select("id", "file_id"), "id").join(t.files.select(F.col("id").alias("file_id"), "source_id"), "file_id").join(allowed, "source_id", "left_semi")
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 10").select("query_id", "id")


@P.add("dedup_cosine_sim", """
    WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(array_cosine_similarity(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64])), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
    SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS n FROM s) WHERE n <= 20""")
def _(t):
    base = t.embeddings.select(F.col("vec_id").alias("id"), F.lit("all").alias("model"), F.col("embedding").alias("vector"))
    near = retrieval.nearest(base.where("id % 100 = 0").withColumnRenamed("id", "query_id"), base, 20)
    return near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("similarity", 6).alias("similarity"))


@P.add("q_weighted_embedding", """
    WITH m AS (SELECT label, i, (2 * max(x) FILTER (WHERE vec_id = first_id) + coalesce(sum(x) FILTER (WHERE vec_id <> first_id), 0)) / (2 + count(*) - 1) AS y FROM (
        SELECT label, vec_id, min(vec_id) OVER (PARTITION BY label) AS first_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL)
    SELECT label, i, round(y / sqrt(sum(y * y) OVER (PARTITION BY label)), 5) AS y FROM m""")
def _(t):
    # Per dimension with partial sums: no label's vectors meet in one task.
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    long = t.embeddings.join(F.broadcast(first), "label").select("label", "vec_id", "first_id", F.posexplode("embedding").alias("i", "x"))
    y = long.groupBy("label", "i").agg(((F.sum(F.col("x").cast("double") * F.when(F.col("vec_id") == F.col("first_id"), 2.0).otherwise(1.0))) / (F.count("*") + 1)).alias("y"))
    norm = y.groupBy("label").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    return y.join(norm, "label").select("label", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("y") / F.col("norm"), 5).alias("y"))


@P.add("q_synonyms", f"WITH {SEMANTIC_SQL} SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM sem WHERE rank <= 10 AND sim >= 0.5) WHERE r <= 5")
def _(t):
    return _semantic(t, 10).where("similarity >= 0.5 and rank <= 5").select("query_id", "id")


@P.add("fts_channel", f"WITH {TERMS_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM lex")
def _(t):
    return _lexical(t).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@P.add("fts_rank_cd")
def _(t):
    return retrieval.cover_density(_texts(t), ["token", "frontier"]).select("id", F.round("rank", 6).alias("rank"))


@P.add("fts_dual_channel", f"""
    WITH tok AS (SELECT doc_id AS id, {sql_words('text')} AS ws FROM documents WHERE text IS NOT NULL),
    a AS (SELECT id, len(list_filter(ws, lambda w: w = 'chunks')) / (1 + ln(len(ws))) AS s FROM tok WHERE list_contains(ws, 'chunks')), b AS (SELECT id, 0.8::DOUBLE * len(list_filter(ws, lambda w: regexp_replace(w, 's$', '') = 'chunk')) / (1 + ln(len(ws))) AS s FROM tok WHERE len(list_filter(ws, lambda w: regexp_replace(w, 's$', '') = 'chunk')) > 0),
    u AS (SELECT * FROM (SELECT id, round(s, 9) AS s FROM a ORDER BY 2 DESC, 1 LIMIT 500) UNION ALL SELECT * FROM (SELECT id, round(s, 9) AS s FROM b ORDER BY 2 DESC, 1 LIMIT 500))
    SELECT id, round(max(s), 6) AS score FROM u GROUP BY 1""")
def _(t):
    tok = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), tx.words(F.col("text")).alias("ws"))

    def channel(keep, factor):
        n = F.size(F.filter("ws", keep))
        return tok.where(n > 0).select("id", F.round(factor * n / (1 + F.log(F.size("ws"))), 9).alias("s")).orderBy(F.col("s").desc(), "id").limit(500)

    both = channel(lambda w: w == "chunks", F.lit(1.0)).unionByName(channel(lambda w: F.regexp_replace(w, "s$", "") == "chunk", F.lit(0.8)))
    return both.groupBy("id").agg(F.round(F.max("s"), 6).alias("score"))


@P.add("rrf_fuse", f"WITH {SEMANTIC_SQL}, {TERMS_SQL}, {FUSED_SQL} SELECT query_id, id, round(fused, 9) AS fused FROM fu")
def _(t):
    return _fused(t).select("query_id", "id", F.round("fused", 9).alias("fused"))


@P.add("rrf_fuse_sql", f"WITH {SEMANTIC_SQL}, {TERMS_SQL} SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.id, l.id) AS id, round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 9) AS fused FROM (SELECT * FROM sem WHERE rank <= 60) s FULL JOIN (SELECT * FROM lex WHERE rank <= 60) l ON s.query_id = l.query_id AND s.id = l.id")
def _(t):
    return retrieval.fuse(_semantic(t, 60), _lexical(t, 60), overlap=1.0).select("query_id", "id", F.round("fused", 9).alias("fused"))


@P.add("boost_chunk_type", f"SELECT id, {TYPE_SQL} AS factor FROM chunks")
def _(t):
    return t.chunks.select("id", scoring.type_boost(F.col("chunk_type")).alias("factor"))


@P.add("boost_path", f"SELECT id, {PATH_SQL} AS factor FROM files")
def _(t):
    return t.files.select("id", scoring.path_boost(F.col("path")).alias("factor"))


@P.add("flt_path_class", f"SELECT {PATH_SQL} AS factor, count(*) AS files FROM files GROUP BY 1")
def _(t):
    return t.files.groupBy(scoring.path_boost(F.col("path")).alias("factor")).agg(F.count("*").alias("files"))


@P.add("boost_length", f"SELECT id, {LENGTH_SQL} AS factor FROM (SELECT id, strlen(content_text) AS b FROM chunks)")
def _(t):
    return t.chunks.select("id", scoring.length_boost(F.octet_length("content_text")).alias("factor"))


@P.add("boost_level", f"SELECT id, {LEVEL_SQL} AS factor FROM chunks")
def _(t):
    return t.chunks.select("id", scoring.level_boost(F.col("level")).alias("factor"))


@P.add("boost_domain", """SELECT c.id, CASE WHEN f.source_id = 1 THEN CASE coalesce(chunk_type, 'code') WHEN 'function' THEN 1.3 WHEN 'class' THEN 1.25 WHEN 'type' THEN 1.2 WHEN 'module' THEN 1.1 WHEN 'code' THEN 0.85 WHEN 'text' THEN 0.5 ELSE 1.0 END::DOUBLE
    * CASE coalesce(level, 0) WHEN 2 THEN 1.2 WHEN 1 THEN 1.1 WHEN 0 THEN 0.8 ELSE 1.0 END::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM chunks c JOIN files f ON f.id = c.file_id""")
def _(t):
    j = t.chunks.select("id", "file_id", "chunk_type", "level").join(t.files.select(F.col("id").alias("file_id"), "source_id"), "file_id")
    return j.select("id", scoring.domain_boost(F.col("chunk_type"), F.col("level"), F.coalesce(F.col("source_id") == 1, F.lit(False))).alias("factor"))


@P.add("boost_popularity", f"WITH {CALLERS_SQL} SELECT id, round(1 + 0.1::DOUBLE * log2(callers + 1), 6) AS factor FROM cal")
def _(t):
    return _callers(t).select("id", F.round(scoring.popularity_boost(F.col("callers")), 6).alias("factor"))


@P.add("hybrid_ranked", f"WITH {SEMANTIC_SQL}, {TERMS_SQL}, {FUSED_SQL}, {CALLERS_SQL}, {BOOST_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM bo")
def _(t):
    return _boosted(t).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@P.add("hybrid_search")
def _(t):
    return flagship(t)


@P.add("dedup_greedy")
def _(t):
    return retrieval.diverse(_boosted(t), _texts(t), limit=100, vectors=_base(t)).select("query_id", "id", "place")


@P.add("dedup_pairwise", f"""
    WITH {SEMANTIC_SQL}, lw AS (SELECT id, list_distinct(list_filter({sql_words('content_text')}, lambda w: length(w) > 2)) AS ws FROM chunks WHERE content_text IS NOT NULL)
    SELECT query_id, sem.id, round(CASE WHEN len(list_distinct(list_concat(a.ws, b.ws))) > 0 THEN len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) ELSE 0 END::DOUBLE, 6) AS jaccard
    FROM sem JOIN lw a ON a.id = query_id JOIN lw b ON b.id = sem.id WHERE rank <= 20""")
def _(t):
    words = _texts(t).select("id", retrieval.long_words(F.col("text")).alias("ws"))
    near = _semantic(t, 20).select("query_id", "id")
    j = near.join(words.select(F.col("id").alias("query_id"), F.col("ws").alias("a")), "query_id").join(words.select("id", F.col("ws").alias("b")), "id")
    return j.select("query_id", "id", F.round(retrieval.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def _closeness(t, kept):
    words = _texts(t).select("id", retrieval.joined_words(F.array_distinct(tx.words(F.col("text")))).alias("joined"))
    met = kept.select("query_id", "id").join(_asked(t), "query_id").join(words, "id").withColumn("ws", F.split("joined", tx.SEPARATOR))
    return met.select("query_id", "id", F.coalesce(F.try_divide(F.size(F.array_intersect("terms", "ws")), F.size("terms")), F.lit(0.0)).alias("closeness"))


@P.add("rerank")
def _(t):
    kept = cut(flagship(t))
    return retrieval.finished(kept, _closeness(t, kept))


@P.add("q_quality_tier", """SELECT doc_id, CASE WHEN kind = 'faq' THEN 'fast' ELSE 'balanced' END AS tier, coalesce(kind <> 'faq', true) AS reranks, CASE WHEN kind = 'faq' THEN 100 ELSE 300 END AS budget_ms FROM documents""")
def _(t):
    """A tier asked for by every document: some fast, some balanced, some by unknown names or none."""
    asked = F.when(F.col("kind") == "faq", "fast").when(F.col("kind") == "chat", "balanced").when(F.col("kind") == "issue", "deep")
    return t.documents.select("doc_id", retrieval.quality_tier(asked).alias("q")).select("doc_id", "q.*")


@P.add("search_fast")
def _(t):
    kept = flagship(t)
    return retrieval.finished(kept, _closeness(t, kept), "fast")


@P.add("parent_context", """
    SELECT c.id, coalesce(list_filter(string_split(substr(p.content_text, 1, 200), chr(10)), lambda l: regexp_matches(l, '^\\s*(pub |export |public |private |static |async )*(fn|def|class|struct|impl|function|func|interface|type)\\b'))[1], string_split(substr(p.content_text, 1, 200), chr(10))[1]) AS context
    FROM chunks c JOIN chunks p ON p.id = c.parent_chunk_id WHERE p.content_text IS NOT NULL""")
def _(t):
    return t.chunks.select("id", "parent_chunk_id").join(_parents(t), "parent_chunk_id").select("id", "context")


def _parents(t):
    p = t.chunks.where("content_text is not null").select(F.col("id").alias("parent_chunk_id"), F.split(F.substring("content_text", 1, 200), "\n").alias("lines"))
    declared = F.filter("lines", lambda line: line.rlike(r"^\s*(pub |export |public |private |static |async )*(fn|def|class|struct|impl|function|func|interface|type)\b"))
    return p.select("parent_chunk_id", F.coalesce(F.get(declared, 0), F.get("lines", 0)).alias("context"))


@P.add("symbol_expansion", f"""
    WITH {SEMANTIC_SQL}, top AS (SELECT query_id, id FROM sem WHERE rank <= 10), sy AS (SELECT DISTINCT id, file_id, line_start, line_end FROM symbols),
    src AS (SELECT DISTINCT t.query_id, s.id AS sid FROM top t JOIN chunks c ON c.id = t.id JOIN sy s ON s.file_id = c.file_id AND c.start_line <= s.line_start AND s.line_start <= c.end_line),
    tgt AS (SELECT DISTINCT query_id, callee_symbol_id AS sid FROM src JOIN call_graph g ON g.caller_symbol_id = src.sid WHERE callee_symbol_id IS NOT NULL),
    ch AS (SELECT DISTINCT query_id, c.id FROM tgt JOIN sy s ON s.id = tgt.sid JOIN chunks c ON c.file_id = s.file_id AND c.start_line <= s.line_start AND s.line_start <= c.end_line)
    SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM ch WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = ch.query_id AND top.id = ch.id)) WHERE r <= 10""")
def _(t):
    from pyspark.sql import Window

    top = _semantic(t, 10).select("query_id", "id")
    spans = t.chunks.select("id", "file_id", "start_line", "end_line")
    sy = t.symbols.select(F.col("id").alias("sid"), "file_id", "line_start").distinct()
    src = top.join(spans, "id").join(sy, "file_id").where("start_line <= line_start and line_start <= end_line").select("query_id", "sid").distinct()
    tgt = src.join(t.call_graph.where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("sid"), F.col("callee_symbol_id").alias("to")), "sid").select("query_id", F.col("to").alias("sid")).distinct()
    ch = tgt.join(sy, "sid").join(spans, "file_id").where("start_line <= line_start and line_start <= end_line").select("query_id", "id").distinct().join(top, ["query_id", "id"], "left_anti")
    return ch.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where("r <= 10").select("query_id", "id")


@P.add("keyword_search", f"SELECT id, CAST(n AS DOUBLE) AS rank FROM (SELECT id, len(list_filter({sql_words('content_text')}, lambda w: w = 'token')) AS n FROM chunks WHERE content_text IS NOT NULL) WHERE n > 0 ORDER BY n DESC, id LIMIT 20")
def _(t):
    return retrieval.cover_density(_texts(t), ["token"], by_length=False).orderBy(F.col("rank").desc(), "id").limit(20)


@P.add("embed_text")
def _(t):
    return retrieval.hashed_vectors(_texts(t)).select("id", "model", F.size("vector").alias("dimensions"))


@P.add("embed_reuse", """
    SELECT c.id, any_value(h.model) IS NOT NULL AS reusable FROM chunks c LEFT JOIN (SELECT DISTINCT o.content_hash, e.model FROM chunks o JOIN chunk_embeddings e ON e.chunk_id = o.id WHERE e.vector IS NOT NULL) h ON h.content_hash = c.content_hash GROUP BY c.id""")
def _(t):
    have = t.chunks.select(F.col("id").alias("chunk_id"), "content_hash").join(t.chunk_embeddings.where("vector is not null").select("chunk_id"), "chunk_id").select("content_hash").distinct().withColumn("have", F.lit(True))
    return t.chunks.select("id", "content_hash").join(have, "content_hash", "left").select("id", F.coalesce("have", F.lit(False)).alias("reusable"))


def _questions(t):
    """``query_id, line, words, terms, expanded, synonyms, vectors``: whatever either channel is asked, with what its words are expanded to.

    The first lines of ``_asked`` are trimmed and asked for by their own words and those they are expanded to (``terms``); wholly
    quoted ones by their own only. ``line`` is null, and there are no words, where only a vector is asked for.
    """
    line = F.regexp_replace(F.regexp_extract("content_text", r"\S[^\n]*", 0), r"\s+$", "")
    lines = t.chunks.where("id % 100 = 0 and content_text is not null").select(F.col("id").alias("query_id"), line.alias("line")).where("line <> ''").groupBy("query_id").agg(F.min("line").alias("line"))
    vectors = _queries(t).where(F.exists("vector", lambda x: x != 0)).select("query_id").distinct().withColumn("vectors", F.lit(True))
    quoted = scoring.quoted_phrase(F.col("line"))
    asked = lines.select("query_id", "line", quoted.isNotNull().alias("quoted"), F.coalesce(quoted, F.col("line")).alias("clean"))
    if {"name", "doc_comment"} <= set(t.symbols.columns):  # what groups of synonyms are found in
        near = retrieval.nearest_synonyms(asked.select("query_id", F.col("clean").alias("text")), enrich.synonym_groups(graphs._frequency(t)))
    else:
        near = t.spark.createDataFrame([], "query_id long, synonyms array<struct<term: string, aliases: array<string>>>")
    none = F.array().cast("array<struct<term: string, aliases: array<string>>>")
    asked = asked.join(near, "query_id", "left").withColumn("synonyms", F.coalesce("synonyms", none))
    asked = asked.withColumn("words", tx.words(F.col("clean"))).withColumn("full", tx.expanded_query(F.col("clean"), F.col("synonyms")))
    terms = F.array_distinct(F.when(F.col("quoted"), F.col("words")).otherwise(F.concat("words", tx.words(F.col("full")))))
    asked = asked.select("query_id", "line", "words", terms.alias("terms"), F.when(F.col("full") != F.col("clean"), F.col("full")).alias("expanded"), "synonyms")
    every = asked.join(vectors, "query_id", "full").withColumn("vectors", F.coalesce("vectors", F.lit(False)))
    return every.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).withColumn("synonyms", F.coalesce("synonyms", none))


def _shown(t, hits):
    """``hits`` with all that is told of a result. What the tables have no column for is null."""
    known = lambda df, *names: [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]
    files = t.files.select(F.col("id").alias("file_id"), "source_id", "path", *known(t.files, "language"))
    places = t.chunks.select("id", "file_id", "start_line", "end_line", "chunk_type", "level", *known(t.chunks, "context_prefix")).join(files, "file_id")
    shown = hits.join(places, "id").join(t.chunks.select("id", F.col("content_text").alias("content")), "id")
    if "parent_chunk_id" not in t.chunks.columns:
        return shown.withColumn("parent_context", F.lit(None).cast("string"))
    parents = t.chunks.where("chunk_type = 'function' and level = 2 and parent_chunk_id is not null").select("id", "parent_chunk_id").join(_parents(t), "parent_chunk_id")
    return shown.join(parents.select("id", F.nullif(F.trim("context"), F.lit("")).alias("parent_context")), "id", "left")


@P.add("response_envelope")
def _(t):
    """One row for every query, also where nothing is found: what a search answers.

    ``found`` counts the candidates of both channels, before weak and near-duplicate ones drop out; ``total`` is how many
    ``results`` are shown, in the order of the default tier, which reranks. ``mode`` says what the search could do: without a
    vector for the query there is one channel, and without words nothing to rerank by. No time is told, as queries run together.
    """
    asked = cut(_questions(t))
    fused = cut(retrieval.fuse(_semantic(t), retrieval.word_channel(asked.where("line is not null").select("query_id", "terms"), _texts(t), 100)))
    kept = cut(retrieval.diverse(retrieval.boosted(fused, t.chunks, t.files, _callers(t)), _texts(t), vectors=_base(t)))
    closeness, worded = _closeness(t, kept), asked.where(F.size("words") > 0).select("query_id")
    hits = retrieval.finished(kept.join(worded, "query_id", "left_semi"), closeness).unionByName(retrieval.finished(kept.join(worded, "query_id", "left_anti"), closeness, "fast"))
    told = _shown(t, hits).join(asked.select("query_id", "line"), "query_id", "left")
    entry = F.struct(
        "place", "id", F.round("score", 6).alias("score"), tx.location(F.col("path"), F.col("start_line"), F.col("end_line")).alias("location"), "path", "start_line", "end_line", "source_id", "language",
        "chunk_type", "level", "context_prefix", "parent_context", tx.snippet(F.col("content"), F.col("line")).alias("snippet"), tx.truncated(F.col("content")).alias("content"),
    )
    results = told.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("results"), F.count("*").alias("total"))
    found = fused.groupBy("query_id").agg(F.count("*").alias("found"))
    every = asked.join(found, "query_id", "left").join(results, "query_id", "left").withColumns({"results": F.coalesce("results", F.lit("[]")), "total": F.coalesce("total", F.lit(0).cast("long")), "found": F.coalesce("found", F.lit(0).cast("long"))})
    ranks = F.size("words") > 0
    return every.select(
        "query_id", retrieval.envelope_context(F.col("found"), F.col("total")).alias("llm_context"), "results", "total", "found", retrieval.search_mode(F.col("vectors"), ranks).alias("mode"),
        F.lit(retrieval.DEFAULT_TIER).alias("quality_tier"), (ranks & (F.col("total") > 0)).alias("reranked"), F.col("expanded").alias("expanded_query"), F.transform("synonyms", lambda s: s["term"]).alias("expansion_terms"),
    )


# --- exact boolean retrieval ------------------------------------------------------------------------------------------

EXACT_QUERY = 'frontier (token OR cursor) -digest'


def _bindings(t):
    return t.chunks.where("content_text is not null").select(F.col("file_id").alias("occurrence_id"), F.row_number().over(_place()).alias("ordinal"), F.col("id").alias("doc_id"), F.when(F.col("chunk_type") == "function", 1.2).otherwise(1.0).alias("role_weight"))


def _place():
    from pyspark.sql import Window

    return Window.partitionBy("file_id").orderBy("start_line", "id")


def _documents(t):
    return t.chunks.where("content_text is not null").select(F.col("id").alias("doc_id"), F.col("content_text").alias("text"))


COMPONENTS_SQL = f"""c AS (SELECT file_id AS o, id, CASE WHEN chunk_type = 'function' THEN 1.2 ELSE 1.0 END::DOUBLE AS w, {sql_words('content_text')} AS ws FROM chunks WHERE content_text IS NOT NULL),
    vw AS (SELECT o, sum(len(ws)) AS vl FROM c GROUP BY 1), st AS (SELECT count(*) AS n, avg(vl) AS a FROM vw),
    tf AS (SELECT o, id, w, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM c, (VALUES ('frontier'), ('token'), ('cursor'), ('digest')) AS q(term)),
    df AS (SELECT term, count(DISTINCT o) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY 1),
    ts AS (SELECT o, term, max(w * tf / (tf + 0.5 + 0.5 * vl / a)) * ln(1 + (n + 1) / (any_value(df) + 1)) AS s FROM tf JOIN vw USING (o) JOIN df USING (term), st WHERE tf > 0 GROUP BY o, term, n),
    hit AS (SELECT o, sum(s) FILTER (WHERE term <> 'digest') AS score, list_sort(list(term) FILTER (WHERE term <> 'digest')) AS matched FROM ts GROUP BY o
        HAVING bool_or(term = 'frontier') AND bool_or(term IN ('token', 'cursor')) AND NOT bool_or(term = 'digest'))"""


@P.add("exact_search", f"WITH {COMPONENTS_SQL} SELECT o AS occurrence_id, round(score, 6) AS score, matched, (SELECT count(*) FROM hit) AS total FROM hit")
def _(t):
    return exact.search(EXACT_QUERY, _bindings(t), _documents(t), limit=None).select("occurrence_id", F.round("score", 6).alias("score"), "matched", "total")


@P.add("ex_order", f"WITH {COMPONENTS_SQL} SELECT o AS occurrence_id FROM hit ORDER BY round(score, 9) DESC, o LIMIT 20")
def _(t):
    hits = exact.search(EXACT_QUERY, _bindings(t), _documents(t), limit=None)
    return hits.orderBy(F.round("score", 9).desc(), "occurrence_id").limit(20).select("occurrence_id")


@P.add("ex_view_stats", f"SELECT file_id AS occurrence_id, CAST(sum(len({sql_words('content_text')})) AS BIGINT) AS view_length, count(*) AS components FROM chunks WHERE content_text IS NOT NULL GROUP BY 1")
def _(t):
    return t.chunks.where("content_text is not null").groupBy(F.col("file_id").alias("occurrence_id")).agg(F.sum(F.size(tx.words(F.col("content_text")))).alias("view_length"), F.count("*").alias("components"))


@P.add("ex_corpus_stats", f"SELECT count(*) AS views, round(avg(n), 6) AS average FROM (SELECT file_id, sum(len({sql_words('content_text')})) AS n FROM chunks WHERE content_text IS NOT NULL GROUP BY 1)")
def _(t):
    per = t.chunks.where("content_text is not null").groupBy("file_id").agg(F.sum(F.size(tx.words(F.col("content_text")))).alias("n"))
    return per.agg(F.count("*").alias("views"), F.round(F.avg("n"), 6).alias("average"))


@P.add("ex_df", f"SELECT term, count(DISTINCT file_id) AS df FROM (SELECT file_id, unnest({sql_words('content_text')}) AS term FROM chunks WHERE content_text IS NOT NULL) GROUP BY 1")
def _(t):
    pairs = t.chunks.select("file_id", F.explode(F.array_distinct(tx.words(F.col("content_text")))).alias("term")).distinct()
    return pairs.groupBy("term").agg(F.count("*").alias("df"))


@P.add("ex_phrase", "SELECT DISTINCT file_id AS occurrence_id FROM chunks WHERE contains(chr(31) || array_to_string(" + sql_words("content_text") + ", chr(31)) || chr(31), chr(31) || 'for' || chr(31) || 'several' || chr(31) || 'threads' || chr(31)) OR contains(chr(31) || array_to_string(" + sql_words("content_text") + ", chr(31)) || chr(31), chr(31) || 'several' || chr(31) || 'threads' || chr(31))")
def _(t):
    return exact.search('"several threads"', _bindings(t), _documents(t), limit=None).select("occurrence_id")


@P.add("ex_exact", f"SELECT DISTINCT file_id AS occurrence_id FROM chunks WHERE list_contains(list_filter({sql_words('content_text')}, lambda w: regexp_matches(w, '_|\\p{{N}}')), 'password_hash')")
def _(t):
    return exact.search("id:password_hash", _bindings(t), _documents(t), limit=None).select("occurrence_id")


@P.add("ex_boolean", f"WITH {COMPONENTS_SQL} SELECT o AS occurrence_id FROM hit")
def _(t):
    return exact.search(exact.parse("(frontier AND (token OR cursor)) AND NOT digest"), _bindings(t), _documents(t), limit=None).select("occurrence_id")


@P.add("ex_total", f"WITH {COMPONENTS_SQL} SELECT (SELECT count(*) FROM hit) AS total, (SELECT count(*) FROM vw) AS scored")
def _(t):
    hits = exact.search(EXACT_QUERY, _bindings(t), _documents(t), limit=None).agg(F.count("*").alias("total"))
    return hits.crossJoin(_bindings(t).select("occurrence_id").distinct().agg(F.count("*").alias("scored")))


@P.add("ex_stage_scores", f"WITH {COMPONENTS_SQL} SELECT o AS occurrence_id, round(score + coalesce(b, 0), 6) AS score FROM hit LEFT JOIN (SELECT file_id AS o, count(DISTINCT name) * 0.01::DOUBLE AS b FROM symbols GROUP BY 1) USING (o)")
def _(t):
    stages = t.symbols.groupBy(F.col("file_id").alias("occurrence_id")).agg((F.countDistinct("name") * 0.01).alias("bonus"))
    return exact.search(EXACT_QUERY, _bindings(t), _documents(t), limit=None, stages=stages).select("occurrence_id", F.round("score", 6).alias("score"))


@P.add("ex_score_component_norm")
def _(t):
    return exact.search(EXACT_QUERY, _bindings(t), _documents(t), limit=None, by_component=True).select("occurrence_id", F.round("score", 6).alias("score"))


@P.add("ex_scope", "SELECT c.id FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.created_at <= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND starts_with(f.path, 'src/') AND coalesce(c.level, 1) = 1")
def _(t):
    f = t.files.where("created_at <= timestamp '2025-06-01 00:00:00 UTC' and startswith(path, 'src/')").select(F.col("id").alias("file_id"))
    return t.chunks.where("coalesce(level, 1) = 1").join(f, "file_id", "left_semi").select("id")


@P.add("ex_hit_id", """SELECT c.id, sha256(unhex(lpad(lower(to_hex(strlen(f.path))), 16, '0') || lower(hex(encode(f.path))) || lpad(lower(to_hex(strlen(lower(hex(f.hash))))), 16, '0') || lower(hex(encode(lower(hex(f.hash))))) || lpad(lower(to_hex(strlen(CAST(c.start_line AS VARCHAR)))), 16, '0') || lower(hex(encode(CAST(c.start_line AS VARCHAR)))))) AS hit_id
    FROM chunks c JOIN files f ON f.id = c.file_id WHERE c.start_line IS NOT NULL""")
def _(t):
    f = t.files.select(F.col("id").alias("file_id"), "path", F.lower(F.hex("hash")).alias("hash"))
    return t.chunks.where("start_line is not null").select("id", "file_id", "start_line").join(f, "file_id").select("id", tx.framed_hash(F.col("path"), F.col("hash"), F.col("start_line").cast("string")).alias("hit_id"))


@P.add("ex_unbound_guard", "SELECT count(*) AS unbound FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = c.file_id)")
def _(t):
    return t.chunks.select("file_id").join(t.files.select(F.col("id").alias("file_id")), "file_id", "left_anti").agg(F.count("*").alias("unbound"))


@P.add("ex_coverage_evidence", f"SELECT file_id AS occurrence_id, CAST(sum(len(list_filter({sql_words('content_text')}, lambda w: w = 'frontier'))) AS BIGINT) AS support FROM chunks WHERE content_text IS NOT NULL GROUP BY 1 HAVING support > 0")
def _(t):
    n = F.size(F.filter(tx.words(F.col("content_text")), lambda w: w == "frontier"))
    return t.chunks.where("content_text is not null").groupBy(F.col("file_id").alias("occurrence_id")).agg(F.sum(n).alias("support")).where("support > 0")


@P.add("ex_segment_proof", "SELECT id, sha256(content_text) = lower(hex(content_hash)) AS proven FROM chunks")
def _(t):
    return t.chunks.select("id", (F.sha2("content_text", 256) == F.lower(F.hex("content_hash"))).alias("proven"))


@P.add("ex_doc_conjunction", f"SELECT id FROM files WHERE list_has_all({sql_words('content_text')}, ['frontier', 'token', 'cursor'])")
def _(t):
    ws = tx.words(F.col("content_text"))
    return t.files.where(F.array_contains(ws, "frontier") & F.array_contains(ws, "token") & F.array_contains(ws, "cursor")).select("id")


@P.add("ex_presence", f"""WITH s AS (SELECT DISTINCT file_id FROM chunks), m AS (SELECT DISTINCT file_id FROM chunks WHERE list_has_all({sql_words('content_text')}, ['frontier', 'token']))
    SELECT id FROM files f WHERE id IN (SELECT file_id FROM m) OR (id NOT IN (SELECT file_id FROM s) AND list_has_all({sql_words('content_text')}, ['frontier', 'token']))""")
def _(t):
    both = lambda c: F.array_contains(tx.words(F.col(c)), "frontier") & F.array_contains(tx.words(F.col(c)), "token")
    in_segment = t.chunks.where(both("content_text")).select(F.col("file_id").alias("id")).distinct()
    whole = t.files.where(both("content_text")).select("id").join(t.chunks.select(F.col("file_id").alias("id")), "id", "left_anti")
    return in_segment.join(t.files.select("id"), "id", "left_semi").unionByName(whole)


@P.add("ex_segment_rank", f"""SELECT file_id AS occurrence_id, round(max(len(list_filter(ws, lambda w: w = 'frontier')) / (1 + ln(len(ws)))), 6) AS rank FROM (SELECT file_id, {sql_words('content_text')} AS ws FROM chunks WHERE content_text IS NOT NULL) WHERE list_contains(ws, 'frontier') GROUP BY 1""")
def _(t):
    ws = t.chunks.select(F.col("file_id").alias("occurrence_id"), tx.words(F.col("content_text")).alias("ws")).where(F.array_contains("ws", "frontier"))
    return ws.groupBy("occurrence_id").agg(F.round(F.max(F.size(F.filter("ws", lambda w: w == "frontier")) / (1 + F.log(F.size("ws")))), 6).alias("rank"))


@P.add("ex_resolve_hit", """SELECT c.id AS old_id, coalesce(min(n.id), -1) AS target, count(n.id) AS targets FROM chunks c LEFT JOIN chunks n ON n.content_hash = c.content_hash AND n.id > c.id GROUP BY 1""")
def _(t):
    n = t.chunks.select("content_hash", F.col("id").alias("new_id"))
    j = t.chunks.select(F.col("id").alias("old_id"), "content_hash").join(n, "content_hash", "left")
    later = F.when(F.col("new_id") > F.col("old_id"), F.col("new_id"))
    return j.groupBy("old_id").agg(F.coalesce(F.min(later), F.lit(-1)).alias("target"), F.count(later).alias("targets"))


@P.add("ex_explain", f"WITH {COMPONENTS_SQL}, top AS (SELECT o FROM hit ORDER BY round(score, 9) DESC, o LIMIT 20) SELECT ts.o AS occurrence_id, term, round(s, 6) AS part FROM ts JOIN top USING (o) WHERE term <> 'digest'")
def _(t):
    parts = None
    for term in ("frontier", "token", "cursor"):
        one = exact.search(exact.Term(term), _bindings(t), _documents(t), limit=None).select("occurrence_id", F.lit(term).alias("term"), F.round("score", 6).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    top = exact.search(EXACT_QUERY, _bindings(t), _documents(t), limit=None).orderBy(F.round("score", 9).desc(), "occurrence_id").limit(20)
    return parts.join(top.select("occurrence_id"), "occurrence_id", "left_semi")


@P.add("ex_binding", f"SELECT file_id AS occurrence_id, id AS doc_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS ordinal, CASE WHEN chunk_type = 'function' THEN 1.2 ELSE 1.0 END::DOUBLE AS role_weight FROM chunks WHERE content_text IS NOT NULL")
def _(t):
    return _bindings(t).select("occurrence_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "role_weight")


@P.add("ex_term_score", f"WITH {COMPONENTS_SQL} SELECT o AS occurrence_id, term, round(s, 6) AS score FROM ts WHERE term <> 'digest'")
def _(t):
    parts = None
    for term in ("frontier", "token", "cursor"):
        one = exact.search(exact.Term(term), _bindings(t), _documents(t), limit=None).select("occurrence_id", F.lit(term).alias("term"), F.round("score", 6).alias("score"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@P.add("ex_best_component", f"""WITH {COMPONENTS_SQL} SELECT o AS occurrence_id, id AS doc_id FROM (SELECT o, id, row_number() OVER (PARTITION BY o ORDER BY round(w * tf / (tf + 0.5 + 0.5 * vl / a), 9) DESC, id) AS n FROM tf JOIN vw USING (o), st WHERE term = 'frontier' AND tf > 0) WHERE n = 1""")
def _(t):
    from pyspark.sql import Window

    ws = tx.words(F.col("text"))
    parts = _bindings(t).join(_documents(t), "doc_id").select("occurrence_id", "doc_id", "role_weight", F.size(ws).alias("length"), F.size(F.filter(ws, lambda w: w == "frontier")).alias("tf"))
    views = parts.groupBy("occurrence_id").agg(F.sum("length").alias("vl"))
    scored = parts.where("tf > 0").join(views, "occurrence_id").crossJoin(F.broadcast(views.agg(F.avg("vl").alias("a"))))
    score = F.round(F.col("role_weight") * F.col("tf") / (F.col("tf") + 0.5 + 0.5 * F.col("vl") / F.col("a")), 9)
    best = Window.partitionBy("occurrence_id").orderBy(score.desc(), "doc_id")
    return scored.withColumn("n", F.row_number().over(best)).where("n = 1").select("occurrence_id", "doc_id")


@P.add("ex_active", f"""WITH {COMPONENTS_SQL} SELECT f.source_id, count(*) AS hits, round(max(score), 6) AS best FROM hit JOIN files f ON f.id = hit.o JOIN sources s ON s.id = f.source_id GROUP BY 1""")
def _(t):
    hits = exact.search(EXACT_QUERY, _bindings(t), _documents(t), limit=None).join(t.files.select(F.col("id").alias("occurrence_id"), "source_id"), "occurrence_id").join(t.sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return hits.groupBy("source_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"))


@P.add("ex_copied_recall", f"SELECT f.id FROM files f WHERE list_contains({sql_words('content_text')}, 'frontier') AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = f.id AND list_contains({sql_words('c.content_text')}, 'frontier'))")
def _(t):
    """Files that hold the word as a whole although none of their pieces does."""
    pieces = t.chunks.where(F.array_contains(tx.words(F.col("content_text")), "frontier")).select(F.col("file_id").alias("id"))
    return t.files.where(F.array_contains(tx.words(F.col("content_text")), "frontier")).select("id").join(pieces, "id", "left_anti")


@P.add("degrade_mode", "SELECT * FROM (VALUES (true, true, 'full'), (false, true, 'no-vectors'), (true, false, 'no-rerank'), (false, false, 'words-only')) AS x(vectors, reranker, mode)")
def _(t):
    return t.spark.createDataFrame([(v, r, retrieval.degraded_mode(v, r)) for v in (True, False) for r in (True, False)], "vectors boolean, reranker boolean, mode string")
