"""Hybrid retrieval in batches: vector and word channels, fusion, boosts, near-duplicates, reranking."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core.storage import cut
from quarrylight.functions import scoring
from quarrylight.functions import text as tx

BLOCK = 2000
#: How many similarities are held at once.
CELLS = 4_000_000
#: Stands for a null id while texts are packed.
NO_ID = -(1 << 63)
#: Scores are rounded to nine digits before they are ranked; scores this close may change places.
ROUNDED = 2e-9
#: In how many parts at most the postings meet each block of queries.
PARTS = 16


def _packed(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``model, size, ids, vectors``: blocks of at most ``block`` vectors of one model and length, one after another; null and all-zero ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[v is not None and len(v) > 0 for v in b["vector"]]]
            b = b.assign(model=b["model"].fillna(""), size=[len(v) for v in b["vector"]])
            for (model, size), part in b.groupby(["model", "size"]):
                v = np.stack(part["vector"].to_numpy()).astype(np.float64)
                length = np.linalg.norm(v, axis=1)
                ids, v = part["id"].to_numpy()[length > 0], v[length > 0] / length[length > 0, None]
                starts = range(0, len(ids), block)
                yield pd.DataFrame({"model": model, "size": size, "ids": [ids[a : a + block] for a in starts], "vectors": [v[a : a + block].tobytes() for a in starts]})

    return rows.select(F.col(key).cast("long").alias("id"), "model", "vector").mapInPandas(run, "model string, size int, ids array<long>, vectors binary")


def nearest(queries: DataFrame, base: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, id, similarity, rank``: the exact ``k`` most similar rows of every query, within its model.

    Both tables have ``id`` (``query_id`` for queries), ``model`` and ``vector``; a row isn't its own neighbour. The
    stated queries meet all rows block by block on the executors; each pair of blocks gives its best, and these are ranked.
    """

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                asked, ids = np.asarray(r.asked), np.asarray(r.ids)
                left, right = (np.frombuffer(x, np.float64).reshape(-1, r.size) for x in (r.asked_vectors, r.vectors))
                step = max(1, CELLS // len(ids))
                for start in range(0, len(asked), step):
                    some = asked[start : start + step]
                    sims = np.round(left[start : start + step] @ right.T, 9)
                    sims[some[:, None] == ids[None, :]] = -2
                    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k] if sims.shape[1] > k else np.full(len(sims), -1.5)
                    rows, columns = np.nonzero(sims >= np.maximum(least, -1.5)[:, None])
                    found = sims[rows, columns]
                    order = np.lexsort((ids[columns], -found, rows))
                    rows, columns, found = rows[order], columns[order], found[order]
                    begins = np.searchsorted(rows, np.arange(len(some)))
                    kept = np.arange(len(rows)) - begins[rows] < k
                    yield pd.DataFrame({"query_id": some[rows[kept]], "id": ids[columns[kept]], "similarity": found[kept]})

    # Queries come together by their hashes, which keeps few blocks where they are few.
    asked = _packed(queries.where("vector is not null").repartition("query_id"), "query_id", block).select("model", "size", F.col("ids").alias("asked"), F.col("vectors").alias("asked_vectors"))
    pairs = _packed(base, "id", 10 * block).join(asked.hint("shuffle_replicate_nl"), ["model", "size"])
    found = pairs.mapInPandas(best, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(texts: DataFrame) -> DataFrame:
    """``id, term, tf, length``."""
    tokens = texts.select("id", tx.words(F.col("text")).alias("ws"))
    return tokens.select("id", F.size("ws").alias("length"), F.explode("ws").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _word_blocks(texts: DataFrame, most: int, merged: bool = False) -> DataFrame:
    """``texts, words, ids, packed``: blocks of about ``most`` words, each an inverted index of its texts; those without words are left out.

    ``packed`` holds the terms, the lengths of the texts, and term by term how many texts have it, which and how often.
    ``merged``: texts of one id are one text.
    """
    tokens = texts.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), tx.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    if merged:
        tokens = tokens.groupBy("id").agg(F.max(F.size("ws")).alias("length"), F.count("*").cast("int").alias("texts"), F.sum(F.size("ws")).alias("words"), F.flatten(F.collect_list("ws")).alias("ws"))
    else:
        tokens = tokens.select("id", F.size("ws").alias("length"), F.lit(1).alias("texts"), F.size("ws").cast("long").alias("words"), "ws")

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, lengths, n, words = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(4))
        coded = pa.concat_arrays([p.column(4).flatten() for p in parts]).dictionary_encode()
        sizes = np.concatenate([p.column(4).value_lengths().to_numpy() for p in parts])
        places = coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
        places, tf = np.unique(places, return_counts=True)
        of, text = np.divmod(places, len(ids))
        df = np.bincount(of, minlength=len(coded.dictionary))
        steps = np.diff(text, prepend=0)  # small numbers, which pack well
        parts = ["\n".join(coded.dictionary.to_pylist()).encode(), lengths.astype(np.int32).tobytes(), *(x.astype(np.int32).tobytes() for x in (df, steps, tf))]
        packed = [zlib.compress(x, 1) for x in parts]
        return pa.RecordBatch.from_arrays([pa.array([n.sum()], pa.int64()), pa.array([words.sum()], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([packed], pa.list_(pa.binary()))], ["texts", "words", "ids", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            upto = np.cumsum(b.column(4).value_lengths().to_numpy())
            start = 0
            while start < b.num_rows:
                stop = int(np.searchsorted(upto, most - size + (upto[start - 1] if start else 0))) + 1
                held.append(b.slice(start, stop - start))
                size += int(upto[min(stop, b.num_rows) - 1] - (upto[start - 1] if start else 0))
                start = stop
                if size >= most:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return tokens.mapInArrow(run, "texts long, words long, ids array<long>, packed array<binary>")


def _terms(packed: np.ndarray) -> list[str]:
    return zlib.decompress(packed[0]).decode().split("\n")


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int32).astype(np.int64)


def _leading(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of all that can be among the ``k`` best of their query once scores are rounded, best first by query."""
    order = np.lexsort((ids, -scores, query))
    q, s, at = query[order], scores[order], np.arange(len(order))
    new = np.diff(q, prepend=-1) != 0
    begins = np.maximum.accumulate(np.where(new, at, 0))
    last = np.minimum(begins + k - 1, len(order) - 1)
    least = np.where(q[last] == q, s[last], 0.0)
    equal = at - np.maximum.accumulate(np.where(new | (np.diff(s, prepend=0) != 0), at, 0))
    return order[(s >= least - ROUNDED) & (equal < k)]


def word_channel(queries: DataFrame, texts: DataFrame, k: int, block: int = 2000, most: int = 2_000_000) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best texts of every query by its words (any of them).

    ``queries``: query_id, terms. A term's weight falls with the texts it is in. The texts are tokenised once and packed
    into blocks of postings. Blocks of queries meet all of these on the executors: a task scores every text that
    has any of a query's words and keeps the best, so what moves are these, not all pairs of queries and texts.
    """
    packed = cut(_word_blocks(texts, most))
    if not packed.select(F.explode("ids").alias("id")).groupBy("id").count().where("count > 1").isEmpty():
        packed = cut(_word_blocks(texts, most, merged=True))
    stats = packed.agg(F.sum("texts").alias("n"), (F.sum("words") / F.sum("texts")).alias("average"))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["packed"]:
                yield pd.DataFrame({"term": _terms(p), "df": _numbers(p[2])})

    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term <> ''")
    df = packed.select("packed").mapInPandas(counts, "term string, df long").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats)).select(F.col("query_id").cast("long").alias("query_id"), "term", F.log(1 + (F.col("n") + 1) / (F.col("df") + 1)).alias("weight"), "average")

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"average": [rows["average"].iloc[0]], "asked": [rows["query_id"].to_numpy()], "terms": [rows["term"].to_numpy()], "weights": [rows["weight"].to_numpy()]})

        held, n = [], 0
        for b in batches:
            # Rows are sorted by query; a query stays in one block.
            for _, rows in b.groupby("query_id"):
                if n >= block and rows["query_id"].iloc[0] != held[-1]["query_id"].iloc[0]:
                    yield row(pd.concat(held))
                    held, n = [], 0
                held.append(rows)
                n += 1
        if held:
            yield row(pd.concat(held))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # By the first query of a block of queries: which queries, the least score that counts, and what was found.
        found: dict[int, list] = {}
        last, postings = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if last != r.ids[0]:  # each block of texts comes with one block of queries after another
                    last = r.ids[0]
                    ids, (lengths, df, steps, tf) = np.asarray(r.ids), (_numbers(x) for x in r.packed[1:])
                    ends = np.cumsum(df)
                    docs = np.cumsum(steps)
                    postings = {t: (e - d, e) for t, d, e in zip(_terms(r.packed), df.tolist(), ends.tolist(), strict=True)}
                    scores = np.zeros(len(ids))
                names, begins = np.unique(r.asked, return_index=True)
                _, least, kept = state = found.setdefault(int(names[0]), [names, np.zeros(len(names)), []])
                parts: dict[str, np.ndarray] = {}
                for q, (begin, end) in enumerate(zip(begins, [*begins[1:], len(r.asked)], strict=True)):
                    scores[:] = 0
                    for term, weight in zip(r.terms[begin:end], r.weights[begin:end], strict=True):
                        if (at := postings.get(term)) is None:
                            continue
                        place = slice(*at)
                        if term not in parts:
                            parts[term] = weight * tf[place] / (tf[place] + 0.5 + 0.5 * lengths[docs[place]] / r.average)
                        scores[docs[place]] += parts[term]
                    hit = np.flatnonzero(scores > max(least[q] - ROUNDED, 0))
                    if len(hit) > k:
                        hit = hit[scores[hit] >= np.partition(scores[hit], len(hit) - k)[len(hit) - k] - ROUNDED]
                    if len(hit):
                        kept.append((np.full(len(hit), q), ids[hit], scores[hit]))
                if sum(len(x[0]) for x in kept) > 4 * k * len(names):
                    state[2] = [_cleared(kept, least, k)]
        for names, least, kept in found.values():
            if kept:
                q, id_, score = _cleared(kept, least, k)
                yield pd.DataFrame({"query_id": names[q], "id": id_, "score": score})

    blocks = weighed.repartition("query_id").sortWithinPartitions("query_id", "term").mapInPandas(together, "average double, asked array<long>, terms array<string>, weights array<double>")
    # Few parts of the texts, as each gives its own best for every query.
    pairs = packed.select("ids", "packed").coalesce(PARTS).crossJoin(blocks.hint("shuffle_replicate_nl"))
    scored = pairs.mapInPandas(best, "query_id long, id long, score double").select("query_id", F.nullif("id", F.lit(NO_ID)).alias("id"), F.round("score", 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cleared(kept: list[tuple], least: np.ndarray, k: int) -> tuple:
    """What was found without all that is certainly beyond the ``k`` best; ``least`` gets the score that now counts."""
    q, ids, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
    lead = _leading(q, ids, scores, k)
    q, ids, scores = q[lead], ids[lead], scores[lead]
    names, begins, n = np.unique(q, return_index=True, return_counts=True)
    full = n >= k
    least[names[full]] = scores[begins[full] + k - 1]
    return q, ids, scores


def fuse(semantic: DataFrame, lexical: DataFrame, weight: Column | float = 1.0, k: int = 60, overlap: float = 1.5) -> DataFrame:
    """``query_id, id, fused, semantic_rank, lexical_rank``: reciprocal ranks of both channels, more where both agree."""
    a = semantic.select("query_id", "id", F.col("rank").alias("semantic_rank"))
    b = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    weight = F.lit(weight) if isinstance(weight, int | float) else weight
    score = scoring.reciprocal_rank_sum(F.col("semantic_rank"), F.col("lexical_rank"), weight, k, overlap)
    return a.join(b, ["query_id", "id"], "full").select("query_id", "id", score.alias("fused"), "semantic_rank", "lexical_rank")


def caller_counts(chunks: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``id, callers``: calls to the symbols that contain a chunk's first line, for chunks of code units."""
    called = calls.where("callee_symbol_id is not null").dropDuplicates(["id"]).groupBy(F.col("callee_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    spans = symbols.select(F.col("id").alias("symbol_id"), "file_id", "line_start", "line_end").distinct().join(called, "symbol_id")
    units = chunks.where("chunk_type in ('function', 'class', 'type')").select("id", "file_id", "start_line")
    return units.join(spans, "file_id").where("line_start <= start_line and start_line <= line_end").groupBy("id").agg(F.sum("n").alias("callers"))


def boosted(candidates: DataFrame, chunks: DataFrame, files: DataFrame, callers: DataFrame, floor: float = 0.005) -> DataFrame:
    """``query_id, id, score, file_id, source_id, path, rank``: fused candidates weighed by what they are; weak ones drop out."""
    # What a chunk or a file is weighed by is worked out once for each, not for every query that finds it.
    by_chunk = scoring.type_boost(F.col("chunk_type")) * scoring.length_boost(F.coalesce(F.octet_length("content_text"), F.lit(0))) * scoring.level_boost(F.col("level"))
    weighed = chunks.select("id", "file_id", by_chunk.alias("by_chunk")).join(files.select(F.col("id").alias("file_id"), "source_id", "path", scoring.path_boost(F.col("path")).alias("by_path")), "file_id").join(callers, "id", "left")
    hydrated = candidates.join(weighed, "id")
    score = F.col("fused") * F.col("by_chunk") * F.col("by_path") * scoring.popularity_boost(F.coalesce("callers", F.lit(0)))
    scored = hydrated.select("query_id", "id", F.round(score, 9).alias("score"), "file_id", "source_id", "path").where(F.col("score") >= floor)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words longer than two characters; 0 where neither has one."""
    size = F.size(F.array_union(a, b))
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / size).otherwise(F.lit(0.0))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(tx.words(text), lambda w: F.length(w) > 2))


def joined_words(words: Column) -> Column:
    """Words as one text with separators, which moves in less than half the bytes of a list."""
    return F.array_join(words, tx.SEPARATOR)


def diverse(ranked: DataFrame, texts: DataFrame, limit: int = 20, per_source: int = 8, per_file: int = 3, alike: float = 0.4, pool: int = 100, vectors: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score, place``: candidates kept in order unless their source or file has enough, or a kept one is alike.

    Alike are candidates that share more than ``alike`` of their words or, where both have one of the ``vectors`` (id,
    model, vector) of one model, whose vectors are closer than 0.95, 0.92 or 0.88 (texts under 400, up to 1,200 and
    more characters). At most ``pool`` candidates of a query are looked at, as retrieval asks for no more.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        kept, sources, files, seen = [], {}, {}, []
        for r in rows.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False):
            words = set(r.words.split(tx.SEPARATOR)) - {""}
            if sources.get(r.source_id, 0) >= per_source or files.get(r.file_id, 0) >= per_file:
                continue
            unit = None
            if r.vector is not None and len(r.vector) and np.linalg.norm(r.vector) > 0:
                unit = np.asarray(r.vector, np.float64) / np.linalg.norm(r.vector)
            close = 0.95 if r.size < 400 else 0.92 if r.size <= 1200 else 0.88
            if any(words | w and len(words & w) / len(words | w) > alike or unit is not None and u is not None and m == r.model and len(u) == len(unit) and float(u @ unit) > close for w, u, m in seen):
                continue
            kept.append((r.query_id, r.id, r.score, len(kept) + 1))
            sources[r.source_id], files[r.file_id] = sources.get(r.source_id, 0) + 1, files.get(r.file_id, 0) + 1
            seen.append((words, unit, r.model))
            if len(kept) == limit:
                break
        return pd.DataFrame(kept, columns=["query_id", "id", "score", "place"])

    pooled = ranked.where(F.col("rank") <= pool).join(texts.select("id", joined_words(long_words(F.coalesce("text", F.lit("")))).alias("words"), F.length(F.coalesce("text", F.lit(""))).alias("size")), "id")
    if vectors is None:
        pooled = pooled.withColumn("model", F.lit(None).cast("string")).withColumn("vector", F.lit(None).cast("array<float>"))
    else:
        pooled = pooled.join(vectors.groupBy("id").agg(F.min(F.struct("model", F.col("vector").cast("array<float>").alias("vector"))).alias("v")).select("id", "v.*"), "id", "left")
    return pooled.groupBy("query_id").applyInPandas(run, "query_id long, id long, score double, place long")


def rerank(kept: DataFrame, closeness: DataFrame, first: int = 30) -> DataFrame:
    """``query_id, id, score, place``: the first candidates in the order of another scorer (query_id, id, closeness).

    The new score is 0.7 over the new place plus 0.3 of the old score; what lies beyond ``first`` drops out.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("closeness").desc(), "id")
    placed = kept.where(F.col("place") <= first).join(closeness, ["query_id", "id"], "left").withColumn("closeness", F.coalesce("closeness", F.lit(0.0))).withColumn("place", F.row_number().over(order))
    return placed.select("query_id", "id", (0.7 / F.col("place") + 0.3 * F.col("score")).alias("score"), F.col("place").cast("long").alias("place"))


# What a search of a quality does (whether it reranks, and how many milliseconds it may take); any other name is the default.
TIERS = {"fast": (False, 100), "balanced": (True, 300)}
DEFAULT_TIER = "balanced"


def quality_tier(name: Column) -> Column:
    """``tier, reranks, budget_ms`` of a tier that is asked for by name; null and unknown names are the default."""
    known = F.when(name.isin(list(TIERS)), name).otherwise(F.lit(DEFAULT_TIER))
    reranks, budget = F.lit(None).cast("boolean"), F.lit(None).cast("int")
    for tier, (again, most) in TIERS.items():
        reranks, budget = F.when(known == tier, F.lit(again)).otherwise(reranks), F.when(known == tier, F.lit(most)).otherwise(budget)
    return F.struct(known.alias("tier"), reranks.alias("reranks"), budget.alias("budget_ms"))


def finished(kept: DataFrame, closeness: DataFrame, tier: str | None = None) -> DataFrame:
    """``query_id, id, score, place``: the kept candidates as they are or reranked, as the tier says."""
    reranks = TIERS.get(tier, TIERS[DEFAULT_TIER])[0]
    return rerank(kept, closeness) if reranks else kept.select("query_id", "id", "score", "place")


def degraded_mode(vectors: bool, reranker: bool) -> str:
    """What a search can do with the services that answer."""
    return {(True, True): "full", (False, True): "no-vectors", (True, False): "no-rerank", (False, False): "words-only"}[vectors, reranker]


def search_mode(vectors: Column, reranker: Column) -> Column:
    """``degraded_mode`` of every row."""
    on, off = (F.when(reranker, F.lit(degraded_mode(v, True))).otherwise(F.lit(degraded_mode(v, False))) for v in (True, False))
    return F.when(vectors, on).otherwise(off)


def nearest_synonyms(queries: DataFrame, groups: DataFrame, most: int = 5, least: float = 0.5) -> DataFrame:
    """``query_id, synonyms``: of ``groups`` (term, aliases; as many as there are rules, at most) the nearest to a query's text, best first.

    Queries (query_id, text) and groups have vectors of one service, for which ``hashed_vectors`` stands in here; queries without
    a near group aren't returned.
    """
    texts = groups.select(F.struct("term", "aliases").alias("id"), F.concat_ws(" ", "term", F.array_join("aliases", " ")).alias("text"))
    numbered = texts.withColumn("n", F.row_number().over(Window.orderBy("id")))
    known = hashed_vectors(numbered.select(F.col("n").cast("long").alias("id"), "text")).select(F.col("id").alias("n"), F.col("vector").alias("known"))
    known = known.join(numbered.select("n", F.col("id").alias("synonym")), "n").select("synonym", "known")
    asked = hashed_vectors(queries.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "vector")
    products = F.zip_with("vector", "known", lambda a, b: a.cast("double") * b.cast("double"))
    met = asked.crossJoin(F.broadcast(known)).select("query_id", "synonym", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 9).alias("similarity")).where(F.col("similarity") >= least)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "synonym"))), 1, most)
    return met.groupBy("query_id").agg(F.transform(best, lambda x: x["synonym"]).alias("synonyms"))


def envelope_context(found: Column, shown: Column) -> Column:
    """What a language model is told about the results of a search."""
    return F.concat(
        F.lit("Found "), found.cast("string"), F.lit(" results (showing "), shown.cast("string"), F.lit("). Ranked by hybrid score (FTS + vector + reranking). Higher score = more relevant. "),
        F.lit("[source] = knowledge base. For code: context shows file > class > function hierarchy. Use `g_callers` and `g_callees` for callers/callees. Use `g_explore` for delegation chains."),
    )


def hashed_vectors(texts: DataFrame, dimensions: int = 64) -> DataFrame:
    """``id, model, vector``: a stand-in for an embedding service: words hashed to signed dimensions, unit length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zlib

        for b in batches:
            out = []
            for value in b["text"]:
                v = np.zeros(dimensions)
                for w in re.findall(r"\w+", (value or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dimensions] += 1 if h >> 16 & 1 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.DataFrame({"id": b["id"], "model": "hashed", "vector": out})

    return texts.select("id", "text").mapInPandas(run, "id long, model string, vector array<float>")


def cover_density(texts: DataFrame, terms: list[str], by_length: bool = True) -> DataFrame:
    """``id, rank``: texts ranked by how close together they hold all ``terms``.

    Every shortest stretch that holds all terms counts one over its gaps plus one; with ``by_length`` the sum is
    divided by one plus the logarithm of the length. Texts that lack a term aren't returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = set(terms)
        for b in batches:
            rows = []
            for key, ws in zip(b["id"], b["ws"], strict=True):
                places = [(i, w) for i, w in enumerate(ws) if w in wanted]
                if {w for _, w in places} != wanted:
                    continue
                total, left, held = 0.0, 0, {}
                for right, (i, w) in enumerate(places):
                    held[w] = held.get(w, 0) + 1
                    if len(held) < len(wanted):
                        continue
                    while held[places[left][1]] > 1:
                        held[places[left][1]] -= 1
                        left += 1
                    span = i - places[left][0] + 1
                    total += 1 / (1 + span - len(wanted))
                    del held[places[left][1]]
                    left += 1
                if total:
                    rows.append((key, total / (1 + np.log(len(ws))) if by_length else total))
            yield pd.DataFrame(rows, columns=["id", "rank"])

    return texts.select("id", tx.words(F.col("text")).alias("ws")).where(F.size("ws") > 0).mapInPandas(run, "id long, rank double")
