from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import english
from quarrylight.operators import access, enrich, evaluate, graph, retrieval, versions
from quarrylight.streaming import flows

MEMBERS = "item_key string, identity string"
INTERVALS = "item_key string, identity string, valid_from long, valid_to long"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_snapshots_open_close_and_come_back(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], MEMBERS)
    b = spark.createDataFrame([("y", "2"), ("z", "1")], MEMBERS)
    empty = spark.createDataFrame([], INTERVALS)
    assert rows(versions.delta_plan(a, b)) == {("x", "close"), ("y", "replace"), ("z", "open")}
    one = versions.commit(empty, a, 1)
    two = versions.commit(one, b, 2)
    three = versions.commit(two, a, 3)
    assert rows(versions.visible(three, 1).select("item_key", "identity")) == rows(a)
    assert rows(versions.visible(three, 2).select("item_key", "identity")) == rows(b)
    assert rows(versions.visible(three, 3).select("item_key", "identity")) == rows(a)
    assert rows(versions.commit(three, a, 4)) == rows(three)
    assert versions.overlaps(three).count() == 0
    assert rows(versions.overlaps(spark.createDataFrame([("x", "1", 1, 3), ("x", "2", 2, None), ("y", "1", 1, 2), ("y", "2", 2, None)], INTERVALS))) == {("x",)}
    with pytest.raises(versions.VersionError):
        versions.delta_plan(a.union(a), b)
    with pytest.raises(versions.VersionError):
        versions.advance("building", "active")
    assert versions.advance("verified", "release_candidate") == "release_candidate"


def test_appends_bodies_and_alignment(spark):
    checks = spark.createDataFrame([("a", 5, "h", 3, "h"), ("b", 5, "h", 9, "k"), ("c", 5, "h", 9, "h"), ("d", 5, "h", 5, "h")], "item_key string, old_size int, old_prefix_hash string, new_size int, new_prefix_hash string")
    assert rows(versions.verify_append(checks)) == {("a", "shrunken"), ("b", "drifted"), ("c", "grown"), ("d", "same")}
    body = versions.bodies(spark.createDataFrame([(1, "same"), (2, "same"), (3, "")], "id long, text string")).orderBy("first_id").collect()
    assert [(r["size"], r.uses, r.first_id, r.clash) for r in body] == [(4, 2, 1, False), (0, 1, 3, False)]
    pieces = spark.createDataFrame([(1, 1, "aa"), (2, 1, "b"), (3, 1, "zz")], "piece_id long, file_id long, piece string")
    assert rows(versions.align(pieces, spark.createDataFrame([(1, "aaab")], "file_id long, whole string"))) == {(1, None, "ambiguous"), (2, 4, "unique"), (3, None, "absent")}


def test_access_is_denied_by_default(spark):
    sources = spark.createDataFrame([(1, "u"), (2, None), (3, "v")], "id long, user_id string")
    data = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 9)], "id long, source_id long")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(access.of_tenant(data, sources, "u")) == {10}
    assert ids(access.of_tenant(data, sources, None)) == set()
    assert ids(access.of_tenant(data, sources, None, admin=True)) == {10, 20, 30, 40}
    g = spark.createDataFrame([("u", 1, dt.datetime(2020, 1, 1), True), ("u", 3, None, True), ("w", 1, None, False)], "user_id string, source_id long, expires timestamp, can_read boolean")
    r = spark.createDataFrame([("team", 2, None, True)], "role string, source_id long, expires timestamp, can_read boolean")
    grants = access.accessible(sources, g, r, spark.createDataFrame([("w", "team")], "user_id string, role string"), F.lit("2025-01-01").cast("timestamp"))
    assert rows(grants) == {("u", 3), ("w", 2)}
    assert ids(access.secured(data, grants, "w")) == {20}


def test_graph_walks_stop_and_reach(spark):
    symbols = spark.createDataFrame([(i, n, "function") for i, n in enumerate("abcde", 1)], "id long, name string, type string")
    calls = spark.createDataFrame([(1, 1, 2, "b", 1), (2, 2, 3, "c", 2), (3, 3, 1, "a", 3), (4, 3, None, "lib", 4), (5, 1, 1, "a", 5), (6, 3, None, "assert", 6)], "id long, caller_symbol_id long, callee_symbol_id long, callee_name string, call_line int")
    assert rows(graph.chain("a", symbols, calls).select("depth", "name")) == {(1, "b"), (2, "c"), (3, "lib")}
    assert rows(graph.chain("c", symbols, calls, direction="callers").select("name")) == {("b",), ("a",)}
    paths = {tuple(r.path) for r in graph.resolved_chain("a", symbols, calls).collect()}
    assert paths == {(1,), (1, 2), (1, 2, 3)}
    links = calls.where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("here"), F.col("callee_symbol_id").alias("there"))
    assert rows(graph.reachable(symbols.where("name = 'b'").select("id"), links)) == {(1,), (2,), (3,)}
    assert ("lib", None, False, 0) in rows(graph.proven_calls(symbols, calls)) and ("b", 2, True, 1) in rows(graph.proven_calls(symbols, calls))


def test_relations_roles_and_words(spark):
    java = "class A {\n  private List<Item> items;\n  private final Engine target;\n  public Project getParent() { }\n  private String name;\n}"
    got = rows(enrich.relations(spark.createDataFrame([("A", java)], "name string, body string")).select("target", "relation"))
    assert {("Item", "contains"), ("Engine", "wraps_target"), ("Project", "owned_by")} <= got and not any(x == "String" for x, _ in got)
    freq = enrich.word_frequency(spark.createDataFrame([("getUserName",), ("get_user",)], "name string"), spark.createDataFrame([("user account",)], "text string"))
    assert {r.word: r.weight for r in freq.collect()} == {"get": 6, "user": 8, "name": 3, "account": 2}
    assert [(r.term, r.aliases) for r in enrich.synonym_groups(freq).collect()] == [("user", ["account"])]


def test_fusion_diversity_rerank_and_knn(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, id long, rank int")
    fused = {r.id: r.fused for r in retrieval.fuse(a, b, 1.2).collect()}
    assert fused[10] == pytest.approx(1 / 61) and fused[20] == pytest.approx((1 / 62 + 1.2 / 61) * 1.5) and fused[30] == pytest.approx(1.2 / 62)
    ranked = spark.createDataFrame([(1, i, 1.0 - i / 100, i % 2, i % 3, i) for i in range(1, 13)], "query_id long, id long, score double, source_id long, file_id long, rank int")
    texts = spark.createDataFrame([(i, f"word{i} unique{i}" if i != 2 else "word1 unique1") for i in range(1, 13)], "id long, text string")
    kept = retrieval.diverse(ranked, texts, limit=20, per_file=2).orderBy("place").collect()
    assert [r.id for r in kept] == [1, 3, 4, 5, 6, 8]
    closer = spark.createDataFrame([(1, 6, 0.9), (1, 1, 0.1)], "query_id long, id long, closeness double")
    best = retrieval.rerank(spark.createDataFrame(kept), closer, first=5).orderBy("place").collect()
    assert [r.id for r in best][:2] == [6, 1] and best[0].score == pytest.approx(0.7 + 0.3 * 0.94) and len(best) == 5
    v = np.random.default_rng(1).standard_normal((50, 8))
    base = spark.createDataFrame([(i, "m", [float(x) for x in v[i]]) for i in range(50)] + [(60, "m", None), (61, "m", [0.0] * 8)], "id long, model string, vector array<double>")
    asked = base.where("id < 5").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest(asked, base, 3, block=2).collect()}
    sims = (v / np.linalg.norm(v, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    for q in range(5):
        order = [i for i in np.argsort(-sims[q]) if i != q][:3]
        assert [got[q, k] for k in (1, 2, 3)] == order


def test_cover_density_by_hand(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a x b"), (3, "a b x x a b"), (4, "a only")], "id long, text string")
    got = {r.id: r["rank"] for r in retrieval.cover_density(texts, ["a", "b"], by_length=False).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: pytest.approx(1 + 1 / 3 + 1)}


def test_stems():
    assert [english.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "happy", "generations", "at")] == ["caress", "poni", "relat", "hop", "agre", "happi", "gener", "at"]


def test_stateful_flows(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    events = spark.createDataFrame([(1, at(0), 7, "click"), (2, at(10), 7, "click"), (3, at(20), 7, "error"), (4, at(120), 7, "error"), (5, at(121), 7, "view"), (6, at(130), 7, "view")], "event_id long, ts timestamp, user_id long, event_type string")
    kept = {r.event_id: r.kept for r in flows.rate_limited(events, seconds=100).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
    assert {r.event_id for r in flows.signature_changes(events).collect()} == {1, 3, 5}
    outcomes = spark.createDataFrame([(1, i, at(i), False) for i in range(3)] + [(1, 3, at(40), False), (1, 4, at(41), True)], "key long, event_id long, ts timestamp, ok boolean")
    assert [r.state for r in flows.circuit(outcomes, threshold=2, wait_seconds=30).orderBy("event_id").collect()] == ["closed", "open", "open", "half_open", "closed"]
    box = spark.createDataFrame([(1, at(0), "processing", 0, at(0)), (2, at(0), "processing", 0, at(590)), (3, at(0), "done", 0, t0 - dt.timedelta(days=3)), (4, at(0), "failed", 3, t0 - dt.timedelta(days=9)), (5, at(1), "pending", 0, at(1))], "id long, created timestamp, status string, retries int, touched timestamp")
    now = F.lit(at(600)).cast("timestamp")
    assert {r.id: r.status for r in flows.reaped(box, now).collect()} == {1: "pending", 2: "processing", 3: "done", 4: "failed", 5: "pending"}
    assert {r.id for r in flows.purged(box, now).collect()} == {1, 2, 5}
    assert [r.id for r in flows.claimed(box, 5).collect()] == [5]


def test_streams_equal_their_batch_twins(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    streamed = flows.run_to_table(flows.rate_limited(flows.change_stream(spark, data)))
    assert rows(streamed) == rows(flows.rate_limited(events))


def test_judgements(spark):
    assert [spark.range(1).select(evaluate.path_matches(F.lit(a), F.lit(b)).alias("x")).first().x for a, b in (("src/a.py", "a.py"), ("./src/a.py", "src/a.py"), ("src/util/x.py", "util/"), ("src/handler.py", "hand"), ("src/a.py", "b.py"))] == [True, True, True, True, False]
    results = spark.createDataFrame([(1, "x.py", 1), (1, "y.py", 2), (3, "z.py", 1)], "query_id int, path string, rank int")
    expected = spark.createDataFrame([(1, "y.py"), (1, "q.py"), (2, None), (3, None), (4, "a.py")], "query_id int, expected string")
    got = {r.query_id: (r.recall, r.reciprocal_rank) for r in evaluate.judged(results, expected, 10).collect()}
    assert got == {1: (0.5, 0.5), 2: (1.0, 1.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_close_vectors_are_alike(spark):
    ranked = spark.createDataFrame([(1, i, 1.0 - i / 10, i, i, i) for i in range(1, 6)], "query_id long, id long, score double, file_id long, source_id long, rank int")
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "epsilon zeta"), (4, "eta theta"), (5, None)], "id long, text string")
    vectors = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [1.0, 0.1]), (3, "n", [1.0, 0.0]), (4, "m", [0.0, 0.0]), (5, "m", [1.0, 0.5])], "id long, model string, vector array<float>")
    assert [r.id for r in retrieval.diverse(ranked, texts, vectors=vectors).orderBy("place").collect()] == [1, 3, 4, 5]
    assert [r.id for r in retrieval.diverse(ranked, texts).orderBy("place").collect()] == [1, 2, 3, 4, 5]


def test_busy_keys_are_flushed(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, n, start + datetime.timedelta(minutes=10 * n)) for n in range(13)] + [(1, 99, start + datetime.timedelta(hours=9)), (2, 100, start)], "user_id long, event_id long, ts timestamp_ntz")
    got = {(r.user_id, r.start, r.n) for r in flows.debounced(events, "user_id", "30 minutes", "1 hour").collect()}
    hour = datetime.timedelta(hours=1)
    assert got == {(1, start, 6), (1, start + hour, 6), (1, start + 2 * hour, 1), (1, start + 9 * hour, 1), (2, start, 1)}


def test_robots_sections(spark):
    from quarrylight.sources import adapters

    robots = spark.createDataFrame([(1, "User-agent: other\nDisallow: /x\n\nUser-agent: *\nDisallow: /a\r\nDisallow:\nAllow: /q\nUser-agent: quarrylight\n Disallow: /b \n"), (2, ""), (3, None)], "source_id long, text string")
    assert {(r.source_id, r.rule) for r in adapters.robots_rules(robots).collect()} == {(1, "/a"), (1, "/b")}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quarrylight.core import storage

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: None)

        sparkContext = Context  # noqa: N815

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(RuntimeError):
            storage.checkpoint_dir(Session)

def _shuffled(spark) -> int:
    """Records that all stages so far have written for others."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_words_of_many_queries_move_only_the_best_texts(spark):
    texts = spark.range(4000).selectExpr("id", "concat('common word', id % 7, ' t', id % 500, ' also') AS text")
    queries = spark.range(300).selectExpr("id AS query_id", "array('common', 'also', concat('t', id), 'absent') AS terms")
    before = _shuffled(spark)
    found = retrieval.word_channel(queries, texts, 5, block=100, most=3000)
    got = {(r.query_id, r["rank"]): r.id for r in found.collect()}
    # Eight texts have the rare word; the lowest of equal ones come first. All pairs were 1,200,000.
    assert got == {(q, k + 1): q + 500 * k for q in range(300) for k in range(5)}
    assert _shuffled(spark) - before < 300 * 5 * retrieval.PARTS + 20_000


def test_words_are_scored_over_blocks_as_over_the_whole(spark):
    rng = np.random.default_rng(5)
    lines = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 40)) if x < 60)) for i in range(700)]
    lines += [(7, "w3 w3 w5"), (7, "w9"), (None, "w2 w2"), (800, None), (801, "-"), (802, "Ünder w1")]
    texts = spark.createDataFrame(lines, "id long, text string")
    queries = spark.createDataFrame([(q, [f"w{int(x)}" for x in rng.integers(1, 60, 4)] + ["", "ünder"][: q % 3]) for q in range(40)] + [(50, [])], "query_id long, terms array<string>")
    tokens = [(i, [w for w in (t or "").lower().replace("-", " ").split() if w]) for i, t in lines]
    tokens = [x for x in tokens if x[1]]
    n, average = len(tokens), sum(len(ws) for _, ws in tokens) / len(tokens)
    tf, length = {}, {}
    for i, ws in tokens:
        length[i] = max(length.get(i, 0), len(ws))
        for w in ws:
            tf.setdefault(w, {})[i] = tf.get(w, {}).get(i, 0) + 1
    expected = set()
    for q, terms in ((r.query_id, set(r.terms) - {""}) for r in queries.collect()):
        scores = {}
        for w in sorted(terms & set(tf)):
            for i, c in tf[w].items():
                scores[i] = scores.get(i, 0) + np.log(1 + (n + 1) / (len(tf[w]) + 1)) * c / (c + 0.5 + 0.5 * length[i] / average)
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), -1 if i is None else i))[:9]
        expected |= {(q, i, round(scores[i], 6), k + 1) for k, i in enumerate(best)}
    for block, most in ((2000, 2_000_000), (7, 50), (1, 1)):
        assert {(r[0], r[1], round(r[2], 6), r[3]) for r in retrieval.word_channel(queries, texts, 9, block, most).collect()} == expected
    assert retrieval.word_channel(queries.where("query_id < 0"), texts, 9).count() == retrieval.word_channel(queries, texts.where("id < 0"), 9).count() == 0


def _moved(spark) -> int:
    """Bytes that all stages so far have written for others."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def _wordy(n: int) -> list[tuple[int, str]]:
    """Texts of 80 different words each, of which no two texts share many."""
    rng = np.random.default_rng(3)
    return [(i, " ".join(f"word{int(x)}" for x in rng.choice(100_000, 80, replace=False))) for i in range(n)]


def test_words_of_candidates_move_as_one_text(spark):
    lines = _wordy(1000) + [(1000, ""), (1001, "")]
    texts = spark.createDataFrame(lines, "id long, text string")
    ranked = texts.selectExpr("id % 10 AS query_id", "id", "1.0 / (1 + id) AS score", "id AS file_id", "id AS source_id", "cast(id div 10 + 1 AS int) AS rank")
    before = _moved(spark)
    got = {(r.query_id, r.place): r.id for r in retrieval.diverse(ranked, texts, limit=200, pool=200).collect()}
    # Texts without words are like none. Lists of words moved 1.37 MB here.
    assert got == {(i % 10, i // 10 + 1): i for i, _ in lines}
    assert _moved(spark) - before < 1.15e6


def test_words_to_rerank_by_move_as_one_text(spark):
    from quarrylight.plans import searching

    class Tables:
        chunks = spark.createDataFrame([(i, f"{text} {text}\n{text}") for i, text in _wordy(1000)] + [(1000, "-\nword1"), (1001, "one two\nfour"), (1002, "one one two."), (1003, "-"), (1100, None)], "id long, content_text string")

    kept = spark.createDataFrame([(0, 0), (100, 100), (1000, 1001), (100, 1003), (0, 1100)], "query_id long, id long")
    before = _moved(spark)
    got = {(r.query_id, r.id): r.closeness for r in searching._closeness(Tables, kept).collect()}
    # Lists of words moved 1.16 MB here.
    assert got == {(0, 0): 1.0, (100, 100): 1.0, (1000, 1001): 0.0, (100, 1003): 0.0}
    assert _moved(spark) - before < 0.8e6


@pytest.fixture(scope="module")
def one_word(spark, tmp_path_factory):
    """Tables of 3,000 texts that share one word, 100 of which are asked for; no vectors, symbols or calls."""
    base = tmp_path_factory.mktemp("tables")
    ids = [100 * i for i in range(100)] + [100 * i + 1 for i in range(2900)]
    tables = {
        "chunks": ([(i, i, "function", f"common word{i}", 1, 1, 1) for i in ids], "id long, file_id long, chunk_type string, content_text string, start_line int, end_line int, level short"),
        "files": ([(i, i, f"src/f{i}.rs") for i in ids], "id long, source_id long, path string"),
        "symbols": ([], "id long, file_id long, line_start int, line_end int"),
        "call_graph": ([], "id long, callee_symbol_id long"),
        "chunk_embeddings": ([], "chunk_id long, model string, vector array<float>"),
    }
    for name, (lines, schema) in tables.items():
        spark.createDataFrame(lines, schema).write.parquet(str(base / f"{name}.parquet"))
    # A text is the best for its own line; the others are equal and come by id.
    return str(base), {q: [q, *[i for i in sorted(ids) if i != q][:19]] for q in ids[:100]}


def test_a_fast_search_moves_no_pairs_of_queries_and_texts(spark, one_word):
    from quarrylight.plans import searching

    base, expected = one_word
    before = _moved(spark)
    got = {(r.query_id, r.place): r.id for r in searching.P.queries["search_fast"](spark, base).collect()}
    moved = _moved(spark) - before
    assert got == {(q, n): i for q, found in expected.items() for n, i in enumerate(found, 1)}
    # Before F12 a row for every query and text with the word moved: 2.50 MB here, now 0.42 MB.
    assert moved < 1e6


def test_envelopes_move_no_pairs_of_queries_and_texts(spark, one_word):
    import json

    from quarrylight.plans import searching

    base, expected = one_word
    before = _moved(spark)
    got = {r.query_id: (r.total, json.loads(r.results)) for r in searching.P.queries["response_envelope"](spark, base).collect()}
    moved = _moved(spark) - before
    assert {q: (n, [(x["place"], x["id"]) for x in found]) for q, (n, found) in got.items()} == {q: (20, list(enumerate(found, 1))) for q, found in expected.items()}
    assert all(x["location"].startswith(f"src/f{x['id']}.rs") for _, found in got.values() for x in found)
    # Before F12 2.50 MB moved here, now 0.43 MB.
    assert moved < 1e6


def test_envelopes_tell_what_the_search_did(spark, tmp_path):
    import json

    from quarrylight.plans import searching

    deck = "class Deck:\n    pass"
    pieces = [
        (100, 1, "function", "createEmptyClip\nplays it", 3, 4, 2, "[box] src/f1.rs", 7), (7, 1, "class", deck, 1, 9, 1, None, None), (1, 2, "function", "empty shelf", 1, 1, 1, None, None), (2, 3, "function", "empty shelf", 1, 1, 1, None, None),
        (200, 4, "function", "get load", 1, 1, 1, None, None), (300, 5, "function", None, 1, 1, 1, None, None), (400, 6, "function", '"quoted words"', 1, 1, 1, None, None), (500, 7, "function", "//", 1, 1, 1, None, None),
        (600, 8, "function", "lonely\n" + "é" * 9000, 1, 2, 1, None, None),
    ]
    tables = {
        "chunks": (pieces, "id long, file_id long, chunk_type string, content_text string, start_line int, end_line int, level short, context_prefix string, parent_chunk_id long"),
        "files": ([(i, 1, f"src/f{i}.rs", "rust") for i in range(1, 9)], "id long, source_id long, path string, language string"),
        "symbols": ([(1, 99, "get_item", None, 1, 1), (2, 99, "load_item", None, 2, 2)], "id long, file_id long, name string, doc_comment string, line_start int, line_end int"),
        "call_graph": ([], "id long, callee_symbol_id long"),
        "chunk_embeddings": ([(i, "m", [1.0] * 64) for i in (300, 400)], "chunk_id long, model string, vector array<float>"),
    }
    for name, (lines, schema) in tables.items():
        spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.query_id: r for r in searching.P.queries["response_envelope"](spark, str(tmp_path)).collect()}
    # Candidates found (near-duplicates and a piece without text among them), shown, what could be done, and what was asked for besides.
    assert {q: (r.found, r.total, r["mode"], r.reranked, r.expanded_query, r.expansion_terms) for q, r in got.items()} == {
        100: (3, 2, "no-vectors", True, "clip | create | createemptyclip | empty", []), 200: (1, 1, "no-vectors", True, "get | load", ["get"]), 300: (1, 1, "no-rerank", False, None, []),
        400: (2, 1, "full", True, "quoted | words", []), 500: (0, 0, "words-only", False, "", []), 600: (1, 1, "no-vectors", True, None, []),
    }
    assert all(r.quality_tier == "balanced" and r.llm_context.startswith(f"Found {r.found} results (showing {r.total}). ") for r in got.values())
    shown = {q: json.loads(r.results) for q, r in got.items()}
    assert {q: [x["id"] for x in found] for q, found in shown.items()} == {100: [100, 1], 200: [200], 300: [400], 400: [400], 500: [], 600: [600]}
    first = shown[100][0]
    assert (first["snippet"], first["content"], first["location"]) == ("**createEmptyClip**\nplays it", "createEmptyClip\nplays it", "src/f1.rs:3-4")
    assert (first["parent_context"], first["context_prefix"], first["language"], first["chunk_type"]) == ("class Deck:", "[box] src/f1.rs", "rust", "function")
    # The new place counts 0.7, the old score 0.3; without words to rerank by the old score stays.
    assert first["score"] == pytest.approx(0.7 + 0.3 * 1.4 * 1.2 * 0.3 * 1.15 / 61, abs=1e-6) and shown[300][0]["score"] == pytest.approx(1.4 * 1.2 * 0.3 * 1.05 / 61, abs=1e-6)
    assert shown[600][0]["content"].endswith("é...\n[truncated: 18007 chars total]") and len(shown[600][0]["content"].encode()) < 16_100


def test_nearest_rows_are_the_same_however_few_similarities_are_held(spark, monkeypatch):
    vectors = [(i, "m", [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(60, 8)))]
    base = spark.createDataFrame(vectors, "id long, model string, vector array<float>")

    def found():
        return rows(retrieval.nearest(base.withColumnRenamed("id", "query_id"), base, 7).select("query_id", "id", "similarity", "rank"))

    whole = found()
    monkeypatch.setattr(retrieval, "CELLS", 130)
    assert found() == whole and len(whole) == 60 * 7
