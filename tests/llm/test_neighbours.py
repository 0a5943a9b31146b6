from __future__ import annotations

import numpy as np

from quarrylight.llm import neighbours as N

SCHEMA = "chunk_id long, model string, vector array<float>, id string, near string"


def table(spark, rows):
    return spark.createDataFrame([(i, m, None if v is None else [float(x) for x in v], "a", "b") for i, m, v in rows], SCHEMA)


def brute(rows, k=10):
    usable = {}
    for i, m, v in rows:
        if i is not None and v is not None and len(v) == 64 and np.linalg.norm(np.float32(v)) > 0:
            usable[(m or "", i)] = np.float64(np.float32(v))
    out = {}
    for (m, i), v in usable.items():
        others = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for (n, j), w in usable.items() if n == m and j != i)
        out[(m, i)] = [j for _, j in others[:k]]
    return out


def near(df):
    return {(r.model, r.id): [n.id for n in r.near] for r in N.most_similar(df).collect()}


def test_hilbert_keys_are_a_walk():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = N.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_equals_brute_force_with_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "m" if i % 3 else "n", rng.standard_normal(64)) for i in range(200)]
    copy = rng.standard_normal(64)
    rows += [(1000 + i, "m", copy * (1 + i % 2)) for i in range(40)]
    rows += [(5000, "m", None), (5001, "m", np.zeros(64)), (5002, "m", np.ones(32)), (None, "m", np.ones(64)), (5003, None, np.ones(64)), (3, "n", rows[3][2])]
    assert near(table(spark, rows)) == brute(rows)


def test_pairs_and_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 64))
    rows = [(i, "m", centres[i % 30] + 0.1 * rng.standard_normal(64)) for i in range(900)]
    exact = brute(rows)
    usable = {i: np.float64(np.float32(v)) for i, _, v in rows}
    cosine = lambda a, b: usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b])
    wanted = {(min(i, j), max(i, j)) for (_, i), js in exact.items() for j in js if cosine(i, j) >= 0.9}
    got = {(r.a, r.b) for r in N.similar_pairs(table(spark, rows), width=60).collect()}
    assert len(got & wanted) >= 0.97 * len(wanted) and len(got - wanted) <= 0.03 * len(wanted)
    measured = N.recall(table(spark, rows), every=10).collect()[0]
    assert measured.queries == 90 and measured.recall >= 0.9


def windows(rows, width, orderings=8, k=10):
    """What the windows of all orderings hold, read off the whole orderings."""
    ids = np.array([i for i, _, _ in rows])
    units = np.stack([np.float64(np.float32(v)) for _, _, v in rows])
    units /= np.linalg.norm(units, axis=1)[:, None]
    seen = {i: set() for i in ids.tolist()}
    for o in range(orderings):
        order = np.lexsort((ids, N.curve_keys(units, o, 6, 8)))
        for at, i in enumerate(ids[order].tolist()):
            seen[i] |= set(ids[order][max(0, at - width) : at + width + 1].tolist()) - {i}
    place = {i: n for n, i in enumerate(ids.tolist())}
    return {("m", i): [j for _, j in sorted((round((1 - units[place[i]] @ units[place[j]]) * 1e9), j) for j in js)[:k]] for i, js in seen.items()}


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "m", rng.standard_normal(64)) for i in range(1500)]
    expected = windows(rows, 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for rows_per_task, shuffles in ((100_000, 3), (700, 17), (250, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            got = {(r.model, r.id): [n.id for n in r.near] for r in N.most_similar(table(spark, rows), width=20, rows_per_task=rows_per_task).collect()}
            assert got == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recall_names_every_model(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "m" if i < 200 else "n", rng.standard_normal(64)) for i in range(1, 230) if i < 200 or i % 100]
    measured = {r.model: (r.queries, r.recall) for r in N.recall(table(spark, rows)).collect()}
    assert measured == {"m": (1, 1.0), "n": (0, None)}


def test_empty_and_single(spark):
    empty = table(spark, [])
    assert N.most_similar(empty).count() == 0 and N.recall(empty).count() == 0
    one = N.most_similar(table(spark, [(1, "m", np.ones(64))])).collect()
    assert [(r.id, list(r.near)) for r in one] == [(1, [])]
