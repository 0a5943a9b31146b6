from __future__ import annotations

import math
import random

import pytest

from quarrylight.operators import exact as E

DOCS = [
    (1, "alpha beta gamma_1 beta"), (2, "beta delta"), (3, "alpha delta; the sealed generations are here"), (4, "sealed alpha generations"), (5, ""), (6, "Ünïcode ÄPFEL alpha"), (7, None), (8, "id42 beta beta beta"), (9, "... !!!"),
]
VIEWS = [(10, 1, 1, 1.2), (10, 2, 2, 1.0), (20, 1, 3, 1.0), (30, 1, 4, 1.0), (40, 1, 5, 1.0), (50, 1, 6, 1.0), (60, 1, 7, 1.0), (70, 1, 8, 2.0), (80, 1, 9, 1.0)]


def tables(spark, views=VIEWS, docs=DOCS):
    return spark.createDataFrame(views, "occurrence_id long, ordinal int, doc_id long, role_weight double"), spark.createDataFrame(docs, "doc_id long, text string")


def words(text):
    import re

    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def scorer(query):
    """An independent, plain scorer."""
    tree = E.parse(query)
    texts = {d: words(t) for d, t in DOCS}
    comps = {}
    for o, _, d, w in VIEWS:
        comps.setdefault(o, []).append((w, texts[d]))
    length = {o: sum(len(t) for _, t in c) for o, c in comps.items()}
    n, average = len(comps), sum(length.values()) / len(comps)

    def has(leaf, o):
        joined = ["\x1f" + "\x1f".join(t) + "\x1f" for _, t in comps[o]]
        if isinstance(leaf, E.Term):
            return any(leaf.value in t for _, t in comps[o])
        if isinstance(leaf, E.Phrase):
            return any("\x1f" + "\x1f".join(words(leaf.value)) + "\x1f" in j for j in joined)
        return any(leaf.value in t and any(c == "_" or c.isdigit() for c in leaf.value) for _, t in comps[o])

    def holds(node, o):
        if isinstance(node, E.Not):
            return not holds(node.part, o)
        if isinstance(node, E.And):
            return all(holds(p, o) for p in node.parts)
        if isinstance(node, E.Or):
            return any(holds(p, o) for p in node.parts)
        return has(node, o)

    out = {}
    for o in comps:
        if not holds(tree, o):
            continue
        score = 0.0
        for leaf in {x for x, negated in E.leaves(tree) if not negated}:
            if not has(leaf, o):
                continue
            if isinstance(leaf, E.Term):
                df = sum(has(leaf, p) for p in comps)
                score += math.log(1 + (n + 1) / (df + 1)) * max(w * t.count(leaf.value) / (t.count(leaf.value) + 0.5 + 0.5 * length[o] / average) for w, t in comps[o])
            else:
                score += 1.5 if isinstance(leaf, E.Phrase) else 2.0
        out[o] = score
    return out


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "alpha AND delta", "alpha OR delta", "beta -delta", '"sealed generations"', "id:gamma_1 alpha", "(alpha OR beta) NOT delta", "äpfel", "missing OR beta", "id:id42"])
def test_scores_equal_the_plain_scorer(spark, query):
    hits = {r.occurrence_id: r.score for r in E.search(query, *tables(spark), limit=None).collect()}
    expected = scorer(query)
    assert hits.keys() == expected.keys()
    assert all(math.isclose(hits[o], expected[o], rel_tol=1e-9) for o in hits)


@pytest.mark.parametrize("query", ["", "  ", '"open', "(alpha", "alpha)", "NOT alpha", "alpha OR -beta", "AND", '""', "-(a b)"])
def test_senseless_queries_are_refused(query):
    with pytest.raises(E.QueryError):
        E.parse(query)


def test_spoken_and_unspoken_and_are_the_same():
    assert E.parse("alpha AND beta AND gamma") == E.parse("alpha beta gamma")
    assert E.simple_conjunction(E.parse("a b c")) == ["a", "b", "c"] and E.simple_conjunction(E.parse("a OR b")) is None


def test_order_of_input_and_partitions_don_t_matter(spark):
    rng = random.Random(1)
    a = E.search("alpha OR beta", *tables(spark)).collect()
    views, docs = tables(spark, rng.sample(VIEWS, len(VIEWS)), rng.sample(DOCS, len(DOCS)))
    assert E.search("alpha OR beta", views.repartition(8), docs.repartition(3)).collect() == a
    assert [r.total for r in a] == [len(a)] * len(a)


def test_ties_at_the_limit_go_by_id(spark):
    views, docs = tables(spark, [(i, 1, i, 1.0) for i in range(9)], [(i, "same words") for i in range(9)])
    assert [r.occurrence_id for r in E.search("same", views, docs, limit=4).collect()] == [0, 1, 2, 3]


def test_views_without_documents_are_an_error(spark):
    with pytest.raises(ValueError):
        E.search("alpha", *tables(spark, [*VIEWS, (90, 1, 999, 1.0)]))
