"""Exact boolean retrieval: a query language, its tree, and a search that scores every view in scope.

A view is an ordered set of components, each a document with a weight. A term counts in its best component; terms,
phrases and identifiers may be matched by different components of one view. Nothing is cut before it is counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as tx

PHRASE_BONUS, EXACT_BONUS = 1.5, 2.0
UNBOUND = "a view in scope has a component without a document"


@dataclass(frozen=True)
class Term:
    value: str


@dataclass(frozen=True)
class Phrase:
    value: str


@dataclass(frozen=True)
class Exact:
    value: str


@dataclass(frozen=True)
class Not:
    part: Node


@dataclass(frozen=True)
class And:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Node, ...]


Node = Term | Phrase | Exact | Not | And | Or


class QueryError(ValueError):
    """A query that says nothing that could be searched for."""


_LEX = re.compile(r'\s*(?:(?P<phrase>"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<minus>-(?=\S))|(?P<word>[^\s()"]+)|(?P<bad>"))')


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if m is None or m.lastgroup == "bad":
            raise QueryError("unbalanced quote")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


def parse(query: str) -> Node:
    """The tree of a query: OR binds weakest, then AND (also unspoken), then NOT, ``-`` and groups."""
    tokens = _lex(query)
    at = 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == ("word", "OR"):
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both() -> Node:
        nonlocal at
        parts = [single()]
        while True:
            kind, value = peek()
            if (kind, value) == ("word", "AND"):
                at += 1
                parts.append(single())
            elif kind in ("end", "close") or (kind, value) == ("word", "OR"):
                break
            else:
                parts.append(single())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def single() -> Node:
        nonlocal at
        kind, value = peek()
        at += 1
        if kind == "minus" or (kind, value) == ("word", "NOT"):
            return Not(single())
        if kind == "open":
            inner = either()
            if peek()[0] != "close":
                raise QueryError("unbalanced bracket")
            at += 1
            return inner
        if kind == "phrase":
            plain = value[1:-1].strip()
            if not plain:
                raise QueryError("empty phrase")
            return Phrase(plain.lower())
        if kind == "word" and value not in ("AND", "OR"):
            if value.startswith("id:") and len(value) > 3:
                return Exact(value[3:].lower())
            found = re.findall(r"\w+", value.lower())
            if not found:
                raise QueryError("no word in " + value)
            return Term(found[0]) if len(found) == 1 else And(tuple(Term(w) for w in found))
        raise QueryError("a part is missing")

    if not tokens:
        raise QueryError("empty query")
    tree = either()
    if peek()[0] != "end":
        raise QueryError("unbalanced bracket")
    if not anchored(tree):
        raise QueryError("nothing positive to search for")
    return tree


def anchored(node: Node) -> bool:
    """Whether every match must hold something positive: all branches of an OR, any part of an AND."""
    if isinstance(node, Not):
        return False
    if isinstance(node, Or):
        return all(map(anchored, node.parts))
    if isinstance(node, And):
        return any(map(anchored, node.parts))
    return True


def leaves(node: Node, negated: bool = False) -> list[tuple[Node, bool]]:
    """(leaf, whether an odd number of NOTs stands above it), without repeats."""
    if isinstance(node, Not):
        return leaves(node.part, not negated)
    if isinstance(node, And | Or):
        return list(dict.fromkeys(x for p in node.parts for x in leaves(p, negated)))
    return [(node, negated)]


def simple_conjunction(node: Node, most: int = 8) -> list[str] | None:
    """The words of a plain conjunction of two to ``most`` words, else None."""
    if isinstance(node, And) and 2 <= len(node.parts) <= most and all(isinstance(p, Term) for p in node.parts):
        return [p.value for p in node.parts]
    return None


def holds(node: Node, flag) -> Column:
    """The tree as a condition; ``flag`` gives the column of a leaf."""
    if isinstance(node, Not):
        return ~holds(node.part, flag)
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, [holds(p, flag) for p in node.parts])
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, [holds(p, flag) for p in node.parts])
    return flag(node)


def _leaf_counts(leaf: Node, tokens: Column, content: Column) -> Column:
    if isinstance(leaf, Term):
        return F.size(F.filter(tokens, lambda w: w == leaf.value))
    if isinstance(leaf, Phrase):
        return tx.has_phrase(content, F.lit(leaf.value)).cast("int")
    return F.array_contains(tx.exact_identifiers(content), leaf.value).cast("int")


def search(query: str | Node, bindings: DataFrame, documents: DataFrame, limit: int | None = 20, by_component: bool = False, stages: DataFrame | None = None) -> DataFrame:
    """``occurrence_id, score, matched, total``: matching views, best first (ties by id), and how many match in all.

    ``bindings``: occurrence_id, ordinal, doc_id, role_weight. ``documents``: doc_id, text. ``stages``: optional
    further scores (occurrence_id, bonus). With ``by_component`` a term is weighed by its component's length instead
    of the view's. ``limit=None`` gives all matches.
    """
    tree = parse(query) if isinstance(query, str) else query
    found = leaves(tree)
    order = list(dict.fromkeys(leaf for leaf, _ in found))
    spot = {leaf: k for k, leaf in enumerate(order)}
    positive = list(dict.fromkeys(leaf for leaf, negated in found if not negated))
    # Only ids are read for this.
    if not bindings.select("doc_id").join(documents.select("doc_id"), "doc_id", "left_anti").isEmpty():
        raise ValueError(UNBOUND)
    tokens = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("content")).withColumn("tokens", tx.words(F.col("content")))
    counted = tokens.select("doc_id", F.size("tokens").alias("length"), F.array(*[_leaf_counts(x, F.col("tokens"), F.col("content")) for x in order]).alias("counts"))
    views = (
        bindings.join(counted, "doc_id").groupBy("occurrence_id").agg(F.sum("length").alias("view_length"), F.collect_list(F.struct("role_weight", "length", "counts")).alias("parts"))
    )

    def present(k: int):
        return lambda p: F.get(p["counts"], F.lit(k)) > 0

    def weighed(k: int):
        length = (lambda p: p["length"]) if by_component else (lambda p: F.col("view_length"))
        tf = lambda p: F.get(p["counts"], F.lit(k))
        return lambda p: p["role_weight"] * tf(p) / (tf(p) + 0.5 + 0.5 * F.coalesce(F.try_divide(length(p).cast("double"), F.col("average")), F.lit(0.0)))

    flags = [F.exists("parts", present(k)) for k in range(len(order))]
    views = views.select("occurrence_id", "view_length", "parts", F.array(*flags).alias("flags"))
    matches = holds(tree, lambda leaf: F.get("flags", F.lit(spot[leaf])))
    # How many match in all is counted with the other numbers of the corpus, so that the views are gone through once.
    stats = views.agg(F.count("*").alias("n"), F.count_if(matches).alias("total"), F.avg("view_length").alias("average"), F.array(*[F.count_if(F.get("flags", F.lit(k))) for k in range(len(order))]).alias("df"))
    scored = views.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for leaf in positive:
        k = F.lit(spot[leaf])
        if isinstance(leaf, Term):
            idf = F.log(1 + (F.col("n") + 1) / (F.get("df", k) + 1))
            best = F.array_max(F.transform("parts", weighed(spot[leaf])))
            score = score + F.when(F.get("flags", k), idf * best).otherwise(0.0)
        else:
            score = score + F.when(F.get("flags", k), PHRASE_BONUS if isinstance(leaf, Phrase) else EXACT_BONUS).otherwise(0.0)
    matched = F.array_sort(F.array_compact(F.array(*[F.when(F.get("flags", F.lit(spot[x])), F.lit(x.value)) for x in positive])))
    hits = scored.where(matches).select("occurrence_id", score.alias("score"), matched.alias("matched"), "total")
    if stages is not None:
        hits = hits.join(stages.groupBy("occurrence_id").agg(F.sum("bonus").alias("bonus")), "occurrence_id", "left").select("occurrence_id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"), "matched", "total")
    return hits if limit is None else hits.orderBy(F.col("score").desc(), "occurrence_id").limit(limit)
