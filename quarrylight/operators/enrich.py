"""Rule-based enrichment and mining: layers, effects, roles, annotations, entities, relations, word frequencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as tx

# How classes refer to others: name, pattern with the other as its first group, relation, confidence.
RELATIONS = [
    ("container_field", r"(?:private|protected|public)?\s+(?:final\s+)?(?:List|Set|Collection|Map)<\s*(\w+)", "contains", 0.7),
    ("owner_return", r"(?:public|protected)\s+(\w+)\s+get(?:Parent|Owner|Document|Project)\s*\(", "owned_by", 0.6),
    ("proxy_target", r"(?:private|protected)\s+(?:final\s+)?(\w+)\s+(?:target|delegate|wrapped|impl)\b", "wraps_target", 0.75),
    ("field_type", r"(?:private|protected|public)\s+(?:final\s+)?([A-Z][a-zA-Z]{3,})\s+\w+\s*[;=]", "uses", 0.5),
    ("param_type", r"[,(]\s*([A-Z][a-zA-Z]{3,})\s+\w+", "uses", 0.4),
]
# Types that say nothing about ownership.
PLAIN_TYPES = [
    "String", "Integer", "Long", "Boolean", "Object", "Double", "Float", "Byte", "Short", "Character", "Void", "Class", "Number", "Comparable", "Serializable", "Cloneable", "Iterable", "Iterator", "Enum",
    "Exception", "RuntimeException", "Error", "Throwable", "Override", "Deprecated", "SuppressWarnings", "FunctionalInterface", "List", "Map", "Set", "Collection", "Optional", "Stream",
    "Arrays", "Collections", "Objects", "Math", "System",
]
# Groups of words that mean about the same.
SEED_GROUPS = {
    "error": ["error", "fehler", "bug", "fault", "exception", "issue"], "function": ["function", "func", "fn", "method", "procedure"], "database": ["database", "db", "storage", "datastore"],
    "config": ["config", "configuration", "settings", "options"], "request": ["request", "req", "query", "call"], "response": ["response", "resp", "reply", "result"],
    "create": ["create", "add", "insert", "new", "make"], "read": ["read", "get", "fetch", "load", "retrieve"], "update": ["update", "modify", "change", "edit", "patch"],
    "delete": ["delete", "remove", "drop", "destroy"], "search": ["search", "find", "lookup", "query"], "user": ["user", "account", "member", "person"], "file": ["file", "document", "asset", "resource"],
    "path": ["path", "route", "endpoint", "url"], "handler": ["handler", "controller", "processor", "worker"], "service": ["service", "server", "backend", "api"],
    "client": ["client", "frontend", "consumer", "requester"], "auth": ["auth", "authentication", "login", "signin"], "cache": ["cache", "caching", "store", "buffer"],
    "log": ["log", "logging", "logger", "trace"], "test": ["test", "spec", "check", "verify"], "async": ["async", "asynchronous", "await", "concurrent"], "sync": ["sync", "synchronous", "blocking"],
}
Rules = list[tuple[str, str, str]]


def layer(path: Column, name: Column, rules: Rules) -> tuple[Column, Column]:
    """(layer, confidence) of the first rule that fits: (path_contains | class_name_suffix | default, pattern, layer)."""
    value, sure = F.lit("unknown"), F.lit(0.3)
    for kind, pattern, found in reversed(rules):
        fits = path.contains(pattern) if kind == "path_contains" else name.endswith(pattern) if kind == "class_name_suffix" else F.lit(True)
        weight = {"path_contains": 0.85, "class_name_suffix": 0.80}.get(kind, 0.3)
        value, sure = F.when(fits, found).otherwise(value), F.when(fits, weight).otherwise(sure)
    return value, sure


def side_effect(name: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(effect, confidence) of the first (pattern, effect) that fits; unknown for names that say nothing, else null."""
    short = (F.length(name) <= 4) & ~F.substring(name, F.lit(2), F.length(name)).rlike("[A-Z]")
    plain = short | ~name.rlike("[a-z][A-Z]|^[a-z]{4,}")
    value, sure = F.when(plain, "unknown"), F.when(plain, 0.2).otherwise(0.1)
    for pattern, effect in reversed(rules):
        value, sure = F.when(name.rlike(pattern), effect).otherwise(value), F.when(name.rlike(pattern), 0.9).otherwise(sure)
    return value, sure


def resource(path: Column, name: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(resource, confidence) of the first keyword in path or class name; null for none."""
    both = F.concat(path, F.lit("/"), name)
    value, sure = F.lit(None).cast("string"), F.lit(0.1)
    for keyword, found in reversed(rules):
        value, sure = F.when(both.contains(keyword), found).otherwise(value), F.when(both.contains(keyword), 0.85).otherwise(sure)
    return value, sure


def confidence(layer_sure: Column, effect_sure: Column, resource_sure: Column) -> Column:
    """Weighted mean over the parts that are set; 0.1 if none is."""
    parts = [(layer_sure, 0.3), (effect_sure, 0.4), (resource_sure, 0.3)]
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts])
    return F.coalesce(F.try_divide(total, weight), F.lit(0.1))


def delegation_role(callee: Column, caller_class: Column, indicators: list[str], mutations: list[str], proxies: list[str]) -> tuple[Column, Column]:
    """(role, confidence) of a call: dispatch, mutation, proxy or unknown."""
    dispatch = reduce(lambda a, b: a | b, [(callee == i) | callee.startswith(i + "(") for i in indicators])
    mutation = reduce(lambda a, b: a | b, [callee.rlike(p) for p in mutations])
    proxy = reduce(lambda a, b: a | b, [caller_class.rlike(p) for p in proxies])
    hidden = (F.length(callee) <= 4) & ~callee.rlike("[a-z][A-Z]")
    role = F.when(dispatch, "dispatch").when(mutation, "mutation").when(proxy, "proxy").otherwise("unknown")
    return role, F.when(dispatch, 0.9).when(mutation, 0.85).when(proxy, 0.8).when(hidden, 0.2).otherwise(0.4)


def summary(name: Column, layer_: Column, effect: Column, resource_: Column) -> Column:
    parts = [name, F.when(effect != "unknown", F.concat(F.lit("["), effect, F.lit("]"))), F.when(layer_ != "unknown", F.concat(F.lit("in "), layer_)), F.when(resource_.isNotNull(), F.concat(F.lit("("), resource_, F.lit(")")))]
    return F.concat_ws(" ", *parts)


def first_callees(calls: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` calls of every caller, by line."""
    order = Window.partitionBy("caller_symbol_id").orderBy("call_line", "id")
    return calls.dropDuplicates(["id"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def annotations(chunks: DataFrame, patterns: list[tuple[str, str, int]]) -> DataFrame:
    """``id, annotation_type, value, evidence_line``: the lines of chunks that fit (type, pattern, group)."""
    lines = chunks.select("id", "start_line", F.posexplode(F.split("content_text", "\n")).alias("n", "line"))
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, g).alias("value"))) for k, p, g in patterns]))
    return lines.select("id", (F.col("start_line") + F.col("n")).alias("evidence_line"), F.explode(found).alias("f")).select("id", F.col("f.kind").alias("annotation_type"), F.col("f.value").alias("value"), "evidence_line")


def relations(classes: DataFrame) -> DataFrame:
    """``name, target, relation, confidence``: what a class body (``name, body``) says about others, the surest once."""

    def related(relation: str, sure: float):
        return lambda m: F.struct(m.alias("target"), F.lit(relation).alias("relation"), F.lit(sure).alias("confidence"))

    found = F.concat(*[F.transform(F.regexp_extract_all("body", F.lit(p), 1), related(r, c)) for _, p, r, c in RELATIONS])
    rows = classes.select("name", F.explode(found).alias("f")).select("name", "f.*").where(~F.col("target").isin(PLAIN_TYPES) & (F.col("target") != F.col("name")) & (F.col("target") != ""))
    return rows.groupBy("name", "target", "relation").agg(F.max("confidence").alias("confidence"))


# Where names are taken from, by languages: pattern with the name as its group, and whether only plain names of assignments count.
IDENTIFIERS = [
    (["rust"], [(r"\bfn\s+(\w+)\s*[<(]", False), (r"\bstruct\s+(\w+)", False), (r"\benum\s+(\w+)", False), (r"\btrait\s+(\w+)", False), (r"\bimpl(?:\s*<[^>]*>)?\s+(\w+)", False), (r"\btype\s+(\w+)", False), (r"\bconst\s+(\w+)", False)]),
    (["python"], [(r"\bdef\s+(\w+)\s*\(", False), (r"\bclass\s+(\w+)", False), (r"(?m)^(\w+)\s*=\s*[^=]", True)]),
    (["typescript", "javascript"], [(r"\bfunction\s+(\w+)\s*[<(]", False), (r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", False), (r"\bclass\s+(\w+)", False), (r"\binterface\s+(\w+)", False), (r"\btype\s+(\w+)", False)]),
    (["go"], [(r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*[<(]", False), (r"\btype\s+(\w+)", False), (r"(?m)^\s+([A-Z]\w+)\s+\w", False)]),
]


def identifiers(texts: DataFrame) -> DataFrame:
    """``id, name``: the declared names of source texts (id, language, text), by the rules of their language."""
    name = F.col("name")
    plain = (~name.startswith("_") & (F.upper(name) == name) & (F.lower(name) != name)) | name.rlike(r"^\p{Ll}")
    found = F.lit(None).cast("array<struct<name:string,assigned:boolean>>")

    def named(assigned: bool):
        return lambda x: F.struct(x.alias("name"), F.lit(assigned).alias("assigned"))

    for languages, rules in IDENTIFIERS:
        names = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p.replace("(?m)", "(?dm)")), 1), named(a)) for p, a in rules])
        found = F.when(F.col("language").isin(languages), names).otherwise(found)
    return texts.select("id", F.explode(found).alias("f")).select("id", "f.*").where(~F.col("assigned") | plain).select("id", "name").distinct()


def word_frequency(identifiers: DataFrame, comments: DataFrame) -> DataFrame:
    """``word, weight``: words of distinct identifiers (``name``) three times, of comments (``text``) twice."""
    a = identifiers.select("name").distinct().select(F.explode(tx.identifier_words(F.col("name"))).alias("word")).groupBy("word").agg((F.count("*") * 3).alias("n"))
    plain = F.filter(tx.words(F.col("text")), lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$"))
    b = comments.select(F.explode(plain).alias("word")).groupBy("word").agg((F.count("*") * 2).alias("n"))
    return a.unionByName(b).groupBy("word").agg(F.sum("n").alias("weight"))


def synonym_groups(frequency: DataFrame, least: int = 2) -> DataFrame:
    """``term, aliases``: seed groups of which at least two words are frequent, the most frequent one as term, five aliases."""
    seeds = frequency.sparkSession.createDataFrame([(g, w) for g, ws in SEED_GROUPS.items() for w in ws], "seed string, word string")
    present = frequency.where(F.col("weight") >= least).join(F.broadcast(seeds), "word").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "word"))).alias("ws")).where(F.size("ws") >= 2)
    return present.select(F.get("ws", 0)["word"].alias("term"), F.transform(F.slice("ws", 2, 5), lambda x: x["word"]).alias("aliases"))


def similar_words(words: DataFrame, most: int = 5) -> DataFrame:
    """``word, aliases``: leftover words with the same first four letters, nearest in the alphabet first.

    Words are joined by their first four letters only; each keeps ``most`` partners, as the operator is defined.
    """
    rows = words.where(F.length("word") >= 4).select("word", F.substring("word", 1, 4).alias("head"))
    order = Window.partitionBy("head").orderBy("word")
    near = rows.select("word", *[F.lead("word", k).over(order).alias(f"n{k}") for k in range(1, most + 1)])
    return near.select("word", F.array_compact(F.array(*[f"n{k}" for k in range(1, most + 1)])).alias("aliases")).where(F.size("aliases") > 0)
