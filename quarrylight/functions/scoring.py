"""Columns that weigh queries and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much a candidate counts by the kind of its chunk.
TYPE_BOOST = {"function": 1.4, "class": 1.35, "module": 1.3, "type": 1.25, "code": 1.2, "conversation": 1.1, "text": 0.7}
DOMAIN_TYPE_BOOST = {"function": 1.3, "class": 1.25, "type": 1.2, "module": 1.1, "code": 0.85, "text": 0.5}
LEVEL_BOOST = {2: 1.15, 1: 1.05, 0: 0.9}
DOMAIN_LEVEL_BOOST = {2: 1.2, 1: 1.1, 0: 0.8}
# Path classes in their order: parts of the lower-case path, its ending ('' for any), factor.
PATH_BOOST = [
    (["changelog", "changes"], "", 0.15),
    (["golden-set", "golden_set"], "", 0.1),
    (["/eval/"], ".jsonl", 0.1),
    (["license", "support.md", "contributing", "code_of_conduct"], "", 0.2),
    (["/testdata/", "/test/fixtures/", "/test/testdata/", "_testdata", "/conformance/testdata/"], "", 0.15),
    (["/test", "_test.", ".test.", "/spec/", "_test_", "/tests/"], "", 0.4),
    (["/vendor/", "/third_party/", "/node_modules/"], "", 0.6),
    ([".pb.", "generated", "/zz_generated", ".gen."], "", 0.5),
    (["openapi-spec", "swagger"], "", 0.3),
    (["openapi"], ".json", 0.3),
]
# Factors by file extension; 0.9 for others.
EXTENSION_BOOST = {
    1.2: ["rs", "go", "py", "ts", "js", "java", "c", "cpp", "cs", "rb", "php", "lua", "zig", "swift", "kt"],
    1.0: ["sql", "toml", "yaml", "yml", "json"],
    0.95: ["sh", "bash", "zsh"],
    0.6: ["md", "txt", "rst", "adoc"],
    0.85: ["jsonl"],
    0.5: ["csv", "xml"],
    0.8: ["html", "css", "scss"],
}
# Upper bounds of a content's size in bytes, and factors.
LENGTH_BOOST = [(30, 0.3), (80, 0.6), (200, 0.85), (3000, 1.0), (6000, 0.9)]
QUERY_WEIGHT = {"code": 1.5, "natural": 1.2, "mixed": 1.0}
# What a query asks for, the first family with a word in it.
INTENTS = {
    "delete": ["delete", "remove", "clear", "erase", "destroy", "drop"],
    "create": ["create", "add", "new", "make", "insert", "generate"],
    "read": ["get", "find", "read", "fetch", "list", "show", "query"],
    "modify": ["set", "update", "change", "modify", "edit", "toggle"],
}


def _choose(column: Column, factors: dict, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for value, factor in reversed(factors.items()):
        out = F.when(column == F.lit(value), F.lit(factor)).otherwise(out)
    return out


def type_boost(chunk_type: Column) -> Column:
    return _choose(F.coalesce(chunk_type, F.lit("code")), TYPE_BOOST, 1.0)


def path_boost(path: Column) -> Column:
    """The factor of the first path class that fits, else of the extension."""
    extension = F.regexp_extract(path, r"([^.]*)$", 1)
    out = F.lit(0.9)
    for factor, extensions in EXTENSION_BOOST.items():
        out = F.when(extension.isin(extensions), F.lit(factor)).otherwise(out)
    low = F.lower(path)
    for parts, end, factor in reversed(PATH_BOOST):
        fits = F.lit(False)
        for part in parts:
            fits = fits | low.contains(part)
        out = F.when(fits & low.endswith(end) if end else fits, F.lit(factor)).otherwise(out)
    return out


def length_boost(size: Column) -> Column:
    out = F.lit(0.75)
    for bound, factor in reversed(LENGTH_BOOST):
        out = F.when(size <= bound, F.lit(factor)).otherwise(out)
    return out


def level_boost(level: Column) -> Column:
    return _choose(F.coalesce(level.cast("int"), F.lit(1)), LEVEL_BOOST, 1.0)


def domain_boost(chunk_type: Column, level: Column, profiled: Column) -> Column:
    own = _choose(F.coalesce(chunk_type, F.lit("code")), DOMAIN_TYPE_BOOST, 1.0) * _choose(F.coalesce(level.cast("int"), F.lit(0)), DOMAIN_LEVEL_BOOST, 1.0)
    return F.when(profiled, own).otherwise(F.lit(1.0))


def popularity_boost(callers: Column) -> Column:
    return F.when(callers > 0, 1 + 0.1 * F.log2(callers + F.lit(1.0))).otherwise(F.lit(1.0))


def query_type(query: Column) -> Column:
    """code, natural or mixed, by signs of code and the number of words."""
    signs = [query.contains("."), query.contains("::"), query.contains("->"), query.contains("_"), query.contains("/"), query.rlike(r"\p{Ll}\p{Lu}")]
    code = sum((s.cast("int") for s in signs), F.lit(0))
    count = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return F.when((code >= 2) | ((code >= 1) & (count <= 3)), "code").when((count >= 4) & (code == 0), "natural").otherwise("mixed")


def query_weight(kind: Column) -> Column:
    return _choose(kind, QUERY_WEIGHT, 1.0)


def quoted_phrase(query: Column) -> Column:
    """The inside of a query that is wholly quoted, else null."""
    plain = F.trim(query)
    quoted = (plain.startswith('"') & plain.endswith('"')) | (plain.startswith("'") & plain.endswith("'"))
    return F.when(quoted & (F.length(plain) >= 2), F.substring(plain, F.lit(2), F.length(plain) - 2))


def intent(query: Column) -> Column:
    low, out = F.lower(query), F.lit(None).cast("string")
    for name, keywords in reversed(INTENTS.items()):
        fits = F.lit(False)
        for word in keywords:
            fits = fits | low.contains(word)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def reciprocal_rank_sum(semantic: Column, lexical: Column, weight: Column, k: int = 60, overlap: float = 1.5) -> Column:
    """Fused score of two ranks from 1 (null where absent); candidates on both lists count more."""
    both = F.coalesce(1 / (k + semantic), F.lit(0.0)) + F.coalesce(weight / (k + lexical), F.lit(0.0))
    return F.when(semantic.isNotNull() & lexical.isNotNull(), both * overlap).otherwise(both)
