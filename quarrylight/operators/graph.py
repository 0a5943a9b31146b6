"""Calls, chains, ownership and reachability over symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core.storage import cut

# Callees that never lead anywhere.
NOISE = ["SWC", "r3B", "assert", "equals", "toString", "isControlSurfaceThread", "isDocumentThread", "exec", "deprecated"]


def edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``caller_id, caller, callee_id, callee, call_line``: distinct calls by symbol; an unresolved callee has no id."""
    named = symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")).distinct()
    return calls.select(F.col("caller_symbol_id").alias("caller_id"), F.col("callee_symbol_id").alias("callee_id"), F.col("callee_name").alias("callee"), "call_line").distinct().join(named, "caller_id")


def callers(name: str, symbols: DataFrame, calls: DataFrame, files: DataFrame, limit: int = 100) -> DataFrame:
    """``path, call_line, caller, symbol_id``: who calls ``name``, by path and line."""
    who = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("caller"), "file_id").distinct()
    found = calls.where(F.col("callee_name") == name).select(F.col("caller_symbol_id").alias("symbol_id"), "call_line").distinct().join(who, "symbol_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return found.select("path", "call_line", "caller", "symbol_id").orderBy("path", "call_line", "symbol_id").limit(limit)


def callees(name: str, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``symbol_id, callee, call_line, resolved``: what the symbols of this name call."""
    who = symbols.where(F.col("name") == name).select(F.col("id").alias("symbol_id")).distinct()
    found = calls.select(F.col("caller_symbol_id").alias("symbol_id"), F.col("callee_name").alias("callee"), "call_line", F.col("callee_symbol_id").isNotNull().alias("resolved")).distinct()
    return found.join(who, "symbol_id", "left_semi")


def neighbourhood(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``symbol_id, name, callers, callees``: how many distinct symbols call each one, and how many names it calls."""
    out = calls.groupBy(F.col("caller_symbol_id").alias("symbol_id")).agg(F.countDistinct("callee_name").alias("callees"))
    into = calls.where("callee_symbol_id is not null").groupBy(F.col("callee_symbol_id").alias("symbol_id")).agg(F.countDistinct("caller_symbol_id").alias("callers"))
    who = symbols.select(F.col("id").alias("symbol_id"), "name").distinct()
    zero = F.lit(0).cast("long")
    return who.join(into, "symbol_id", "left").join(out, "symbol_id", "left").select("symbol_id", "name", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"))


def chain(start: str, symbols: DataFrame, calls: DataFrame, direction: str = "callees", depth: int = 5, per_level: int = 20, most: int = 100) -> DataFrame:
    """``depth, name, symbol_id``: breadth-first over names, at most ``per_level`` new names a level, ``most`` in all.

    A level asks the tables only for the calls of its names (at most ``per_level``, so they come to the driver); nothing
    is moved for names that the walk doesn't meet.
    """
    found: dict[str, tuple[int, int | None]] = {start: (0, None)}
    frontier = [start]
    for level in range(1, max(1, min(10, depth)) + 1):
        near = _called(frontier, symbols, calls) if direction == "callees" else _calling(frontier, symbols, calls)
        new = near.where(F.col("name").isNotNull() & ~F.col("name").isin(NOISE) & ~F.col("name").isin(list(found))).groupBy("name").agg(F.min("id").alias("id")).orderBy("name").limit(per_level)
        fresh = {r["name"]: (level, r["id"]) for r in new.collect()}
        found |= fresh
        frontier = list(fresh)
        if not frontier or len(found) > most:
            break
    rows = sorted((d, n, i) for n, (d, i) in found.items() if d)[:most]
    return symbols.sparkSession.createDataFrame(rows, "depth int, name string, symbol_id long")


def _called(names: list[str], symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``name, id``: what the symbols of these names call."""
    who = symbols.where(F.col("name").isin(names)).select(F.col("id").alias("caller_symbol_id")).distinct()
    return calls.join(who, "caller_symbol_id", "left_semi").select(F.col("callee_name").alias("name"), F.col("callee_symbol_id").alias("id"))


def _calling(names: list[str], symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``name, id``: the symbols that call these names."""
    who = calls.where(F.col("callee_name").isin(names)).select(F.col("caller_symbol_id").alias("id")).distinct()
    return symbols.join(who, "id", "left_semi").select("name", "id")


def resolved_chain(start: str, symbols: DataFrame, calls: DataFrame, depth: int = 4, fan_out: int = 10) -> DataFrame:
    """``depth, symbol_id, path``: paths over resolved calls without repeats, at most ``fan_out`` callees of a symbol, by id."""
    order = Window.partitionBy("caller_id").orderBy("callee_id")
    steps = edges(symbols, calls).where("callee_id is not null and callee_id <> caller_id").select("caller_id", "callee_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= fan_out).drop("n")
    steps = cut(steps)
    at = symbols.where(F.col("name") == start).select(F.col("id").alias("symbol_id")).distinct().select(F.lit(0).alias("depth"), "symbol_id", F.array("symbol_id").alias("path"))
    out = at
    for level in range(1, depth + 1):
        at = cut(at.join(steps, F.col("symbol_id") == F.col("caller_id")).where(~F.array_contains("path", F.col("callee_id"))).select(F.lit(level).alias("depth"), F.col("callee_id").alias("symbol_id"), F.array_append("path", F.col("callee_id")).alias("path")))
        out = out.unionByName(at)
    return out


def proven_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``callee, symbol_id, proven, candidates``: a called name is proven if exactly one symbol bears it."""
    by_name = symbols.where("type in ('function', 'method')").groupBy("name").agg(F.countDistinct("id").alias("candidates"), F.min("id").alias("only"))
    called = calls.select(F.col("callee_name").alias("name")).distinct()
    joined = called.join(by_name, "name", "left")
    proven = F.coalesce(F.col("candidates") == 1, F.lit(False))
    return joined.select(F.col("name").alias("callee"), F.when(proven, F.col("only")).alias("symbol_id"), proven.alias("proven"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def reachable(roots: DataFrame, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``id``: everything that can be reached from ``roots`` over ``links`` (here, there). Ends when nothing is new."""
    seen = cut(roots.select("id").distinct())
    fresh = seen
    for _ in range(most_rounds):
        new = fresh.join(links, fresh["id"] == links["here"]).select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti")
        fresh = cut(new)
        if not fresh.limit(1).count():
            return seen
        seen = cut(seen.unionByName(fresh))
    raise ValueError("reachability didn't end")


def primary_targets(targets: DataFrame) -> DataFrame:
    """``symbol_id, callee, why``: the one delegation target of each symbol.

    First a name that overlaps its own (both over three letters), then a dispatch or mutation, then the surest known, then the surest.
    """
    name, callee = F.lower("name"), F.lower("callee")
    alike = (F.length("name") > 3) & (F.length("callee") > 3) & (name.contains(callee) | callee.contains(name))
    why = F.when(alike, 1).when(F.col("role").isin("dispatch", "mutation"), 2).when(F.col("role") != "unknown", 3).otherwise(4)
    order = Window.partitionBy("symbol_id").orderBy("why", F.col("confidence").desc_nulls_last(), "callee")
    return targets.withColumn("why", why).withColumn("n", F.row_number().over(order)).where("n = 1").select("symbol_id", "callee", F.col("why").cast("long").alias("why"))


def stable_keys(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_id, key``: a hash of where and what a symbol is; overloads differ by signature, then by order."""
    from quarrylight.functions.text import framed_hash

    rows = symbols.dropDuplicates(["id"]).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    rows = rows.withColumn("qualified", F.coalesce("qualified_name", "name", F.lit(""))).withColumn("flat", F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", ""))
    same = Window.partitionBy("path", "language", "type", "qualified", "flat").orderBy("line_start", "id")
    rows = rows.withColumn("n", F.row_number().over(same) - 1)
    return rows.select(F.col("id").alias("symbol_id"), framed_hash(F.col("path"), F.coalesce("language", F.lit("")), F.col("type"), F.col("qualified"), F.col("flat"), F.col("n").cast("string")).alias("key"))
