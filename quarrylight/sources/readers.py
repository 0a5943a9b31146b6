"""Readers of small configuration files, and of pages and blocks of printed documents."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """``id, mode, query, source, k, expected, category`` of a file of JSON lines; blank lines and those with # are left out."""
    return golden_rows(spark.read.text(path))


def golden_rows(lines: DataFrame) -> DataFrame:
    """The same of the lines themselves (column ``value``)."""
    lines = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    schema = "id string, mode string, query string, source string, k int, expect_files array<string>, category string"
    x = lines.select(F.from_json("value", schema).alias("x"))
    return x.select("x.id", F.coalesce("x.mode", F.lit("hybrid")).alias("mode"), "x.query", "x.source", F.coalesce("x.k", F.lit(10)).alias("k"), F.coalesce("x.expect_files", F.array().cast("array<string>")).alias("expected"), "x.category")


def domain_profile(path: str) -> dict:
    """Rules of one domain (a TOML file): layers, side effects, resources, annotations, delegation and query mappings, in the forms the enrichment takes."""
    with open(path, encoding="utf-8") as f:
        return profile_of(f.read())


def profile_of(text: str) -> dict:
    """The same of the text itself."""
    raw = tomllib.loads(text)
    return {
        "name": raw.get("name", ""),
        "layers": [(r["pattern_type"], r.get("pattern", ""), r["layer"]) for r in raw.get("layers", [])],
        "side_effects": [(p, r["effect"]) for r in raw.get("side_effects", []) for p in r["name_patterns"]],
        "resources": [(k, r["resource"]) for r in raw.get("resources", []) for k in r["path_or_class_keywords"]],
        "annotations": [(r["annotation_type"], r["regex"], r.get("capture_group", 0)) for r in raw.get("annotations", [])],
        "delegation": raw.get("delegation", {}),
        "query_mappings": [(t, s) for r in raw.get("query_mappings", []) for t in r["nl_terms"] for s in r["symbols"]],
    }


def profile_rules(spark: SparkSession, profile: dict) -> DataFrame:
    """``kind, pattern, value``: the rules of a profile as a table, to be joined with names and paths."""
    rows = [("layer", p, x) for _, p, x in profile["layers"]] + [("side_effect", p, x) for p, x in profile["side_effects"]] + [("resource", p, x) for p, x in profile["resources"]]
    rows += [("annotation", p, x) for x, p, _ in profile["annotations"]] + [("query_mapping", p, x) for p, x in profile["query_mappings"]]
    return spark.createDataFrame(rows, "kind string, pattern string, value string")


def printed_chunks(blocks: DataFrame, size: int = 768, overlap: int = 96, least: int = 80) -> DataFrame:
    """``doc_id, piece, heading, text, first_page, last_page`` of blocks (doc_id, n, page, level, text) of printed documents.

    A heading (level above 0) ends the piece before it; pieces are flushed at ``size`` characters and repeat the last
    ``overlap``; those under ``least`` are left out, but not below a heading.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out, heading, held, pages = [], "", "", []

        def flush(keep: bool) -> None:
            nonlocal held, pages
            plain = held.strip()
            if plain and (len(plain) >= least or heading):
                out.append((key[0], len(out), heading, plain, min(pages), max(pages)))
            held = plain[-overlap:] + "\n" if keep and len(plain) > overlap else ""
            pages = pages[-1:] if held else []

        for r in rows.sort_values("n").itertuples(index=False):
            if r.level and r.level > 0:
                flush(False)
                heading = r.text.strip()
                continue
            pages.append(int(r.page))
            held += r.text + "\n"
            while len(held) >= size:
                flush(True)
                pages = pages or [int(r.page)]
                if len(held) >= size:
                    break
        if held.strip():
            flush(False)
        return pd.DataFrame(out, columns=["doc_id", "piece", "heading", "text", "first_page", "last_page"])

    return blocks.groupBy("doc_id").applyInPandas(run, "doc_id long, piece long, heading string, text string, first_page long, last_page long")


def font_levels(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, n, page, size, text) with a heading ``level`` by font size: over 1.6, 1.3 or 1.15 times the document's usual size."""
    usual = blocks.groupBy("doc_id").agg(F.percentile("size", 0.5, F.length("text")).alias("usual"))
    ratio = F.col("size") / F.col("usual")
    short = F.length("text") < 200
    return blocks.join(usual, "doc_id").select("doc_id", "n", "page", F.when(short & (ratio > 1.6), 1).when(short & (ratio > 1.3), 2).when(short & (ratio > 1.15), 3).otherwise(0).alias("level"), "text")

