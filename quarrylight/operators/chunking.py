"""Chunks of files and chats, and the symbols and calls within them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core import syntax
from quarrylight.functions import text as tx
from quarrylight.sources import adapters

def windows_of_characters(texts: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``id, ordinal, piece, start_line``: overlapping windows; the last one reaches the end."""
    step = size - overlap
    last = F.when(F.length("text") > size, F.ceil((F.length("text") - size) / step)).otherwise(F.lit(0)).cast("long")
    cut = texts.where(F.length("text") > 0).select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("ordinal"))
    start = (F.col("ordinal") * step).cast("int")
    before = F.substring(F.col("text"), F.lit(1), start)
    return cut.select("id", "ordinal", F.substring(F.col("text"), start + 1, F.lit(size)).alias("piece"), (1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("long").alias("start_line"))


def windows_of_tokens(texts: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """``doc_id, ordinal, piece``: the same over word tokens."""
    step = size - overlap
    tokens = texts.select("doc_id", tx.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    last = F.when(F.size("ws") > size, F.ceil((F.size("ws") - size) / step)).otherwise(F.lit(0)).cast("long")
    cut = tokens.select("doc_id", "ws", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("ordinal"))
    return cut.select("doc_id", "ordinal", F.array_join(F.slice("ws", (F.col("ordinal") * step + 1).cast("int"), F.lit(size)), " ").alias("piece"))


def within_budget(chunks: DataFrame, most: int = 500, most_plain: int = 500) -> DataFrame:
    """The first chunks of each file: ``most``, or fewer where no chunk is part of a conversation."""
    by_file = Window.partitionBy("file_id")
    plain = F.bool_and(F.coalesce("chunk_type", F.lit("code")) != "conversation").over(by_file)
    ranked = chunks.withColumn("_rank", F.row_number().over(by_file.orderBy(F.col("start_line").asc_nulls_last(), "id"))).withColumn("_most", F.when(plain, min(most, most_plain)).otherwise(most))
    return ranked.where("_rank <= _most").drop("_rank", "_most")


def unchanged_files(chunks: DataFrame, version: str) -> DataFrame:
    """``file_id, unchanged, pieces``: whether all stored hashes still hold and were made by ``version``."""
    same = (F.lower(F.hex("content_hash")) == F.sha2("content_text", 256)) & (F.coalesce("chunker_version", F.lit("")) == version)
    return chunks.groupBy("file_id").agg(F.bool_and(same).alias("unchanged"), F.count("*").alias("pieces"))


def packed_turns(turns: DataFrame, most: int = 4000, least: int = 500) -> DataFrame:
    """``doc_id, piece, first_turn, messages, roles, text``: turns joined until the next would pass ``most`` once ``least`` is reached."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out, held, size = [], [], 0

        def flush() -> None:
            if held:
                out.append((key[0], len(out), held[0][0], len(held), ",".join(dict.fromkeys(h[1] for h in held)), "\n\n".join(f"[{r}] {b}" for _, r, b in held)))
                held.clear()

        for turn, role, body in rows.sort_values("turn")[["turn", "role", "body"]].itertuples(index=False):
            length = len(role) + len(body) + 3
            if size + length > most and size >= least:
                flush()
                size = 0
            held.append((turn, role, body))
            size += length
        flush()
        return pd.DataFrame(out, columns=["doc_id", "piece", "first_turn", "messages", "roles", "text"])

    return turns.groupBy("doc_id").applyInPandas(run, "doc_id long, piece long, first_turn long, messages long, roles string, text string")


def _over_files(files: DataFrame, per_file, columns: list[str], schema: str) -> DataFrame:
    """Rows of ``per_file(language, text)`` of every file; the path tells a language that isn't given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, la, t in zip(b["id"], b["language"], b["text"], strict=True) for x in per_file(la, t)]
            yield pd.DataFrame(rows, columns=["file_id", *columns])

    language = F.coalesce("language", adapters.language_of(F.col("path"))) if "path" in files.columns else F.col("language")
    texts = files.where("content_text is not null").select("id", language.alias("language"), F.regexp_replace("content_text", "\r\n", "\n").alias("text")).where("language is not null and language <> 'unknown'")
    return texts.mapInPandas(run, f"file_id long, {schema}")


def declared_symbols(files: DataFrame) -> DataFrame:
    """``file_id, line_start, line_end, type, name, qualified_name, signature, visibility``: the declarations of every file.

    A name is qualified by the class, struct, trait or module around it; the signature is the first line. Files in
    languages without rules, and null texts, give no row; a broken file gives what is whole in it.
    """

    def per_file(language: str, text: str):
        units, _ = syntax.parse(text, language)
        starts = syntax.line_numbers(text)
        for u, qualified in syntax.symbols(units):
            first = syntax.line_of(starts, u.start)
            line = text[starts[first - 1] : starts[first] if first < len(starts) else len(text)].strip()
            yield first, syntax.line_of(starts, u.stop - 1), u.kind, u.name, qualified or u.name, line, u.visibility

    columns = ["line_start", "line_end", "type", "name", "qualified_name", "signature", "visibility"]
    return _over_files(files, per_file, columns, "line_start long, line_end long, type string, name string, qualified_name string, signature string, visibility string")


def calls(files: DataFrame) -> DataFrame:
    """``file_id, caller, callee, call_type, call_line``: every call with the function around it, ``<global>`` outside of any.

    The callee is the text before the bracket, in java, ruby and php the bare name; the type is direct, method, static
    or constructor; the line is where the call's text begins.
    """

    def per_file(language: str, text: str):
        starts = syntax.line_numbers(text)
        for c in syntax.parse(text, language)[1]:
            yield c.caller or "<global>", c.callee, c.kind, syntax.line_of(starts, c.at)

    return _over_files(files, per_file, ["caller", "callee", "call_type", "call_line"], "caller string, callee string, call_type string, call_line long")


def syntax_units(files: DataFrame, least_gap: int = 20) -> DataFrame:
    """``file_id, ordinal, chunk_type, name, level, parent, start_line, end_line, text``: units of the syntax, and what stands between.

    ``parent`` is the ordinal of the piece around a unit, of later parts of one unit that of its first; null for none.
    Units with too many tokens are cut; files without units are cut by tokens alone. Blank files give no row.
    """

    def per_file(language: str, text: str):
        starts = syntax.line_numbers(text)
        for n, (kind, name, level, parent, a, b) in enumerate(syntax.chunks(text, language, least_gap)):
            yield n, kind, name, level, None if parent < 0 else parent, syntax.line_of(starts, a), syntax.line_of(starts, max(a, b - 1)), text[a:b]

    columns = ["ordinal", "chunk_type", "name", "level", "parent", "start_line", "end_line", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, la, t in zip(b["id"], b["language"], b["text"], strict=True) for x in per_file(la, t)]
            yield pd.DataFrame(rows, columns=["file_id", *columns]).astype({"parent": "Int64"})

    language = F.coalesce("language", adapters.language_of(F.col("path"))) if "path" in files.columns else F.coalesce("language", F.lit("unknown"))
    texts = files.where("content_text is not null").select("id", language.alias("language"), F.regexp_replace("content_text", "\r\n", "\n").alias("text"))
    return texts.mapInPandas(run, "file_id long, ordinal long, chunk_type string, name string, level int, parent long, start_line long, end_line long, text string")


def visibility(signature: Column, name: Column, language: Column) -> Column:
    """The modifier a declaration begins with, else what its name says, else null."""
    found = F.regexp_extract(signature, r"^\s*(public|private|protected|internal|pub|export)\b", 1)
    return F.when(found != "", found).when((language == "go") & name.rlike("^[A-Z]"), "public").when(name.startswith("_"), "private")
