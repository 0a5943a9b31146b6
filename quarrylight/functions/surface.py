"""The library from SQL: temporary functions, table functions, and a data source of session files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from quarrylight.core import syntax

_WORDS = r"filter(split(lower(t), r'[^\p{L}\p{N}_]+'), w -> w <> '')"
#: Scalar functions: parameters, what comes back, and how.
SCALARS = {
    "ql_words": ("t STRING", "ARRAY<STRING>", _WORDS),
    "ql_identifiers": ("t STRING", "ARRAY<STRING>", r"array_sort(array_distinct(filter(ql_words(t), w -> w rlike r'_|\p{N}')))"),
    "ql_has_phrase": ("t STRING, p STRING", "BOOLEAN", "size(ql_words(p)) > 0 AND contains(concat(chr(31), array_join(ql_words(t), chr(31)), chr(31)), concat(chr(31), array_join(ql_words(p), chr(31)), chr(31)))"),
    "ql_jaccard": ("a STRING, b STRING", "DOUBLE", "coalesce(try_divide(size(array_intersect(ql_words(a), ql_words(b))), size(array_union(ql_words(a), ql_words(b)))), 0D)"),
    "ql_location": ("path STRING, first INT, last INT", "STRING", "concat(path, ':', first, '-', last)"),
}
#: The words of one text with their counts and first places: its words sorted by place are cut where the next word begins.
#: A GROUP BY here would make a lateral call join the texts with themselves and move each beside every one of its words.
_POSTINGS = f"""transform(array(array_sort(transform({_WORDS}, (w, i) -> struct(w, i)))), s ->
    transform(array(filter(transform(s, (x, i) -> if(i = 0 OR s[i - 1].w <> x.w, i, -1)), i -> i >= 0)), starts ->
        transform(starts, (i, k) -> struct(s[i].w AS term, CAST(coalesce(get(starts, k + 1), size(s)) - i AS BIGINT) AS tf, CAST(s[i].i + 1 AS BIGINT) AS first_position)))[0])[0]"""
#: Table functions in SQL: parameters, columns, query.
TABLES = {
    "ql_postings": ("t STRING", "term STRING, tf BIGINT, first_position BIGINT", f"SELECT * FROM inline({_POSTINGS})"),
}


@udtf(returnType="type string, name string, qualified_name string, line_start long, line_end long, visibility string")
class Symbols:
    """The declarations of one source text."""

    def eval(self, text: str, language: str):
        if text is None or language is None:
            return
        starts = syntax.line_numbers(text)
        for u, qualified in syntax.symbols(syntax.parse(text, language)[0]):
            yield u.kind, u.name, qualified or u.name, syntax.line_of(starts, u.start), syntax.line_of(starts, u.stop - 1), u.visibility


@udtf(returnType="caller string, callee string, call_type string, call_line long")
class Calls:
    """The calls within one source text."""

    def eval(self, text: str, language: str):
        if text is None or language is None:
            return
        starts = syntax.line_numbers(text)
        for c in syntax.parse(text, language)[1]:
            yield c.caller or "<global>", c.callee, c.kind, syntax.line_of(starts, c.at)


class _File(InputPartition):
    def __init__(self, place: str):
        self.place = place


class _Reader(DataSourceReader):
    def __init__(self, place: str):
        self.place = place

    def partitions(self):
        """One task a file; the folder must be one that all executors see."""
        if not os.path.isdir(self.place):
            return [_File(self.place)]
        return [_File(os.path.join(folder, f)) for folder, _, files in sorted(os.walk(self.place)) for f in sorted(files) if not f.startswith((".", "_"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[Row]:
        if not partition.place:
            return
        from quarrylight.sources.adapters import session_lines

        with open(partition.place, encoding="utf-8", errors="replace") as lines:
            for n, line in enumerate(lines, 1):
                try:
                    data = json.loads(line)
                except ValueError:
                    continue
                for role, text in session_lines(data):
                    yield Row(file=partition.place, line=n, role=role, text=text)


class Sessions(DataSource):
    """``spark.read.format("ql_sessions").load(folder)``: the messages of assistant sessions kept as JSON lines."""

    @classmethod
    def name(cls) -> str:
        return "ql_sessions"

    def schema(self) -> str:
        return "file string, line long, role string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file:"))


def register(spark: SparkSession) -> None:
    """Makes all of this known to ``spark``; once more does no harm."""
    for name, (parameters, back, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {back} RETURN {body}")
    for name, (parameters, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    spark.udtf.register("ql_symbols", Symbols)
    spark.udtf.register("ql_calls", Calls)
    spark.dataSource.register(Sessions)
