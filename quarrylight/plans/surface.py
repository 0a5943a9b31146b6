"""The library asked through SQL functions and as a data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.core.storage import checkpoint_dir, cut, remove
from quarrylight.functions import surface
from quarrylight.plans.registry import Plans
from quarrylight.plans.texts import sql_words
from quarrylight.sources import adapters

P = Plans()


def _ask(t, query: str, **tables):
    surface.register(t.spark)
    return t.spark.sql(query, **tables)


@P.add("api_scalar_functions", f"""SELECT doc_id, len({sql_words('text')}) AS words, list_sort(list_distinct(list_filter({sql_words('text')}, lambda w: regexp_matches(w, '_|\\p{{N}}')))) AS identifiers,
    contains(chr(31) || array_to_string({sql_words('text')}, chr(31)) || chr(31), chr(31) || 'posting' || chr(31) || 'lists' || chr(31)) AS found, 'a:' || 1 || '-' || 2 AS place FROM documents WHERE text IS NOT NULL""")
def _(t):
    return _ask(t, "SELECT doc_id, size(ql_words(text)) AS words, ql_identifiers(text) AS identifiers, ql_has_phrase(text, 'Posting lists') AS found, ql_location('a', 1, 2) AS place FROM {d} WHERE text IS NOT NULL", d=t.documents)


@P.add("api_jaccard", f"""WITH w AS (SELECT doc_id, kind, {sql_words('text')} AS ws FROM documents WHERE text IS NOT NULL), f AS (SELECT kind, arg_min(ws, doc_id) AS fs FROM w WHERE kind IS NOT NULL GROUP BY 1)
    SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(ws, fs))) > 0 THEN len(list_intersect(ws, fs)) / len(list_distinct(list_concat(ws, fs))) ELSE 0 END::DOUBLE, 6) AS jaccard FROM w JOIN f USING (kind)""")
def _(t):
    """Every document beside the first of its kind."""
    first = t.documents.where("text is not null and kind is not null").groupBy("kind").agg(F.min_by("text", "doc_id").alias("other"))
    return _ask(t, "SELECT doc_id, round(ql_jaccard(text, other), 6) AS jaccard FROM {d} JOIN {f} USING (kind) WHERE text IS NOT NULL", d=t.documents, f=first)


@P.add("api_table_function", f"""SELECT doc_id, term, count(*) AS tf, min(p) AS first_position FROM (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, {sql_words('text')} AS ws FROM documents)) GROUP BY ALL""")
def _(t):
    return _ask(t, "SELECT doc_id, p.* FROM {d} AS d, LATERAL ql_postings(d.text) AS p", d=t.documents)


@P.add("api_symbols_function")
def _(t):
    """The same declarations as ``parse_symbols`` for files whose language is given, asked in SQL."""
    return _ask(t, "SELECT id AS file_id, s.* FROM {f} AS f, LATERAL ql_symbols(replace(f.content_text, '\\r\\n', '\\n'), f.language) AS s", f=t.files)


@P.add("api_calls_function")
def _(t):
    return _ask(t, "SELECT id AS file_id, c.* FROM {f} AS f, LATERAL ql_calls(replace(f.content_text, '\\r\\n', '\\n'), f.language) AS c", f=t.files)


@P.add("api_data_source", """
    SELECT regexp_extract(line, '^\\[(\\w+)\\] ', 1) AS role, substr(line, length(regexp_extract(line, '^\\[\\w+\\] ', 0)) + 1) AS text, count(*) AS n
    FROM (SELECT unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\[\\w+\\] '))) AS line FROM documents WHERE kind = 'chat') WHERE trim(substr(line, length(regexp_extract(line, '^\\[\\w+\\] ', 0)) + 1)) <> '' GROUP BY ALL""")
def _(t):
    """The turns of chats, written as session files and read as a source."""
    surface.register(t.spark)
    place = f"{checkpoint_dir(t.spark)}/sessions-{uuid.uuid4().hex}"
    turns = adapters.chat_turns(t.documents.where("kind = 'chat'"))
    turns.select(F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("body").alias("content")).alias("message"))).alias("value")).write.text(place)
    found = cut(t.spark.read.format("ql_sessions").load(place).groupBy("role", "text").agg(F.count("*").alias("n")))
    remove(t.spark, place)
    return found
