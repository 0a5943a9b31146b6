"""Sources, chunking, text analysis and query understanding."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.core.storage import checkpoint_dir, cut, remove
from quarrylight.functions import english, scoring, text
from quarrylight.operators import chunking, exact
from quarrylight.plans.registry import QUERY_VALUES, Plans, query_table
from quarrylight.sources import adapters, readers

P = Plans()
WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def sql_words(column: str) -> str:
    return WORDS.format(column)


@P.add("src_dispatch", """
    SELECT id, CASE WHEN path LIKE '%.git' OR contains(path, 'github.com') OR contains(path, 'gitlab.com') OR path LIKE 'git@%' THEN 'git'
        WHEN path LIKE 'http://%' OR path LIKE 'https://%' THEN 'web' WHEN path LIKE '%.pdf' THEN 'pdf'
        WHEN path LIKE '%conversations.json' OR contains(path, 'chatgpt') OR contains(path, 'claude-export') THEN 'export' ELSE 'fs' END AS adapter FROM sources""")
def _(t):
    return t.sources.select("id", adapters.source_kind(F.col("path")).alias("adapter"))


@P.add("src_lang_detect", """
    SELECT id, CASE WHEN regexp_matches(lower(split_part(path, '/', -1)), '^dockerfile(\\..*)?$') THEN 'dockerfile' ELSE
      CASE lower(CASE WHEN contains(ltrim(split_part(path, '/', -1), '.'), '.') THEN split_part(path, '.', -1) ELSE '' END)
        WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript'
        WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'c' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'h' THEN 'cpp' WHEN 'hpp' THEN 'cpp'
        WHEN 'java' THEN 'java' WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'jsonl' WHEN 'toml' THEN 'toml' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'sh' THEN 'bash' WHEN 'bash' THEN 'bash'
        WHEN 'md' THEN 'markdown' WHEN 'cs' THEN 'csharp' WHEN 'lua' THEN 'lua' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' WHEN 'xml' THEN 'xml'
        WHEN 'dockerfile' THEN 'dockerfile' WHEN 'sql' THEN 'sql' ELSE 'unknown' END END AS detected FROM files""")
def _(t):
    return t.files.select("id", adapters.language_of(F.col("path")).alias("detected"))


@P.add("src_scope_filter", """
    SELECT f.id FROM files f JOIN sources s ON s.id = f.source_id
    WHERE NOT coalesce(list_has_any(string_split(f.path, '/'), CAST(json_extract_string(s.config, '$.exclude[*]') AS VARCHAR[])), false)""")
def _(t):
    return adapters.in_scope(t.files, t.sources).select("id")


@P.add("src_managed_append", "SELECT file_id, count(*) AS segments, list_reduce(list_prepend('', list(d ORDER BY id)), lambda h, x: sha256(h || x)) AS chain FROM (SELECT file_id, id, sha256(content_text) AS d FROM chunks) GROUP BY 1")
def _(t):
    return adapters.segment_chain(t.chunks.select("file_id", F.col("id").alias("sequence"), F.sha2(F.col("content_text"), 256).alias("digest")))


@P.add("src_fragment")
def _(t):
    return adapters.fragments(t.files.select("id", F.col("content_text").alias("text")), most=4096, window=512)


@P.add("src_export_chat", """
    SELECT doc_id, i - 1 AS turn, regexp_extract(line, '^\\[(\\w+)\\] ', 1) AS role,
           '## Message ' || i || ': **' || upper(substr(regexp_extract(line, '^\\[(\\w+)\\] ', 1), 1, 1)) || substr(regexp_extract(line, '^\\[(\\w+)\\] ', 1), 2) || '**' AS heading,
           substr(line, length(regexp_extract(line, '^\\[\\w+\\] ', 0)) + 1) AS body
    FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
          FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\[\\w+\\] ')) AS ls FROM documents WHERE kind = 'chat'))""")
def _(t):
    return adapters.chat_turns(t.documents.where("kind = 'chat'"))


@P.add("src_html_text", """
    SELECT id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        content_text, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<nav[^>]*>.*?</nav>', '', 'g'), '(?s)<header[^>]*>.*?</header>', '', 'g'),
        '(?s)<footer[^>]*>.*?</footer>', '', 'g'), '(?s)<aside[^>]*>.*?</aside>', '', 'g'), '<[^>]+>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s]+', ' ', 'g')) AS plain
    FROM files WHERE content_text IS NOT NULL""")
def _(t):
    return t.files.where("content_text is not null").select("id", text.page_text(F.col("content_text")).alias("plain"))


@P.add("src_links", """SELECT DISTINCT id, unnest(regexp_extract_all(content_text, '(https?://[^\\s"''<>)\\x60]+)', 1)) AS url FROM files""")
def _(t):
    return adapters.absolute_links(t.files.select("id", F.col("content_text").alias("text")))


V4_SQL = " OR ".join(f"regexp_matches(v4, '{p}')" for p in adapters.PRIVATE_V4)
V6_SQL = " OR ".join(f"regexp_matches(host, '{p}')" for p in adapters.PRIVATE_V6)
# Addresses of all kinds beside those of the texts, so that every range is met.
MORE_URLS = [
    "http://127.0.0.1/a", "https://10.1.2.3:80/", "http://172.16.0.1/", "http://172.32.0.1/", "http://192.168.1.1/", "http://169.254.169.254/latest", "http://0.0.0.0/", "http://100.64.0.1/", "http://100.128.0.1/", "http://192.0.0.8/", "http://192.0.2.1/", "http://198.51.100.7/",
    "http://203.0.113.9/", "http://224.0.0.1/", "http://255.255.255.255/", "http://8.8.8.8/", "http://[::1]/", "http://[::]:80/", "http://[fe80::1]/", "http://[fd00::1]/", "http://[2001:db8::1]/", "http://[::ffff:10.0.0.1]/", "http://[::ffff:8.8.4.4]/", "http://user:x@localhost/", "http://a.localhost/x", "ftp://example.test/", "http:///x",
]
MORE_URLS_SQL = ", ".join(f"('{u}')" for u in MORE_URLS)


@P.add("src_ssrf", f"""
    WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(content_text, '(https?://[^\\s"\'\'<>)\\x60]+)', 1)) AS url FROM files UNION SELECT url FROM (VALUES {MORE_URLS_SQL}) AS m(url)),
    h AS (SELECT url, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?(\\[[^\\]/]*\\]|[^/:?#@]+)', 1)) AS host FROM u),
    v AS (SELECT *, CASE WHEN regexp_matches(host, '^\\d+(\\.\\d+){{3}}$') THEN host ELSE regexp_extract(host, '^\\[::ffff:(\\d+(?:\\.\\d+){{3}})\\]$', 1) END AS v4 FROM h)
    SELECT url, NOT (host = '' OR host = 'localhost' OR host LIKE '%.localhost' OR {V4_SQL} OR {V6_SQL}) AS allowed FROM v""")
def _(t):
    more = t.spark.createDataFrame([(u,) for u in MORE_URLS], "url string")
    urls = adapters.absolute_links(t.files.select("id", F.col("content_text").alias("text"))).select("url").unionByName(more).distinct()
    return urls.select("url", adapters.fetchable(F.col("url")).alias("allowed"))


@P.add("src_robots", """
    WITH d AS (SELECT id, CAST(unnest(json_extract_string(config, '$.exclude[*]')) AS VARCHAR) AS part FROM sources WHERE config IS NOT NULL)
    SELECT f.id FROM files f JOIN sources s ON s.id = f.source_id WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = s.id AND starts_with('/' || f.path, '/' || d.part))""")
def _(t):
    """Every source has a robots.txt: one section for another agent, which says nothing here, and one for all."""
    excluded = F.from_json("config", "exclude array<string>").getField("exclude")
    rules = F.array_join(F.transform(F.coalesce(excluded, F.array().cast("array<string>")), lambda x: F.concat(F.lit("Disallow: /"), x)), "\n")
    robots = t.sources.select(F.col("id").alias("source_id"), F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\n"), rules, F.lit("\nDisallow:\nAllow: /x\n")).alias("text"))
    return adapters.robots_allowed(t.files.join(t.sources.select(F.col("id").alias("source_id")), "source_id", "left_semi"), adapters.robots_rules(robots)).select("id")


@P.add("src_binary_detect", """
    WITH b AS (SELECT id, hex(encode(content_text))[1:1024] AS h FROM files WHERE content_text IS NOT NULL UNION ALL SELECT -vec_id - 1, hex(encode(repeat(chr(CAST(vec_id % 40 + 1 AS INTEGER)), 4) || 'abcd'))[1:1024] FROM embeddings
        UNION ALL SELECT * FROM (VALUES (-1000001, '89504E470D0A1A0A'), (-1000002, 'FFD8FFE0'), (-1000003, '255044462D'), (-1000004, '6100'), (-1000005, '4D5A90'), (-1000006, '')) AS m(id, h)),
    c AS (SELECT id, h, list_transform(range(0, length(h) // 2), lambda i: substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS bytes FROM b)
    SELECT id, regexp_matches(h, '^(89504E47|FFD8FF|47494638|25504446|504B0304|7F454C46|1F8B|CAFEBABE|4D5A)') OR list_contains(bytes, '00')
        OR len(list_filter(bytes, lambda x: regexp_matches(x, '^(0[0-8]|0[BEF]|1[0-9A-F]|7F)$'))) > 0.3 * len(bytes) AS is_binary FROM c""")
def _(t):
    more = [(-1000001, "89504E470D0A1A0A"), (-1000002, "FFD8FFE0"), (-1000003, "255044462D"), (-1000004, "6100"), (-1000005, "4D5A90"), (-1000006, "")]
    sign = F.char(F.col("vec_id") % 40 + 1)
    raw = t.files.where("content_text is not null").select("id", F.encode("content_text", "UTF-8").alias("content"))
    raw = raw.unionByName(t.embeddings.select((-F.col("vec_id") - 1).alias("id"), F.encode(F.concat(F.repeat(sign, F.lit(4)), F.lit("abcd")), "UTF-8").alias("content")))
    raw = raw.unionByName(t.spark.createDataFrame(more, "id long, h string").select("id", F.unhex("h").alias("content")))
    return raw.select("id", adapters.is_binary(F.col("content")).alias("is_binary"))


@P.add("src_fs_scan", "SELECT kind, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL AND kind IS NOT NULL GROUP BY 1")
def _(t):
    """Documents written to a tree of folders, scanned with all their files."""
    place = f"{checkpoint_dir(t.spark)}/scan-{uuid.uuid4().hex}"
    t.documents.where("text is not null and kind is not null").select("kind", "text").write.partitionBy("kind").option("maxRecordsPerFile", 1000).text(place)
    found = adapters.scan_files(t.spark, place, "*.txt").groupBy(F.regexp_extract("path", "kind=([^/]+)/", 1).alias("kind")).agg(F.sum("length").alias("bytes"))
    found = cut(found)
    remove(t.spark, place)
    return found


@P.add("src_sitemap", "SELECT 'https://host.test/' || path AS url FROM files WHERE path IS NOT NULL AND source_id IS NOT NULL")
def _(t):
    """Every source's files as its sitemap, in pages of 1,000."""
    located = F.concat(F.lit("  <url>\n    <loc>https://host.test/"), "path", F.lit("</loc>\n  </url>"))
    pages = t.files.where("path is not null and source_id is not null").groupBy("source_id", F.floor(F.col("id") / 1000)).agg(F.array_join(F.collect_list(located), "\n").alias("body"))
    return adapters.sitemap_urls(pages.select(F.concat(F.lit('<?xml version="1.0"?>\n<urlset>\n'), "body", F.lit("\n</urlset>")).alias("text")))


@P.add("src_web_crawl", """
    WITH RECURSIVE p AS (SELECT doc_id AS i FROM documents), r AS (SELECT 0 AS depth, 1::BIGINT AS i UNION ALL SELECT depth + 1, j FROM r, LATERAL (SELECT unnest([3 * i, 3 * i + 1, 3 * i + 2]) AS j) WHERE depth < 3 AND j IN (SELECT i FROM p))
    SELECT 'https://host.test/d/' || i AS url, min(depth) AS depth FROM r WHERE i IN (SELECT i FROM p) GROUP BY 1 ORDER BY depth, url LIMIT 100""")
def _(t):
    """Documents as pages, each with links to three others, one to itself, one to nowhere and one to another host."""
    i = F.col("doc_id")
    links = [F.concat(F.lit('<a href="/d/'), (3 * i).cast("string"), F.lit('#top">x</a>')), F.concat(F.lit("<a class='y' href='https://host.test/d/"), (3 * i + 1).cast("string"), F.lit("'>x</a>")), F.concat(F.lit('<a href="'), (3 * i + 2).cast("string"), F.lit('">x</a>'))]
    html = F.concat(*links, F.lit('<a href="https://other.test/d/7">x</a><a href="/d/none">x</a><a href="#here">x</a>'))
    return adapters.crawl_order(t.documents.select(F.concat(F.lit("https://host.test/d/"), i.cast("string")).alias("url"), html.alias("html")), "https://host.test/d/1").withColumn("depth", F.col("depth").cast("int"))


@P.add("src_golden_jsonl", f"SELECT 'q' || query_id AS id, CASE WHEN query_id % 2 = 0 THEN 'hybrid' ELSE 'exact' END AS mode, query, CASE WHEN query_id % 3 = 0 THEN 5 ELSE 10 END AS k, ['src/' || query_id || '.rs'] AS expected FROM {QUERY_VALUES}")
def _(t):
    """The stated queries as a file of JSON lines, with remarks and blank lines between."""
    q = query_table(t)
    n = F.col("query_id")
    fields = F.struct(F.concat(F.lit("q"), n.cast("string")).alias("id"), F.when(n % 2 == 1, "exact").alias("mode"), "query", F.when(n % 3 == 0, 5).alias("k"), F.array(F.concat(F.lit("src/"), n.cast("string"), F.lit(".rs"))).alias("expect_files"))
    lines = q.select(F.explode(F.array(F.to_json(fields), F.lit("# remark"), F.lit("  "))).alias("value"))
    return readers.golden_rows(lines).select("id", "mode", "query", "k", "expected")


PROFILE = """
name = "engine"
[[layers]]
pattern_type = "path_contains"
pattern = "/storage/"
layer = "storage"
[[side_effects]]
name_patterns = ["^(delete|prune)", "^drop"]
effect = "delete"
[[resources]]
path_or_class_keywords = ["outbox", "queue"]
resource = "queue"
[[annotations]]
annotation_type = "todo"
regex = "TODO (.+)"
capture_group = 1
[[query_mappings]]
nl_terms = ["restart", "resume"]
symbols = ["replay_batch"]
"""


@P.add("src_profile_toml", """SELECT * FROM (VALUES ('layer', '/storage/', 'storage'), ('side_effect', '^(delete|prune)', 'delete'), ('side_effect', '^drop', 'delete'), ('resource', 'outbox', 'queue'), ('resource', 'queue', 'queue'),
    ('annotation', 'TODO (.+)', 'todo'), ('query_mapping', 'restart', 'replay_batch'), ('query_mapping', 'resume', 'replay_batch')) AS p(kind, pattern, value)""")
def _(t):
    return readers.profile_rules(t.spark, readers.profile_of(PROFILE))


@P.add("src_pdf_chunk")
def _(t):
    """Chunks as the blocks of printed documents: classes are headings, fifty lines a page."""
    order = Window.partitionBy("file_id").orderBy("start_line", "id")
    blocks = t.chunks.where("content_text is not null").select(F.col("file_id").alias("doc_id"), F.row_number().over(order).alias("n"), F.floor(F.col("start_line") / 50).alias("page"), F.when(F.col("chunk_type") == "class", 1).otherwise(0).alias("level"), F.col("content_text").alias("text"))
    return readers.printed_chunks(blocks).select("doc_id", "piece", "heading", F.sha2("text", 256).alias("digest"), "first_page", "last_page")


@P.add("msg_extract", """
    SELECT doc_id AS id, i - 1 AS turn, regexp_extract(line, '^\\[(\\w+)\\] ', 1) AS role, substr(line, length(regexp_extract(line, '^\\[\\w+\\] ', 0)) + 1) AS text
    FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\[\\w+\\] ')) AS ls FROM documents WHERE kind = 'chat'))
    WHERE trim(substr(line, length(regexp_extract(line, '^\\[\\w+\\] ', 0)) + 1)) <> ''""")
def _(t):
    """The turns of chats, written as lines of sessions in the shapes of three providers in turn, and read again."""
    turns = adapters.chat_turns(t.documents.where("kind = 'chat'"))
    a = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("body").alias("text"))).alias("content")).alias("message")))
    b = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct("role", F.array(F.struct(F.lit("output_text").alias("type"), F.col("body").alias("text"))).alias("content")).alias("payload")))
    c = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("type"), F.col("body").alias("content"))).alias("messages")))
    lines = turns.select((F.col("doc_id") * 1_000_000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 3 == 0, a).when(F.col("turn") % 3 == 1, b).otherwise(c).alias("text"))
    return adapters.session_messages(lines).select(F.floor(F.col("id") / 1_000_000).alias("id"), (F.col("id") % 1_000_000).alias("turn"), "role", "text")


@P.add("src_pdf_cleanup", """
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
        text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'Ĳ', 'IJ'), 'ĳ', 'ij'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'),
        '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS cleaned FROM documents WHERE text IS NOT NULL""")
def _(t):
    return t.documents.where("text is not null").select("doc_id", text.print_cleanup(F.col("text")).alias("cleaned"))


@P.add("src_conv_project", """
    WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE kind = 'chat')),
    p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, regexp_extract(line, '^\\[\\w+\\] ', 0) AS mark FROM l)
    SELECT doc_id, regexp_extract(line, '^\\[(\\w+)\\] ', 1) AS role, substr(line, length(mark) + 1) AS text, CAST(before + length(mark) AS BIGINT) AS start, CAST(before + length(line) AS BIGINT) AS stop FROM p WHERE mark <> ''""")
def _(t):
    return adapters.projected_turns(t.documents.where("kind = 'chat'"))


# --- chunking ---------------------------------------------------------------------------------------------------------


@P.add("chunk_char", """
    WITH w AS (SELECT id, content_text AS x, unnest(generate_series(0, CASE WHEN length(content_text) > 1000 THEN CAST(ceil((length(content_text) - 1000) / 900.0) AS BIGINT) ELSE 0 END)) AS n
               FROM files WHERE length(content_text) > 0)
    SELECT id, n AS ordinal, substr(x, n * 900 + 1, 1000) AS piece, 1 + length(substr(x, 1, n * 900)) - length(replace(substr(x, 1, n * 900), chr(10), '')) AS start_line FROM w""")
def _(t):
    return chunking.windows_of_characters(t.files.select("id", F.col("content_text").alias("text")))


@P.add("chunk_token", f"""
    WITH w AS (SELECT doc_id, {sql_words('text')} AS ws FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, ws, unnest(generate_series(0, CASE WHEN len(ws) > 256 THEN CAST(ceil((len(ws) - 256) / 224.0) AS BIGINT) ELSE 0 END)) AS ordinal FROM w WHERE len(ws) > 0)
    SELECT doc_id, ordinal, array_to_string(ws[ordinal * 224 + 1 : ordinal * 224 + 256], ' ') AS piece FROM n""")
def _(t):
    return chunking.windows_of_tokens(t.documents.select("doc_id", "text"))


@P.add("chunk_token_count", f"SELECT id, CAST(len({sql_words('content_text')}) AS BIGINT) AS tokens FROM chunks WHERE content_text IS NOT NULL")
def _(t):
    return t.chunks.where("content_text is not null").select("id", F.size(text.words(F.col("content_text"))).cast("long").alias("tokens"))


@P.add("chunk_budget", """
    WITH c AS (SELECT id, file_id, coalesce(chunk_type, 'code') <> 'conversation' AS plain, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS LAST, id) AS rn FROM chunks),
    a AS (SELECT *, bool_and(plain) OVER (PARTITION BY file_id) AS all_plain FROM c)
    SELECT id FROM a WHERE rn <= CASE WHEN all_plain THEN 3 ELSE 500 END""")
def _(t):
    return chunking.within_budget(t.chunks, most=500, most_plain=3).select("id")


@P.add("chunk_context_prefix", """
    SELECT c.id, CASE WHEN length('[' || s.name || '] ' || f.path) > 300 THEN substr('[' || s.name || '] ' || f.path, 1, 297) || '...' ELSE '[' || s.name || '] ' || f.path END AS prefix
    FROM chunks c JOIN files f ON f.id = c.file_id JOIN sources s ON s.id = f.source_id""")
def _(t):
    joined = t.chunks.select("id", "file_id").join(t.files.select(F.col("id").alias("file_id"), "path", "source_id"), "file_id").join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    return joined.select("id", text.context_prefix(F.col("name"), F.col("path")).alias("prefix"))


@P.add("chunk_embed_text", """SELECT id, CASE WHEN coalesce(context_prefix, '') <> '' THEN context_prefix || chr(10) || chr(10) || content_text ELSE content_text END AS embedded FROM chunks""")
def _(t):
    return t.chunks.select("id", F.when(F.coalesce("context_prefix", F.lit("")) != "", F.concat("context_prefix", F.lit("\n\n"), "content_text")).otherwise(F.col("content_text")).alias("embedded"))


@P.add("chunk_parent_link", "SELECT c.id, p.id AS parent_id, p.file_id = c.file_id AS same_file, coalesce(p.level, -1) AS parent_level FROM chunks c JOIN chunks p ON p.id = c.parent_chunk_id")
def _(t):
    parent = t.chunks.select(F.col("id").alias("parent_id"), F.col("file_id").alias("p_file"), F.col("level").alias("parent_level"))
    return t.chunks.join(parent, F.col("parent_chunk_id") == F.col("parent_id")).select("id", "parent_id", (F.col("p_file") == F.col("file_id")).alias("same_file"), F.coalesce("parent_level", F.lit(-1)).alias("parent_level"))


@P.add("chunk_hash_version", """
    WITH c AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS LAST, id) AS pos, lower(hex(content_hash)) AS h, coalesce(chunker_version, '') AS v, sha256(content_text) AS now FROM chunks)
    SELECT file_id, bool_and(h = now AND v = 'lines-v2') AS unchanged, count(*) AS pieces FROM c GROUP BY file_id""")
def _(t):
    return chunking.unchanged_files(t.chunks, "lines-v2")


@P.add("chunk_conversation")
def _(t):
    return chunking.packed_turns(adapters.chat_turns(t.documents.where("kind = 'chat'")), most=400, least=100)


@P.add("chunk_semantic")
def _(t):
    return chunking.syntax_units(t.files).select("file_id", "ordinal", "chunk_type", "name", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), "start_line", "end_line", F.sha2("text", 256).alias("sha256"))


@P.add("parse_symbols")
def _(t):
    return chunking.declared_symbols(t.files)


@P.add("parse_calls")
def _(t):
    return chunking.calls(t.files)


@P.add("parse_conversation_symbols", """
    WITH m AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS turn
               FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\[\\w+\\] ')) AS ls FROM documents WHERE kind = 'chat')),
    r AS (SELECT doc_id, turn, regexp_extract(line, '^\\[(\\w+)\\] ', 1) AS role, substr(line, length(regexp_extract(line, '^\\[\\w+\\] ', 0)) + 1) AS body FROM m)
    SELECT doc_id, turn, role || '_' || row_number() OVER (PARTITION BY doc_id, role ORDER BY turn) AS name, substr(body, 1, 100) AS signature FROM r""")
def _(t):
    order = Window.partitionBy("doc_id", "role").orderBy("turn")
    return adapters.chat_turns(t.documents.where("kind = 'chat'")).select("doc_id", "turn", F.concat("role", F.lit("_"), F.row_number().over(order)).alias("name"), F.substring("body", 1, 100).alias("signature"))


@P.add("parse_visibility", """
    SELECT DISTINCT id, coalesce(nullif(regexp_extract(signature, '^\\s*(public|private|protected|internal|pub|export)\\b', 1), ''), CASE WHEN language = 'go' AND regexp_matches(name, '^[A-Z]') THEN 'public' WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'private' END) AS declared
    FROM symbols WHERE signature IS NOT NULL""")
def _(t):
    return t.symbols.where("signature is not null").select("id", chunking.visibility(F.col("signature"), F.col("name"), F.col("language")).alias("declared")).distinct()


# --- text analysis ----------------------------------------------------------------------------------------------------


@P.add("tok_word", f"SELECT doc_id, unnest({sql_words('text')}) AS token FROM documents")
def _(t):
    return t.documents.select("doc_id", F.explode(text.words(F.col("text"))).alias("token"))


@P.add("tok_posting", f"""
    WITH x AS (SELECT doc_id, unnest({sql_words('text')}) AS term FROM documents UNION ALL
        SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_matches(w, '[^\\p{{L}}\\p{{N}}_]') AND regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))) FROM documents)
    SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL""")
def _(t):
    return t.documents.select("doc_id", F.explode(text.posting_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@P.add("tok_position", f"""
    WITH x AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {sql_words('text')} AS ws FROM documents))
    SELECT doc_id, term, min(pos) AS first_position FROM x GROUP BY ALL""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(text.words(F.col("text"))).alias("pos", "term")).groupBy("doc_id", "term").agg((F.min("pos") + 1).cast("long").alias("first_position"))


@P.add("seg_first_position", """
    SELECT c.id, instr(f.content_text, c.content_text) AS at_char, strlen(substr(f.content_text, 1, instr(f.content_text, c.content_text) - 1)) AS at_byte
    FROM chunks c JOIN files f ON f.id = c.file_id WHERE length(c.content_text) > 0 AND instr(f.content_text, c.content_text) > 0""")
def _(t):
    j = t.chunks.where("length(content_text) > 0").select("id", "file_id", F.col("content_text").alias("piece")).join(t.files.select(F.col("id").alias("file_id"), F.col("content_text").alias("whole")), "file_id")
    at = F.expr("locate(piece, whole)")
    return j.withColumn("at_char", at.cast("long")).where("at_char > 0").select("id", "at_char", F.octet_length(F.expr("substring(whole, 1, cast(at_char - 1 as int))")).cast("long").alias("at_byte"))


@P.add("fts_or_query", f"""
    WITH w AS (SELECT query_id, list_sort(list_distinct({sql_words('query')})) AS ws FROM {QUERY_VALUES}),
    d AS (SELECT doc_id, list_distinct({sql_words('text')}) AS ds FROM documents WHERE text IS NOT NULL)
    SELECT query_id, array_to_string(ws, ' | ') AS expression, count(*) AS matches FROM w JOIN d ON list_has_any(ws, ds) GROUP BY ALL""")
def _(t):
    # The query set is small and fixed; only its words are joined with the postings.
    q = query_table(t).select("query_id", F.array_sort(F.array_distinct(text.words(F.col("query")))).alias("ws"))
    terms = q.select("query_id", F.explode("ws").alias("term"))
    hits = t.documents.select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term")).join(F.broadcast(terms), "term").select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("matches"))
    return hits.join(q, "query_id").select("query_id", F.array_join("ws", " | ").alias("expression"), "matches")


@P.add("fts_phrase", "SELECT doc_id FROM documents WHERE contains(chr(31) || array_to_string(" + sql_words("text") + ", chr(31)) || chr(31), chr(31) || 'sealed' || chr(31) || 'generations' || chr(31))")
def _(t):
    return t.documents.where(text.has_phrase(F.col("text"), F.lit("sealed generations"))).select("doc_id")


@P.add("phrase_match", f"""
    WITH x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, {sql_words('text')} AS ws FROM documents))
    SELECT a.doc_id, count(*) AS places FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'posting' AND b.w = 'lists' GROUP BY 1""")
def _(t):
    # The separators around tokens make neighbours one text; the last one is only looked at, as the next place may need it.
    pattern = f"{text.SEPARATOR}posting{text.SEPARATOR}lists(?={text.SEPARATOR})"
    return t.documents.where("text is not null").select("doc_id", F.regexp_count(text.phrase_key(F.col("text")), F.lit(pattern)).cast("long").alias("places")).where("places > 0")


@P.add("exact_identifiers", f"""SELECT id, list_sort(list_distinct(list_filter({sql_words('content_text')}, lambda w: regexp_matches(w, '_|\\p{{N}}')))) AS identifiers FROM chunks WHERE content_text IS NOT NULL""")
def _(t):
    return t.chunks.where("content_text is not null").select("id", text.exact_identifiers(F.col("content_text")).alias("identifiers"))


@P.add("literal_term_count", f"""SELECT doc_id, CAST(len(list_filter({sql_words('text')}, lambda w: w = 'chunks')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL""")
def _(t):
    return t.documents.where("text is not null").select("doc_id", F.size(F.filter(text.words(F.col("text")), lambda w: w == "chunks")).cast("long").alias("n"))


@P.add("jsonl_body_literal")
def _(t):
    """Every word within a string of a JSON file or of JSON lines, for any literal that is asked for."""
    return adapters.json_strings(t.files.select("id", F.col("content_text").alias("text"))).select("id", F.explode(text.words(F.col("value"))).alias("word")).distinct()


@P.add("snippet", """
    WITH w AS (SELECT id, content_text AS x, translate(content_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM chunks WHERE content_text IS NOT NULL),
    k AS (SELECT *, CASE WHEN contains(low, 'posting') THEN 'posting' WHEN contains(low, 'token') THEN 'token' END AS word FROM w),
    p AS (SELECT *, instr(low, word) AS p0, greatest(1, instr(low, word) - 81) AS s, least(length(x), instr(low, word) + length(word) - 1 + 80) AS e FROM k WHERE word IS NOT NULL)
    SELECT id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(x, s, p0 - s) || '**' || substr(x, p0, length(word)) || '**' || substr(x, p0 + length(word), e - p0 - length(word) + 1) || CASE WHEN e < length(x) THEN '...' ELSE '' END AS shown FROM p""")
def _(t):
    return t.chunks.select("id", text.snippet(F.col("content_text"), F.lit("posting token")).alias("shown")).where("shown is not null")


@P.add("location_ref", "SELECT c.id, f.path || ':' || c.start_line || '-' || c.end_line AS place FROM chunks c JOIN files f ON f.id = c.file_id")
def _(t):
    return t.chunks.select("id", "file_id", "start_line", "end_line").join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", text.location(F.col("path"), F.col("start_line"), F.col("end_line")).alias("place"))


@P.add("content_truncate", """
    WITH b AS (SELECT id, content_text, strlen(content_text) AS n, CASE WHEN strlen(content_text) > 16000 THEN hex(encode(content_text)) END AS h FROM files WHERE content_text IS NOT NULL),
    k AS (SELECT *, list_filter([16000, 15999, 15998, 15997], lambda k: substr(h, CAST(2 * k + 1 AS BIGINT), 1) NOT IN ('8', '9', 'A', 'B'))[1] AS most FROM b)
    SELECT id, CASE WHEN n > 16000 THEN decode(unhex(substr(h, 1, CAST(2 * most AS BIGINT)))) || '...' || chr(10) || '[truncated: ' || n || ' chars total]' ELSE content_text END AS shown FROM k""")
def _(t):
    return t.files.where("content_text is not null").select("id", text.truncated(F.col("content_text")).alias("shown"))


def _removed_sql(patterns: list[str], column: str = "content_text") -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p.replace('(?dm)', '(?m)').replace('(?ds)', '(?s)').replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"regexp_replace({column}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


COMPRESSED_SQL = "CASE " + " ".join(f"WHEN language IN ({', '.join(repr(x) for x in languages)}) THEN {_removed_sql(text.REMOVED[rules])}" for rules, languages in text.SAME_RULES.items())
COMPRESSED_SQL += f" ELSE regexp_replace({_removed_sql([text.REMOVED_ELSE])}, '[ \\t]+\\n', chr(10), 'g') END"


@P.add("compress_content", f"""
    SELECT id, strlen(content_text) AS before, CAST(strlen(r) AS BIGINT) AS after, sha256(r) AS digest FROM (SELECT id, content_text, CASE WHEN strlen(content_text) < 100 THEN content_text ELSE regexp_replace(regexp_replace({COMPRESSED_SQL}, '^\\s+', ''), '\\s+$', '') END AS r
    FROM files WHERE content_text IS NOT NULL)""")
def _(t):
    r = t.files.where("content_text is not null").select("id", "content_text", text.compressed(F.col("content_text"), F.col("language")).alias("r"))
    return r.select("id", F.octet_length("content_text").cast("long").alias("before"), F.octet_length("r").cast("long").alias("after"), F.sha2("r", 256).alias("digest"))


SENSITIVE_SQL = " UNION ALL ".join(
    f"SELECT id, '{n}' AS name, '{sev}' AS severity, unnest(regexp_extract_all(content_text, '{p.replace(chr(39), chr(39) * 2)}')) AS found FROM files" for n, p, _c, sev, _a in adapters.SENSITIVE
)


@P.add("sensitive_scan", f"SELECT id, name, severity, count(*) AS places FROM ({SENSITIVE_SQL}) GROUP BY ALL")
def _(t):
    return adapters.sensitive_findings(t.files.select("id", F.col("content_text").alias("text"))).groupBy("id", "name", "severity").agg(F.count("*").alias("places"))


@P.add("symbol_name_search", "SELECT DISTINCT id, name, type FROM symbols WHERE name ILIKE '%frontier%' AND type = 'function'")
def _(t):
    return t.symbols.where(F.col("name").ilike("%frontier%") & (F.col("type") == "function")).select("id", "name", "type").distinct()


# --- query understanding ----------------------------------------------------------------------------------------------


@P.add("q_type", f"""
    WITH s AS (SELECT query_id, query, CAST(contains(query, '.') AS INT) + CAST(contains(query, '::') AS INT) + CAST(contains(query, '->') AS INT) + CAST(contains(query, '_') AS INT) + CAST(contains(query, '/') AS INT)
        + CAST(regexp_matches(query, '\\p{{Ll}}\\p{{Lu}}') AS INT) AS c, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) AS n FROM {QUERY_VALUES})
    SELECT query_id, CASE WHEN c >= 2 OR (c >= 1 AND n <= 3) THEN 'code' WHEN n >= 4 AND c = 0 THEN 'natural' ELSE 'mixed' END AS kind FROM s""")
def _(t):
    return query_table(t).select("query_id", scoring.query_type(F.col("query")).alias("kind"))


@P.add("q_weight", f"""
    WITH s AS (SELECT query_id, query, CAST(contains(query, '.') AS INT) + CAST(contains(query, '::') AS INT) + CAST(contains(query, '->') AS INT) + CAST(contains(query, '_') AS INT) + CAST(contains(query, '/') AS INT)
        + CAST(regexp_matches(query, '\\p{{Ll}}\\p{{Lu}}') AS INT) AS c, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) AS n FROM {QUERY_VALUES})
    SELECT query_id, CAST(CASE WHEN c >= 2 OR (c >= 1 AND n <= 3) THEN 1.5 WHEN n >= 4 AND c = 0 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS weight FROM s""")
def _(t):
    return query_table(t).select("query_id", scoring.query_weight(scoring.query_type(F.col("query"))).alias("weight"))


@P.add("q_phrase_detect", f"SELECT query_id, CASE WHEN query LIKE '\"%\"' THEN substr(query, 2, length(query) - 2) END AS phrase FROM {QUERY_VALUES}")
def _(t):
    return query_table(t).select("query_id", scoring.quoted_phrase(F.col("query")).alias("phrase"))


@P.add("q_camel_split", """
    SELECT DISTINCT name, CASE WHEN len(p) > 1 THEN p ELSE CAST([] AS VARCHAR[]) END AS parts FROM (
        SELECT name, string_split(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1|\\2', 'g'), '([A-Za-z])([0-9])', '\\1|\\2', 'g'), '([0-9])([A-Za-z])', '\\1|\\2', 'g'), '|') AS p
        FROM symbols WHERE regexp_matches(name, '^[A-Za-z0-9]+$'))""")
def _(t):
    return t.symbols.where(F.col("name").rlike("^[A-Za-z0-9]+$")).select("name", text.camel_split(F.col("name")).alias("parts")).distinct()


@P.add("q_expand_fts")
def _(t):
    return query_table(t).select("query_id", text.expanded_query(F.col("query")).alias("expanded"))


@P.add("q_intent", f"""
    SELECT query_id, CASE WHEN regexp_matches(lower(query), 'delete|remove|clear|erase|destroy|drop') THEN 'delete' WHEN regexp_matches(lower(query), 'create|add|new|make|insert|generate') THEN 'create'
        WHEN regexp_matches(lower(query), 'get|find|read|fetch|list|show|query') THEN 'read' WHEN regexp_matches(lower(query), 'set|update|change|modify|edit|toggle') THEN 'modify' END AS intent FROM {QUERY_VALUES}""")
def _(t):
    return query_table(t).select("query_id", scoring.intent(F.col("query")).alias("intent"))


DOMAIN_TERMS = [("posting", "PostingList"), ("outbox", "OutboxWorker"), ("chunk", "Chunker"), ("symbol", "SymbolCard"), ("generation", "Generation")]


@P.add("q_domain_expand", f"SELECT query_id, symbol FROM {QUERY_VALUES} JOIN (VALUES {', '.join(str(x) for x in DOMAIN_TERMS)}) AS m(term, symbol) ON contains(lower(query), term)")
def _(t):
    terms = t.spark.createDataFrame(DOMAIN_TERMS, "term string, symbol string")
    return query_table(t).join(F.broadcast(terms), F.lower("query").contains(F.col("term"))).select("query_id", "symbol")


@P.add("fn_identifier_words", """
    SELECT DISTINCT name, list_filter(list_transform(string_split(CASE WHEN contains(name, '_') THEN name ELSE regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g') END, '_'),
        lambda p: trim(lower(p))), lambda p: length(p) >= 3 AND regexp_matches(p, '^\\p{L}+$')) AS parts FROM symbols WHERE name IS NOT NULL""")
def _(t):
    return t.symbols.where("name is not null").select("name", text.identifier_words(F.col("name")).alias("parts")).distinct()


@P.add("fn_slug", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(path), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) AS slug FROM documents WHERE path IS NOT NULL")
def _(t):
    return t.documents.where("path is not null").select("doc_id", text.slug(F.col("path")).alias("slug"))


@P.add("st_hash_framed", """
    SELECT id, sha256(unhex(lpad(lower(to_hex(strlen(path))), 16, '0') || lower(hex(encode(path))) || lpad(lower(to_hex(strlen(coalesce(language, '')))), 16, '0') || lower(hex(encode(coalesce(language, '')))))) AS digest FROM files""")
def _(t):
    return t.files.select("id", text.framed_hash(F.col("path"), F.coalesce("language", F.lit(""))).alias("digest"))


@P.add("fts_weighted_vector", f"""
    SELECT id, term, weight, count(*) AS n FROM (SELECT id, 'A' AS weight, unnest({sql_words('content_text')}) AS term FROM chunks UNION ALL SELECT id, 'B', unnest({sql_words('context_prefix')}) FROM chunks UNION ALL SELECT id, 'C', unnest({sql_words('chunk_type')}) FROM chunks) GROUP BY ALL""")
def _(t):
    parts = [t.chunks.select("id", F.lit(w).alias("weight"), F.explode(text.words(F.col(c))).alias("term")) for w, c in (("A", "content_text"), ("B", "context_prefix"), ("C", "chunk_type"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id", "term", "weight").agg(F.count("*").alias("n"))


@P.add("fts_english")
def _(t):
    return t.documents.where("text is not null").select("doc_id", F.explode(english.english_terms(F.col("text"))).alias("stem")).groupBy("doc_id", "stem").agg(F.count("*").alias("tf"))


@P.add("fts_websearch_query", f"SELECT doc_id FROM documents WHERE list_contains({sql_words('text')}, 'chunks') AND NOT list_contains({sql_words('text')}, 'queue') AND (list_contains({sql_words('text')}, 'stale') OR list_contains({sql_words('text')}, 'sealed'))")
def _(t):
    tree = exact.parse("chunks (stale OR sealed) -queue")
    ws = text.words(F.col("text"))
    return t.documents.where("text is not null").where(exact.holds(tree, lambda leaf: F.array_contains(ws, leaf.value))).select("doc_id")


def _trees(t):
    rows = []
    for i, q in [(1, "frontier (token OR cursor) -digest"), (2, '"sealed generations" chunks'), (3, "a AND b AND c"), (4, "NOT x"), (5, "id:password_hash token")]:
        try:
            tree = exact.parse(q)
            found = exact.leaves(tree)
            rows.append((i, True, repr(tree), [x.value for x, neg in found if not neg], [x.value for x, neg in found if neg], exact.simple_conjunction(tree)))
        except exact.QueryError as e:
            rows.append((i, False, str(e), [], [], None))
    return t.spark.createDataFrame(rows, "query_id int, valid boolean, tree string, positive array<string>, negative array<string>, conjunction array<string>")


@P.add("q_parse")
def _(t):
    return _trees(t).select("query_id", "valid", "tree")


@P.add("q_ast_leaves", "SELECT * FROM (VALUES (1, ['frontier', 'token', 'cursor'], ['digest']), (2, ['sealed generations', 'chunks'], []), (3, ['a', 'b', 'c'], []), (4, [], []), (5, ['password_hash', 'token'], [])) AS x(query_id, positive, negative)")
def _(t):
    return _trees(t).select("query_id", "positive", "negative")


@P.add("q_ast_validate", "SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, true)) AS x(query_id, valid)")
def _(t):
    return _trees(t).select("query_id", "valid")


@P.add("q_simple_and", "SELECT * FROM (VALUES (3, ['a', 'b', 'c'])) AS x(query_id, conjunction)")
def _(t):
    return _trees(t).select("query_id", "conjunction").where("conjunction is not null")
