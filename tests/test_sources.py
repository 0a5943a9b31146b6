from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarrylight.functions import text as tx
from quarrylight.operators import chunking
from quarrylight.sources import adapters as A
from quarrylight.sources import readers


def test_scan_leaves_out_large_and_binary_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "sub" / "b.txt").write_text("ü" * 10)
    (tmp_path / "c.png").write_bytes(b"\x89PNG" + bytes(100))
    (tmp_path / "d.bin").write_bytes(bytes(range(1, 9)) * 60)
    (tmp_path / "e.txt").write_text("x" * 5000)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in A.scan_files(spark, str(tmp_path), most_bytes=4000).collect()}
    assert got == {"a.py": "x = 1\n", "b.txt": "ü" * 10}


def test_pages(spark):
    html = "<html><head><style>p{}</style></head><nav>menu</nav><p>A &amp; B</p><script>\nvar x\n</script> <b>c</b></html>"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.page_text(F.lit(html))) == "A & B c"
    assert one(tx.print_cleanup(F.lit("exam-\nple  ﬁne\n\n\n\nend "))) == "example fine\n\nend"
    pages = spark.createDataFrame([("http://h.test/a", '<a href="b">x</a><a href="http://o.test/c">y</a>'), ("http://h.test/b", '<a href="/a#top">z</a>'), ("http://o.test/c", "")], "url string, html string")
    assert {(r.url, r.target) for r in A.page_links(pages).collect()} == {("http://h.test/a", "http://h.test/b"), ("http://h.test/a", "http://o.test/c"), ("http://h.test/b", "http://h.test/a")}
    assert [(r.url, r.depth) for r in A.crawl_order(pages, "http://h.test/a").collect()] == [("http://h.test/a", 0), ("http://h.test/b", 1)]
    maps = spark.createDataFrame([("<url><loc>http://h.test/a</loc></url><loc>http://h.test/b</loc>",)], "text string")
    assert [r.url for r in A.sitemap_urls(maps).collect()] == ["http://h.test/a", "http://h.test/b"]
    assert [one(A.fetchable(F.lit(u))) for u in ("http://10.0.0.1/x", "https://h.test/", "http://localhost:8/", "http://172.20.1.1/", "http://172.32.1.1/")] == [False, True, False, False, True]


def test_chat_exports_and_sessions(spark):
    tree = {"title": "T", "mapping": {"r": {"parent": None, "children": ["a", "b"], "message": None}, "a": {"parent": "r", "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}}, "b": {"parent": "r", "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["other"]}}}}}
    flat = {"conversations": [{"name": "F", "chat_messages": [{"sender": "human", "text": "one"}, {"sender": "assistant", "content": [{"type": "text", "text": "two"}]}]}]}
    rows = A.chat_export(spark.createDataFrame([(json.dumps([tree]),), (json.dumps(flat),), ("broken",), (None,)], "json string")).collect()
    assert {(r.title, r.turn, r.role, r.text) for r in rows} == {("T", 1, "user", "hi"), ("F", 1, "human", "one"), ("F", 2, "assistant", "two")}
    lines = [
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "run", "input": {"x": "y" * 500}}]}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "o" * 900}}, {"messages": [{"type": "user", "content": "hey", "thoughts": []}]},
    ]
    got = A.session_messages(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "id long, text string")).collect()
    assert [r.role for r in got] == ["assistant", "tool", "user"] and len(got[0].text) < 230 and len(got[1].text) == 509


def test_fragments_cut_at_lines_and_characters(spark):
    text = "ä" * 50 + "\n" + "x" * 30 + "\n" + "é" * 40
    rows = [(r.start, r.stop) for r in A.fragments(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string"), 64, 16).collect()]
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in rows) == raw and all(b - a <= 64 for a, b in rows)
    assert all(raw[a:b].decode() for a, b in rows)


def test_json_strings_and_chain(spark):
    rows = spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}], "n": 3}'), (2, '{"q": "1"}\nbroken\n{"q": "2"}'), (3, None)], "id long, text string")
    assert {(r.id, r.value) for r in A.json_strings(rows).collect()} == {(1, "x"), (1, "y"), (2, "1"), (2, "2")}
    a = A.segment_chain(spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (2, 2, "q"), (2, 1, "p"), (3, 1, "q"), (3, 2, "p")], "file_id long, sequence int, digest string")).collect()
    chains = {r.file_id: r.chain for r in a}
    assert chains[1] == chains[2] != chains[3]


def test_readers(spark, tmp_path):
    golden = tmp_path / "g.jsonl"
    golden.write_text('# comment\n\n{"id": "a", "query": "q", "k": 5, "expect_files": ["x.py"]}\n{"id": "b", "query": "r"}\n')
    assert [(r.id, r.mode, r.k, r.expected) for r in readers.golden_queries(spark, str(golden)).collect()] == [("a", "hybrid", 5, ["x.py"]), ("b", "hybrid", 10, [])]
    profile = tmp_path / "p.toml"
    profile.write_text('name = "p"\n[[layers]]\npattern_type = "path_contains"\npattern = "/ui/"\nlayer = "ui"\n[[side_effects]]\nname_patterns = ["^set"]\neffect = "write"\n[[query_mappings]]\nnl_terms = ["clip"]\nsymbols = ["Clip"]\n')
    got = readers.domain_profile(str(profile))
    assert got["layers"] == [("path_contains", "/ui/", "ui")] and got["side_effects"] == [("^set", "write")] and got["query_mappings"] == [("clip", "Clip")]
    blocks = spark.createDataFrame([(1, 1, 1, 20.0, "Title"), (1, 2, 1, 10.0, "word " * 200), (1, 3, 2, 10.0, "more " * 60), (1, 4, 3, 16.0, "Next"), (1, 5, 3, 10.0, "short")], "doc_id long, n int, page int, size double, text string")
    pieces = readers.printed_chunks(readers.font_levels(blocks)).orderBy("piece").collect()
    assert [p.heading for p in pieces][0] == "Title" and pieces[-1].heading == "Next" and pieces[-1].text == "short"


def test_chunking(spark):
    files = spark.createDataFrame([(1, "python", "import os\n\n\nclass A:\n    def f(self):\n        g(1)\n        self.h.k()\n\n\ndef g(x):\n    return B(x)\n"), (2, None, "x"), (3, "go", None)], "id long, language string, content_text string")
    symbols = {(r.name, r.qualified_name, r.type, r.line_start, r.line_end) for r in chunking.declared_symbols(files).collect()}
    assert symbols == {("A", "A", "class", 4, 7), ("f", "A::f", "function", 5, 7), ("g", "g", "function", 10, 11)}
    calls = {(r.caller, r.callee, r.call_type, r.call_line) for r in chunking.calls(files).collect()}
    assert calls == {("f", "g", "direct", 6), ("f", "self.h.k", "method", 7), ("g", "B", "direct", 11)}
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "bot", "x" * 30) for i in range(9)], "doc_id long, turn long, role string, body string")
    packed = chunking.packed_turns(turns, most=120, least=60).orderBy("piece").collect()
    assert sum(p.messages for p in packed) == 9 and all(set(p.roles.split(",")) == {"bot", "user"} for p in packed)
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    long = "é" * 9000
    assert one(tx.truncated(F.lit(long))) == "é" * 8000 + "...\n[truncated: 18000 chars total]"
    assert one(tx.truncated(F.lit("a" + long))).startswith("a" + "é" * 7999 + "...")
