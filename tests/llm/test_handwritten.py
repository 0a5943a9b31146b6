from __future__ import annotations

import random

import pytest

from quarrylight.llm import handwritten as H

SCHEMA = "id long, source_id long, path string, language string, content_text string, owner string, verdict string"
UPSTREAM = "upstream_id long, library string, version string, language string, content_text string"


def code(seed: int, n: int = 40) -> list[str]:
    rng = random.Random(seed)
    return [f"def f{rng.randrange(10**6)}(a{rng.randrange(99)}):\n    return g{rng.randrange(10**6)}(a, {rng.randrange(10**6)})" for _ in range(n // 2)]


def reasons(spark, rows, upstream=()):
    files = spark.createDataFrame([(i, s, p, la, t, "o", "v") for i, (s, p, la, t) in enumerate(rows, 1)], SCHEMA)
    up = spark.createDataFrame(list(upstream), UPSTREAM) if upstream else None
    return {r.file_id: r.reason for r in H.not_handwritten(files, up).collect()}


@pytest.mark.parametrize(
    ("path", "text", "expected"),
    [
        ("web/package-lock.json", "{}", "lock"), ("go.sum", "a h1:x", "lock"), ("src/a.py", "# Code generated by x. DO NOT EDIT.\nx = 1", "generated"), ("src/a.rs", "// Fichier produit par x - ne pas modifier.\n", "generated"),
        ("src/a_pb2.py", "x = 1", "generated"), ("vendor/lib/a.py", "x = 1", "vendored"), ("static/a.min.js", "var a=1", "minified"), ("src/t.py", "rows = [\n" + "  [1, 2.5, 'a'],\n" * 30 + "]\n", "data"),
        ("generators/a.py", 'HEADER = "Code generated by x. DO NOT EDIT."\n', None), ("src/a.c", '#define HEADER "@generated"\nint x;', None), ("docs/a.md", "How files are vendored from upstream revision 3", None),
        ("src/a.py", "# Copyright the project authors.\nx = 1", None), (None, "x = 1", None), ("src/a.go", "// do not edit the generated client by hand, run make instead\nfunc a() {}", None),
    ],
)
def test_verdict_of_one_file(path, text, expected):
    assert H.verdict(path, None, text) == expected


def test_copies_are_found_across_sources_also_when_patched(spark):
    library, own = code(1), code(2)
    patched = [*library[:5], "patched = 1", *library[6:]]
    rows = [(1, "a/x.py", "python", "\n".join(library)), (2, "b/y.py", "python", "\n".join(patched)), (3, "c/z.py", "python", "\n".join(own)), (3, "c/z.py", "python", "\n".join(own))]
    assert reasons(spark, rows) == {1: "vendored", 2: "vendored"}


def test_published_files_count_as_another_source(spark):
    library = code(5)
    assert reasons(spark, [(1, "lib/q.py", "python", "\n".join(library[3:]))], [(1, "lib", "1.0", "python", "\n".join(library))]) == {1: "vendored"}


def test_containment_equals_brute_force(spark):
    rng = random.Random(9)
    pool = [line for s in range(6) for block in code(s, 30) for line in block.split("\n")]
    rows = []
    for i in range(40):
        at = rng.randrange(len(pool) - 30)
        lines = pool[at : at + 25] if i % 3 else code(100 + i, 24)
        rows.append((i % 5, f"s/{i}.py", "python", "\n".join(lines)))
    windows = [set(H.window_hashes(t)) for *_, t in rows]
    holders: dict[int, dict[int, int]] = {}
    for i, w in enumerate(windows):
        for h in w:
            owners = holders.setdefault(h, {})
            owners[rows[i][0]] = min(owners.get(rows[i][0], i), i)
    brute = set()
    for i, w in enumerate(windows):
        points: dict[int, int] = {}
        for h in w:
            owners = holders[h]
            if len(owners) > 1:
                first = min(owners)
                other = owners[first] if first != rows[i][0] else owners[max(owners)]
                points[other] = points.get(other, 0) + 1
        if points and max(points.values()) >= 0.5 * len(w):
            brute.add(i + 1)
    assert set(reasons(spark, rows)) == brute


def test_nulls_empties_and_empty_table(spark):
    rows = [(None, None, None, None), (1, "a.py", None, ""), (1, "b.py", "python", " \n"), (None, "vendor/a.py", "python", "x" * 100_000)]
    assert reasons(spark, rows) == {4: "vendored"}
    assert H.not_handwritten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marks_behind_the_code_and_short_minified_files():
    assert H.verdict("lib/a.go", "go", "func a() {}\n\n// This file was automatically generated by x 8.2.\n") == "generated"
    assert H.verdict("lib/a.go", "go", "func a() {}\n// This file was automatically generated by x\nfunc b() {}\n") is None
    assert H.verdict("web/a.css", "css", ".a1{padding:2px;color:#932}" * 10 + "\n/*# sourceMappingURL=a.map */") == "minified"
    assert H.verdict("web/a.css", "css", ".a1 {\n  padding: 2px;\n  color: #932;\n}\n" * 10) is None


def test_files_of_nothing_but_accessors():
    def member(n):
        return f"def get_{n}(m):\n    return m.{n}\n\ndef set_{n}(m, v):\n    m.{n} = v\n\ndef has_{n}(m):\n    return m.{n} is not None\n"

    assert H.verdict("src/a.py", "python", "\n".join(member(n) for n in ("alpha", "beta", "gamma"))) == "generated"
    assert H.verdict("src/a.py", "python", member("alpha") + "\n".join(code(3, 60))) is None


def test_copies_are_found_however_many_there_are(spark):
    library = code(21)
    patched = [[*library[: i % 15], f"patched = {i}", *library[i % 15 + 1 :]] for i in range(60)]
    rows = [(i % 5, f"lib{i}/x.py", "python", "\n".join(library)) for i in range(60)] + [(i % 5, f"lib{i}/y.py", "python", "\n".join(p)) for i, p in enumerate(patched)]
    rows += [(i % 5, f"own/{i}.py", "python", "\n".join(code(1000 + i))) for i in range(60)]
    assert reasons(spark, rows) == {i: "vendored" for i in range(1, 121)}


def test_full_containment_equals_brute_force(spark):
    rng = random.Random(9)
    pool = [line for s in range(6) for block in code(s, 30) for line in block.split("\n")]
    rows = []
    for i in range(60):
        at = rng.randrange(len(pool) - 30)
        rows.append((i % 5, f"s/{i}.py", "python", "\n".join(pool[at : at + 25] if i % 3 else code(100 + i, 24))))
    # A copy whose windows are split between files of smaller sources, though one file holds all of them.
    library = code(77)
    rows += [(0, "a/0.py", "python", "\n".join(library[:7])), (1, "a/1.py", "python", "\n".join(library[7:13])), (2, "a/2.py", "python", "\n".join(library[13:])), (3, "b/0.py", "python", "\n".join(library)), (4, "b/1.py", "python", "\n".join(library[2:18]))]
    windows = [set(H.window_hashes(t)) for *_, t in rows]
    brute = {i + 1 for i, w in enumerate(windows) if len(w) >= 4 and any(rows[i][0] != rows[j][0] and 2 * len(w & v) >= len(w) for j, v in enumerate(windows))}
    files = spark.createDataFrame([(i, s, p, la, t, "o", "v") for i, (s, p, la, t) in enumerate([*rows], 1)], SCHEMA)
    pointed = {r.file_id for r in H.not_handwritten(files).collect()}
    assert {r.file_id for r in H.not_handwritten(files.unionByName(files), full=True).collect()} == brute > pointed


def test_full_containment_in_published_files_and_large_groups(spark):
    library = code(21)
    rows = [(i % 3, f"lib{i}/y.py", "python", "\n".join([*library[: i % 15], f"patched = {i}", *library[i % 15 + 1 :]])) for i in range(90)] + [(7, "own/1.py", "python", "\n".join(code(5)))]
    files = spark.createDataFrame([(i, s, p, la, t, "o", "v") for i, (s, p, la, t) in enumerate(rows, 1)], SCHEMA)
    assert {r.file_id for r in H.not_handwritten(files, full=True).collect()} == set(range(1, 91))
    up = spark.createDataFrame([(1, "lib", "1.0", "python", "\n".join(code(5)))], UPSTREAM)
    assert {r.file_id for r in H.not_handwritten(files, up, full=True).collect()} == set(range(1, 92))


def test_a_container_behind_many_other_holders_is_found(spark):
    # Every window of the copy is also in small files of forty sources; the source of the container is never least or largest in the orders.
    library = code(21, 12)
    rows = [(1, "a/0.py", "python", "\n".join(library)), (101, "b/0.py", "python", "\n".join([*code(22, 40), *library, *code(23, 40)]))]
    rows += [(s, f"c/{s}/{k}.py", "python", "\n".join([*code(1000 * s + k, 8), *library[k : k + 3]])) for s in range(10, 50) for k in range(len(library) - 2)]
    files = spark.createDataFrame([(i, s, p, la, t, "o", "v") for i, (s, p, la, t) in enumerate(rows, 1)], SCHEMA)
    assert {r.file_id for r in H.not_handwritten(files, full=True).collect()} == {1}


def test_headings_are_read_whole():
    long_heading = "\n".join(f"// note {i} on this package" for i in range(60)) + "\n// Code generated by tool. DO NOT EDIT.\n"
    assert H.verdict("lib/a.go", "go", long_heading + "\nfunc a() {}\n") == "generated"
    assert H.verdict("lib/a.go", "go", "func a() {}\n\n// Code generated by tool. DO NOT EDIT.\n" + "\n".join(f"// note {i}" for i in range(60)) + "\n") == "generated"


def test_short_copies_of_published_files(spark):
    short = "import one\nvalue = one.load(1)\nother = one.load(value)"
    up = spark.createDataFrame([(1, "lib", "1.0", "python", short)], UPSTREAM)
    rows = [(1, "s/a.py", "python", short + "\n"), (2, "s/b.py", "python", short.replace("load(1)", "load(2)")), (3, "s/c.py", "python", "x = 1")]
    files = spark.createDataFrame([(i, s, p, la, t, "o", "v") for i, (s, p, la, t) in enumerate(rows, 1)], SCHEMA)
    assert {r.file_id for r in H.not_handwritten(files, up, full=True).collect()} == {1}
