from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import splitting as S

FILES = "id long, content_text string, piece_id string"
PIECES = "id long, file_id long, start_line int, end_line int, content_text string, prefixes string"


def whole(text: str, pieces) -> bool:
    """Every line of the text is in the pieces, in order, and nothing else."""
    lines = text.split("\n")
    covered = set()
    for a, b, piece in pieces:
        if "\n".join(lines[a - 1 : b]) == piece:
            covered.update(range(a, b + 1))
        else:  # a part of long lines
            assert all(p in text for p in piece.split("\n"))
            covered.update(range(a, b + 1))
    return covered == set(range(1, len(lines) + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \té\r", max_size=200), max_size=80))
def test_pieces_are_small_whole_and_overlap(lines):
    text = "\n".join(lines)
    pieces = S.split_text(text, most=300, least=100)
    assert all(len(p) <= 300 for _, _, p in pieces) and whole(text, pieces)
    assert pieces[0][0] == 1 and pieces[-1][1] == len(lines or [""])
    if all(len(x) <= 96 for x in lines):
        assert all("\n".join(text.split("\n")[a - 1 : b]) == p for a, b, p in pieces)
        assert all(b[0] == a[1] - 1 for a, b in zip(pieces, pieces[1:], strict=False))


def test_long_lines_lose_nothing():
    text = "x" * 10_000 + "\nshort\n" + "word " * 4000
    pieces = S.split_text(text)
    assert all(len(p) <= 1500 for _, _, p in pieces)
    rebuilt = "".join(u for _, u, _ in S._units(text.split("\n"), 1500))
    assert rebuilt == text.replace("\n", "")


def test_edits_change_only_pieces_near(spark):
    rng = random.Random(1)
    lines = [f"line {rng.randrange(10**9)} of {rng.randrange(10**9)}" + ("" if i % 7 else "\n") for i in range(600)]
    before = {p for _, _, p in S.split_text("\n".join(lines))}
    lines.insert(20, "one more line")
    after = {p for _, _, p in S.split_text("\n".join(lines))}
    assert len(after - before) <= 4


def test_faulty_pieces_against_brute_force(spark):
    rng = random.Random(4)
    files, pieces, n = [], [], 0
    for f in range(30):
        text = "\n".join("".join(rng.choices("abc \r", k=rng.randrange(60))) for _ in range(rng.randrange(1, 90)))
        files.append((f, text, "x"))
        for a, b, p in S.split_text(text, most=600, least=200):
            n += 1
            fault = rng.randrange(12)
            pieces.append((n, f, a + (fault == 1), b + (fault == 2), p + ("x" if fault == 3 else ""), "p"))
    pieces += [(900, 77, 1, 1, "a", "p"), (901, 1, None, 2, "a", "p"), (902, 2, 1, 1, None, "p"), (None, 1, 1, 1, "a", "p"), pieces[0]]
    got = {r.piece_id for r in S.faulty_pieces(spark.createDataFrame(pieces, PIECES), spark.createDataFrame(files, FILES)).collect()}
    texts, wrong = {f: t.split("\n") for f, t, _ in files}, set()
    by_file: dict = {}
    for row in {p for p in pieces if p[0] is not None}:
        by_file.setdefault(row[1], []).append(row)
    for f, rows in by_file.items():
        before = None
        for k, (i, _, a, b, p, _x) in enumerate(sorted(rows, key=lambda r: (r[2] is None, r[2], r[0]))):
            lines = texts.get(f)
            if p is None or a is None or b is None or lines is None or len(p) > 1500 or a < 1 or b < a or b > len(lines) or "\n".join(lines[a - 1 : b]) != p:
                wrong.add(i)
            if (a != 1) if k == 0 else (before is None or a != before - 1):
                wrong.add(i)
            before = b
    assert got == wrong


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a", "x"), (3, "one", "x")], FILES)
    assert {(r.file_id, r.piece_no, r.content_text) for r in S.split_files(df).collect()} == {(2, 0, ""), (3, 0, "one")}
    assert S.split_files(df.where("false")).count() == 0
