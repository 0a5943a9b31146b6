"""Oversized texts cut into overlapping pieces at natural boundaries, by content-defined chunking.

A gear hash rolls over the text; where it is lowest within reach is a landmark, which snaps to the nearest natural
boundary (a blank line, a declaration, an unindented line, any line start) between the least and the largest size. As
landmarks depend on the text around them and not on the place, an edit changes only the pieces near it.

The same line index with its rolling line hashes tells, without bringing the texts together, whether stored pieces are
what they claim to be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SIZE, MIN_SIZE, OVERLAP = 1500, 600, 2
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_REACH = 32
_DECLARATION = re.compile(r"(?:(?:pub |export |public |private |static |async )*(?:def|class|func|fn|function|impl|struct|interface|enum|type|module|namespace|resource|CREATE)\b|#+ |\[)")


def gear_hashes(text: str) -> np.ndarray:
    """A rolling hash of the last 32 bytes' worth of characters, for every character of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gear = _GEAR[(codes ^ (codes >> np.uint32(8))) & np.uint32(255)]
    total = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(_REACH, len(codes))):
            total[k:] += gear[: len(codes) - k] << np.uint64(k)
    return total


def _units(lines: list[str], most: int) -> list[tuple[int, str, bool]]:
    """(line from 1, text, begins its line): lines, the too long ones in parts.

    A line is too long only if it doesn't fit into a piece with the two lines that must come before it; of such three
    the longest is parted, so that any three units that follow each other fit.
    """
    long = set()
    sizes = [len(x) for x in lines]
    part = max(1, (most - 2) // 3 - 1)
    for k in range(len(lines)):
        three = range(max(0, k - 2), k + 1)
        kept = [j for j in three if j not in long]
        while sum(min(sizes[j], part) if j in long else sizes[j] for j in three) + len(three) - 1 > most and kept:
            worst = max(kept, key=lambda j: sizes[j])
            long.add(worst)
            kept.remove(worst)
    out = []
    for k, line in enumerate(lines):
        if k not in long or sizes[k] <= part:
            out.append((k + 1, line, True))
            continue
        at = 0
        while at < len(line):
            end = min(len(line), at + part)
            if end < len(line):
                cut = max(line.rfind(c, at + part // 2, end) for c in " ,;)}")
                end = cut + 1 if cut > 0 else end
            out.append((k + 1, line[at:end], at == 0))
            at = end
    return out


def _rank(lines: list[str], k: int) -> int:
    """How natural a cut before line ``k`` (from 0) is; more is better."""
    line, before = lines[k], lines[k - 1] if k else ""
    if not before.strip():
        return 3 if line and not line[:1].isspace() else 2
    return 2 if _DECLARATION.match(line) else int(bool(line) and not line[:1].isspace() and line[:1] not in ")}]")


def split_text(text: str, most: int = MAX_SIZE, least: int = MIN_SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each piece of ``text``; one piece if it is no longer than ``most``."""
    if len(text) <= most:
        return [(1, text.count("\n") + 1, text)]
    lines = text.split("\n")
    units = _units(lines, most)
    hashes = gear_hashes(text)
    ends, at = [], -1  # of each unit, its last character's place in the text
    for n, (_, unit, _begins) in enumerate(units):
        at += len(unit) + (n > 0 and units[n][2])
        ends.append(min(max(at, 0), len(text) - 1))
    score = hashes[ends]
    grade = [_rank(lines, units[n + 1][0] - 1) if n + 1 < len(units) and units[n + 1][2] else -1 for n in range(len(units))]

    def joined(a: int, b: int) -> str:
        return "".join(("\n" if k > a and units[k][2] else "") + units[k][1] for k in range(a, b + 1))

    pieces, start = [], 0
    while True:
        size, fits = 0, []
        for k in range(start, len(units)):
            size += len(units[k][1]) + (k > start and units[k][2])
            if size > most:
                break
            fits.append((k, size))
        if fits[-1][0] == len(units) - 1:
            pieces.append((start, fits[-1][0]))
            break
        allowed = [(k, s) for k, s in fits if k >= start + overlap] or fits[-1:]
        window = [k for k, s in allowed if s >= least and grade[k] >= 0] or [k for k, _ in allowed[-1:]]
        landmark = min(window, key=lambda k: int(score[k]))
        best = max(grade[k] for k in window)
        # The landmark snaps to the nearest of the best boundaries that are in reach.
        end = min((k for k in window if grade[k] == best), key=lambda k: (abs(ends[k] - ends[landmark]), k))
        pieces.append((start, end))
        start = max(start + 1, end + 1 - overlap)
    return [(units[a][0], units[b][0], joined(a, b)) for a, b in pieces]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, n, *p) for i, t in zip(b["file_id"], b["text"], strict=True) for n, p in enumerate(split_text(t))]
        yield pd.DataFrame(rows, columns=["file_id", "piece_no", "start_line", "end_line", "content_text"])


def split_files(files: DataFrame) -> DataFrame:
    """``file_id, piece_no, start_line, end_line, content_text``: the pieces of every file.

    A text within the limit, also an empty one, is one piece; null texts and ids give none; repeated rows give one set
    of pieces; other columns are ignored; an empty table gives none. Lines are split at LF, a CR stays in its line.
    """
    texts = files.select(F.col("id").cast("long").alias("file_id"), F.col("content_text").alias("text")).where("text is not null and file_id is not null").dropDuplicates(["file_id"])
    return texts.mapInPandas(_split, "file_id long, piece_no int, start_line int, end_line int, content_text string")


def line_prefixes(text: str) -> list[int]:
    """Rolling hash over the lines of ``text``: entry k covers the first k lines."""
    out, rolling = [0], 0
    for line in text.split("\n"):
        rolling = (rolling * _BASE + xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))) & _MASK
        out.append(rolling)
    return out


def _index_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"file_id": b["file_id"], "prefixes": [np.array(line_prefixes(t), dtype=np.uint64).tobytes() for t in b["text"]]})


def _index_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        whole = [line_prefixes(t) if t is not None else None for t in b["text"]]
        out = b.drop(columns=["text"])
        out["size"] = pd.array([None if t is None else len(t) for t in b["text"]], dtype="Int64")
        out["lines"] = pd.array([None if p is None else len(p) - 1 for p in whole], dtype="Int64")
        out["digest"] = [None if p is None else f"{p[-1]:016x}" for p in whole]  # text, as numbers beside nulls lose digits on the way
        yield out


def _differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    powers = [1]
    for b in batches:
        wrong = []
        for raw, start, end, lines, digest in zip(b["prefixes"], b["start_line"], b["end_line"], b["lines"], b["digest"], strict=True):
            if raw is None or digest is None or pd.isna(start) or pd.isna(end):
                wrong.append(True)
                continue
            prefixes = np.frombuffer(raw, dtype=np.uint64)
            start, end = int(start), int(end)
            if start < 1 or end < start or end >= len(prefixes) or lines != end - start + 1:
                wrong.append(True)
                continue
            while len(powers) <= lines:
                powers.append(powers[-1] * _BASE & _MASK)
            there = (int(prefixes[end]) - int(prefixes[start - 1]) * powers[int(lines)]) & _MASK
            wrong.append(f"{there:016x}" != digest)
        yield pd.DataFrame({"piece_id": b["piece_id"], "wrong": wrong})


def faulty_pieces(pieces: DataFrame, files: DataFrame, most: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``piece_id``: the stored pieces that are too long, aren't the lines they claim, or don't join on.

    Pieces of a file follow each other by start_line (nulls last), then id. A null text, line or a missing file is a
    fault of the piece; null ids are ignored; repeated rows count once; an empty table gives none.
    """
    rows = pieces.select(F.col("id").cast("long").alias("piece_id"), F.col("file_id").cast("string").alias("file_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("content_text").alias("text")).where("piece_id is not null").dropDuplicates(["piece_id"])
    indexed = rows.mapInPandas(_index_pieces, "piece_id long, file_id string, start_line long, end_line long, size long, lines long, digest string").withColumn("file_id", F.col("file_id").cast("long"))
    texts = files.select(F.col("id").cast("long").alias("file_id"), F.col("content_text").alias("text")).where("text is not null and file_id is not null").dropDuplicates(["file_id"])
    prefixes = texts.mapInPandas(_index_files, "file_id long, prefixes binary")
    order = Window.partitionBy("file_id").orderBy(F.col("start_line").asc_nulls_last(), "piece_id")
    placed = indexed.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("end_line").over(order))
    badly = placed.where(F.coalesce(F.col("size") > most, F.lit(False)) | F.when(F.col("place") == 1, ~F.col("start_line").eqNullSafe(F.lit(1))).otherwise(~F.col("start_line").eqNullSafe(F.col("before") - F.lit(overlap - 1)))).select("piece_id")
    differs = placed.join(prefixes, "file_id", "left").select("piece_id", "prefixes", "start_line", "end_line", "lines", "digest").mapInPandas(_differ, "piece_id long, wrong boolean").where("wrong").select("piece_id")
    return badly.unionByName(differs).distinct()
