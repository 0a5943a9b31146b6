"""Files that nobody wrote by hand: generated, minified, vendored, or data kept as code.

One pass over the texts gives each file's own verdict (path, heading comments and the composition of its tokens) and
the hashes of its line windows. The windows make an inverted index over the corpus and the published third-party
files. Of the windows that more than one source has, however many files hold them, each names several of its holders
(the least and the largest in some hash orders of the holders); these are the candidates of a file that holds it, and the
windows that a file shares with each candidate are counted in full. Files without a container among these are compared
with all holders of so many of their rarest windows that none can be missed. A file that is mostly contained in a file
of another source, or in a published one, is a copy, also when it was patched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core.storage import cut

# Dependency lock files.
LOCK_FILES = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock|mix\.lock|pubspec\.lock|podfile\.lock|flake\.lock|packages\.lock\.json|\.terraform\.lock\.hcl)$"
# File names that tools give to their output.
GENERATED_NAMES = r"(?i)(?:\.pb\.\w+|_pb2(?:_grpc)?\.\w+|\.g\.\w+|\.gen\.\w+|\.generated\.\w+|\.designer\.\w+|_generated\.\w+|\.pb\.(?:cc|h))$"
MINIFIED_NAMES = r"(?i)(?:[.\-_]min|[.\-]bundle|[.\-]chunk)\.(?:js|css|mjs)$"
# Folders that hold tool output or third-party code.
OUTPUT_FOLDERS = r"(?:^|/)(?:gen|generated|__generated__|codegen|autogen)/"
VENDOR_FOLDERS = r"(?:^|/)(?:vendor|third_party|third-party|thirdparty|node_modules|bower_components|site-packages|deps|external|extern)/"
# How tools announce their output, in several languages.
GENERATED_SAYS = (
    r"(?i)code generated by|do not (?:edit|modify|change)|auto-?generated|@generated|automatically generated|generated by (?:the )?[\w\-]+ (?:compiler|generator)|changes will be lost|machine-made file|"
    r"fichier (?:produit|généré)|ne pas modifier|automatisch erzeugt|nicht von hand|generado por|no (?:editar|modificar)|gerado (?:por|automaticamente)|não (?:editar|edite)|generato (?:da|automaticamente)|"
    r"wygenerowano|nie edytuj|output of [\w\-]+, rebuilt|rebuilt on every|produced (?:by [\w\-]+ )?from|сгенерирован|не редактировать|自动生成|自動生成"
)
VENDORED_SAYS = r"(?i)vendored from|upstream revision|upstream: https?://|\(c\) \d{4} the (?!project)[\w\-]+ contributors|copied from [\w\-]+ v?\d"
_HEAD_COMMENT = re.compile(r"^\s*(?://|#(?!\s*(?:define|include|if|ifdef|ifndef|endif|pragma|undef)\b)|--|/\*|\*|<!--|;|%|'|\"\"\"|<\?php\s*$|﻿)")
_LOCK, _GEN_NAME, _MIN_NAME, _OUT, _VENDOR = (re.compile(x) for x in (LOCK_FILES, GENERATED_NAMES, MINIFIED_NAMES, OUTPUT_FOLDERS, VENDOR_FOLDERS))
_GEN_SAYS, _VEN_SAYS = re.compile(GENERATED_SAYS), re.compile(VENDORED_SAYS)
#: The head of a function that reads, writes or asks for one member.
_ACCESSOR = re.compile(r"(?im)^[^\n#/*\"']*?\b(get|set|has|clear|add)_?([A-Z]\w*|[a-z]\w*?)\s*\([^\n]*\)[^\n;]*$")
#: A license banner or stub marker for one member says nothing about the whole file.
_MEMBER = re.compile(r"(?i)method stub|by hand, run|later by|generated client")
WINDOW = 3
# What turns the hash order of a window's holders into other orders.
ORDERS = [0, 0x35A9C3E1F7B2D84D, 0x6C1E94B75D03F8A9, 0x53D27A0EB8C4619F]

FEATURES = "file_id long, owner long, verdict string, content long, windows array<long>"
CODE = re.compile(r"(?i)\.(?:py|rs|js|mjs|ts|tsx|jsx|go|java|c|h|cc|cpp|hpp|cs|rb|php|lua|css|json|swift|kt|scala)$")


def _commented(lines: list[str]) -> list[str]:
    """The comment lines and blank lines that ``lines`` begin with."""
    first = next((k for k, line in enumerate(lines) if line.strip() and not _HEAD_COMMENT.match(line)), len(lines))
    return lines[:first]


def heading(text: str) -> str:
    """The comment lines before the first code of ``text``."""
    return "\n".join(_commented(text.lstrip("\ufeff").split("\n")))


def footing(text: str) -> str:
    """The comment lines behind the last code of ``text``."""
    return "\n".join(_commented(text.rstrip().split("\n")[::-1]))


def composition(text: str, web: bool = False) -> str | None:
    """``minified`` or ``data`` by what the tokens of ``text`` are, else None; scripts and styles (``web``) show it on shorter lines."""
    n = len(text)
    if n < 100:
        return None
    lines = text.split("\n")
    digits = sum(map(text.count, "0123456789"))
    # Data: literals, not names or statements, fill the file.
    literal = sum(len(m) for m in re.findall(r"0x[0-9a-fA-F]{2}\b|-?\b\d[\d.]*\b|\"[A-Za-z0-9+/=]{40,}\"|'[A-Za-z0-9+/=]{40,}'", text))
    separators = sum(map(text.count, ",[]{}:\"' \n\r\t"))
    if literal / max(1, n - separators) > 0.6 and literal > 300:
        return "data"
    blank = sum(map(text.count, " \n\r\t"))
    longest = max(map(len, lines))
    code = n - blank
    if longest > (120 if web else 300) and blank / n < 0.09 and n / len(lines) > (60 if web else 150) and code and digits / n < 0.3:
        return "minified"
    if n / len(lines) > 200 and blank / n < 0.06:
        return "minified"
    return None


def only_accessors(text: str) -> bool:
    """True where a file is little but whole sets of accessors for each member, as interface compilers write them."""
    kinds: dict[str, set[str]] = {}
    heads = 0
    for m in _ACCESSOR.finditer(text):
        heads += 1
        kinds.setdefault(m[2].lower(), set()).add(m[1].lower())
    whole = sum(len(v) for v in kinds.values() if len(v) > 1)
    lines = sum(bool(x.strip()) for x in text.split("\n"))
    return whole >= 2 and whole >= 0.6 * heads and 3 * heads >= 0.4 * lines


def rows_of_data(text: str) -> bool:
    """True where nearly all lines are rows of one literal table."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) > 2 and re.search(r"[\[{(]$", lines[0]) and re.match(r"[\]})]", lines[-1]):
        lines = lines[1:-1]
    if len(lines) < 3:
        return len(text) > 500 and len(re.findall(r"\{\"\w+\":", text)) >= 8 and len(re.findall(r"[\w\]\"]\}?,\{", text)) >= 6 and not re.search(r"\b(?:function|def|return|class)\b", text)
    rows = sum(bool(re.match(r"^(?:[\[{(].*[\]})],?|[\w\"'\-.]+\s*:\s*[\[{(].*[\]})],?|[-\d.xa-fA-F, ]+,?|\"[A-Za-z0-9+/=]+\",?)$", x)) for x in lines)
    return rows / len(lines) > 0.85


def verdict(path: str | None, language: str | None, text: str) -> str | None:
    """Why a single file isn't hand-written, by its own path and text; None where neither tells."""
    path = path or ""
    if _LOCK.search(path):
        return "lock"
    said = heading(text) + "\n" + footing(text)
    if any(_GEN_SAYS.search(x) and not _MEMBER.search(x) for x in said.split("\n")):
        return "generated"
    if _VEN_SAYS.search(said):
        return "vendored"
    code = bool(CODE.search(path)) or (language or "") not in ("markdown", "text", "yaml", "toml", "ini", "xml", "sql", "bash", "hcl", "dockerfile", "json", "")
    if code and (_GEN_NAME.search(path) or _OUT.search(path) and "tools/" not in path):
        return "generated"
    if code and only_accessors(text):
        return "generated"
    if _VENDOR.search(path):
        return "vendored"
    if code and _MIN_NAME.search(path):
        return "minified"
    if code and not path.endswith(".json"):
        if found := composition(text, bool(re.search(r"\.(?:m?js|css)$", path))):
            return found
        if rows_of_data(text):
            return "data"
    return None


def window_hashes(text: str, size: int = WINDOW) -> list[int]:
    """Hashes of each ``size`` consecutive lines, without indentation and empty lines."""
    lines = [x for x in (y.strip() for y in text.lstrip("﻿").split("\n")) if len(x) > 1]
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    return list({xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "big") for h in hashes[k : k + size])) - (1 << 63) for k in range(len(hashes) - size + 1)})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        windows = [sorted(window_hashes(t)) for t in b["text"]]
        yield pd.DataFrame(
            {
                "file_id": b["file_id"],
                "owner": b["owner"],
                "verdict": [verdict(p, la, t) for p, la, t in zip(b["path"], b["language"], b["text"], strict=True)],
                "content": [xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "big", signed=True) for h in w)) - (1 << 63) for w in windows],
                "windows": windows,
            }
        )


def _published(upstream: DataFrame | None) -> DataFrame | None:
    if upstream is None:
        return None
    return upstream.select((-F.col("upstream_id").cast("long") - 1).alias("file_id"), (-F.col("upstream_id").cast("long") - 2).alias("owner"), F.lit(None).cast("string").alias("path"), F.col("language"), F.col("content_text").alias("text")).where("text is not null")


def _pointed(features: DataFrame, share: float, least_windows: int) -> DataFrame:
    """``file_id`` of the copies, where each window points to one holder and a file's windows are counted by that holder."""
    # A row given twice counts twice on both sides of the share; `times` takes that out again without moving the windows.
    times = features.groupBy("file_id").agg(F.count("*").alias("times"))
    windows = features.select("file_id", "owner", F.size("windows").alias("n"), F.explode("windows").alias("window")).where(F.col("n") >= least_windows)
    # The smallest and the largest owner of a window, each with its smallest file, come from one partial aggregate: no list of holders is kept.
    holders = windows.groupBy("window").agg(F.min(F.struct("owner", "file_id")).alias("a"), F.max(F.struct("owner", (-F.col("file_id")).alias("minus"))).alias("b"))
    shared = holders.where(F.col("a.owner") != F.col("b.owner"))
    pointed = windows.where("file_id >= 0").join(shared, "window").select("file_id", "n", F.when(F.col("owner") == F.col("a.owner"), -F.col("b.minus")).otherwise(F.col("a.file_id")).alias("other"))
    contained = pointed.groupBy("file_id", "other").agg(F.count("*").alias("common"), F.first("n").alias("n")).join(times, "file_id")
    return contained.where(F.col("common") / F.col("times") >= F.lit(share) * F.col("n")).select("file_id").distinct()


def _contained(features: DataFrame, share: float, least_windows: int) -> DataFrame:
    """``file_id`` of the copies: whatever is mostly contained in one file of another owner.

    Each window names several holders first, which finds nearly all; the rest meet all holders of their rarest windows.
    """
    # Files of one owner with the same windows are one holder; its key orders holders by owner, then by content.
    low = F.lit((1 << 40) - 1)
    key = F.xxhash64("owner").bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.col("content").bitwiseAND(low))
    windows = features.where(F.size("windows") >= least_windows).select("owner", "content", key.alias("key"), F.size("windows").alias("n"), F.explode("windows").alias("window"))
    # No list of a window's holders is kept: these are partial aggregates, also those of the candidates below.
    several = windows.groupBy("window").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("window")
    shared = cut(windows.join(several, "window"))
    # Two files of different owners share only windows of this table, so it is enough to count what they have in common.
    holders = cut(shared.groupBy("owner", "content", "key", "n").agg(F.collect_set("window").alias("windows")))
    asking = holders.where((F.col("owner") >= -1) & (F.size("windows") >= F.lit(share) * F.col("n")))
    ordered = [F.col("key").bitwiseXOR(F.lit(x)) for x in ORDERS]
    candidates = shared.groupBy("window").agg(*(f(x).alias(f"{name}{k}") for k, x in enumerate(ordered) for name, f in (("least", F.min), ("most", F.max))))
    named = F.array_distinct(F.array(*(F.col(f"{name}{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(ORDERS) for name in ("least", "most"))))
    named = candidates.select("window", F.explode(named).alias("other"))
    pairs = asking.select("owner", "content", F.explode("windows").alias("window")).join(named, "window").select("owner", "content", "other").distinct()
    others = holders.select(F.col("key").alias("other"), F.col("owner").alias("other_owner"), F.col("windows").alias("other_windows"))

    def containing(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        both = pairs.join(others, "other").where("owner <> other_owner").join(asking.select("owner", "content", "n", "windows"), ["owner", "content"])
        return both.where(F.size(F.array_intersect("windows", "other_windows")) >= F.lit(share) * F.col("n")).select("owner", "content")

    # The same windows under two owners are copies of each other whatever the candidates are.
    twice = asking.groupBy("content").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("content")
    marked = cut(containing(pairs, asking).unionByName(asking.join(twice, "content").select("owner", "content")).distinct())
    # What is left is asked exactly: a file that has `need` of the `size` shared windows has one of any `size - need + 1`,
    # so the holders of that many, those with the fewest holders, are all that can contain it.
    need = F.ceil(F.lit(share) * F.col("n"))
    left = cut(asking.join(marked, ["owner", "content"], "left_anti"))
    postings = holders.select(F.explode("windows").alias("window"), F.col("owner").alias("other_owner"), F.col("key").alias("other"), F.size("windows").alias("other_size"))
    asked = left.select("owner", "content", need.alias("need"), (F.size("windows") - need + 1).alias("most"), F.explode("windows").alias("window"))
    asked = asked.join(postings.join(asked.select("window").distinct(), "window", "left_semi").groupBy("window").agg(F.count("*").alias("held")), "window")
    rarest = asked.withColumn("place", F.row_number().over(Window.partitionBy("owner", "content").orderBy("held", "window"))).where("place <= most")
    met = rarest.join(postings, "window").where("owner <> other_owner and other_size >= need").select("owner", "content", "other").distinct()
    marked = marked.unionByName(containing(met, left)).distinct()
    return features.where("file_id >= 0").select("file_id", "owner", "content").join(marked, ["owner", "content"]).select("file_id")


def not_handwritten(files: DataFrame, upstream: DataFrame | None = None, share: float = 0.5, least_windows: int = 4, full: bool = False) -> DataFrame:
    """``file_id, reason``: each row of ``files`` that a tool wrote or that is third-party code or bulk data.

    ``share``: the containment in one file of another source, or in a published file, from which a file is a copy.
    ``full``: count what a file shares with each of several holders in full, as the queries do; else each window counts
    for one holder only, and a copy whose windows point to different holders can be missed.
    Files of fewer than ``least_windows`` windows are copies only of published files with the same lines.
    Windows count however many files hold them, so a copy is also told from within a group that fills the corpus.
    Null ids and texts give no row, empty texts neither; a repeated row gives one; an empty table gives none; other
    columns are ignored. A null path or language leaves the text to decide.
    """
    own = files.select(F.col("id").cast("long").alias("file_id"), F.coalesce(F.col("source_id").cast("long"), F.lit(-1)).alias("owner"), "path", "language", F.col("content_text").alias("text")).where("text is not null and file_id is not null")
    published = _published(upstream)
    every = own if published is None else own.unionByName(published)
    features = cut(every.mapInPandas(_features, FEATURES))
    lone = features.where("file_id >= 0 and verdict is not null").select("file_id", F.col("verdict").alias("reason"))

    copies = (_contained if full else _pointed)(features, share, least_windows).select("file_id", F.lit("vendored").alias("reason"))
    # Too short for a share to say something: a copy only where a published file has just the same lines.
    short = features.where((F.size("windows") > 0) & (F.size("windows") < least_windows))
    same = short.where("file_id >= 0").join(short.where("file_id < 0").select("content").distinct(), "content", "left_semi").select("file_id", F.lit("vendored").alias("reason"))
    return lone.unionByName(copies).unionByName(same).groupBy("file_id").agg(F.min("reason").alias("reason"))
