"""Columns over text: tokens, identifiers, phrases, clean-up, presentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit separator: never part of a token, so joined tokens can be searched as text.
SEPARATOR = "\x1f"

# Stopwords of query expansion, German, English and generic code words.
EXPANSION_STOPWORDS = [
    "und", "oder", "der", "die", "das", "ein", "eine", "ist", "sind", "war", "waren", "für", "mit", "von", "zu", "bei", "nach", "über", "unter", "durch", "aus",
    "the", "a", "an", "and", "or", "is", "are", "was", "were", "be", "been", "for", "with", "of", "to", "at", "by", "from", "in", "on", "as", "it",
    "function", "class", "method", "variable", "file", "code", "data",
]
# The ligatures of printed text and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "Ĳ": "IJ", "ĳ": "ij", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}
# Elements whose content is no text of a page.
PAGE_FURNITURE = ["script", "style", "nav", "header", "footer", "aside"]
# The entities decoded in pages; the ampersand is last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def words(text: Column) -> Column:
    """Lower-case word tokens: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def posting_tokens(text: Column) -> Column:
    """Word tokens, and the space-separated tokens that are more than one word but hold a word sign."""
    spaced = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.rlike(r"[^\p{L}\p{N}_]") & w.rlike(r"[\p{L}\p{N}_]"))
    return F.concat(words(text), spaced)


def exact_identifiers(text: Column) -> Column:
    """The distinct word tokens that hold an underscore or a digit, sorted."""
    return F.array_sort(F.array_distinct(F.filter(words(text), lambda w: w.rlike(r"_|\p{N}"))))


def phrase_key(text: Column) -> Column:
    """The tokens between separators, for exact phrase containment."""
    return F.concat(F.lit(SEPARATOR), F.array_join(words(text), SEPARATOR), F.lit(SEPARATOR))


def has_phrase(text: Column, phrase: Column) -> Column:
    return F.when(F.size(words(phrase)) > 0, phrase_key(text).contains(phrase_key(phrase))).otherwise(F.lit(False))


def camel_split(name: Column) -> Column:
    """Parts of a name at lower-upper and letter-digit borders; empty where nothing splits."""
    cut = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})", SEPARATOR)
    parts = F.split(cut, SEPARATOR)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def identifier_words(name: Column) -> Column:
    """Lower-case words of at least three letters of a compound name."""
    camel = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    parts = F.split(F.when(name.contains("_"), name).otherwise(camel), "_")
    return F.filter(F.transform(parts, lambda p: F.trim(F.lower(p))), lambda p: (F.length(p) >= 3) & p.rlike(r"^\p{L}+$"))


def expanded_query(query: Column, synonyms: Column | None = None) -> Column:
    """The terms of a query for an any-of search, sorted and joined by bars; each of ``synonyms`` (term, aliases) adds its term and first alias."""
    stop = F.array(*[F.lit(w) for w in EXPANSION_STOPWORDS])
    plain = lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_\-]", ""))
    terms = F.filter(F.split(F.trim(query), r"\s+"), lambda t: ~F.array_contains(stop, F.lower(t)))
    clean = F.transform(terms, plain)
    parts = F.filter(F.transform(F.flatten(F.transform(terms, camel_split)), F.lower), lambda p: (F.octet_length(p) >= 2) & ~F.array_contains(stop, p))
    more = []
    if synonyms is not None:
        more = [F.transform(synonyms, lambda s: plain(s["term"])), F.filter(F.transform(synonyms, lambda s: plain(F.get(s["aliases"], F.lit(0)))), lambda a: ~F.array_contains(stop, a))]
    every = F.array_sort(F.array_distinct(F.filter(F.concat(clean, parts, *more), lambda t: t != "")))
    return F.when(F.size(terms) == 0, query).otherwise(F.array_join(every, " | "))


def snippet(text: Column, query: Column, around: int = 80) -> Column:
    """The first query word of at least two bytes that occurs in ``text`` (ASCII case aside), marked, with its surroundings."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  # else a text is folded for every word

    def shown(word: Column, at: Column) -> Column:
        start = F.greatest(F.lit(1), at - around - 1)
        stop = F.least(F.length(text), at + F.length(word) - 1 + around)
        return F.when(
            word.isNotNull(),
            F.concat(
                F.when(start > 1, "...").otherwise(""), F.substring(text, start, at - start), F.lit("**"), F.substring(text, at, F.length(word)), F.lit("**"),
                F.substring(text, at + F.length(word), stop - at - F.length(word) + 1), F.when(stop < F.length(text), "...").otherwise(""),
            ),
        )

    def first(low: Column) -> Column:
        return F.get(F.filter(F.split(F.trim(query), r"\s+"), lambda w: (F.octet_length(w) >= 2) & low.contains(fold(w))), F.lit(0))

    return once(fold(text), lambda low: once(first(low), lambda word: once(F.instr(low, fold(word)), lambda at: shown(word, at))))


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def truncated(text: Column, most: int = 16000) -> Column:
    """At most ``most`` bytes of ``text``, whole characters, with a note of its size in bytes."""
    # A byte that begins no character is dropped with the rest of its character.
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    whole = F.coalesce(F.try_validate_utf8(raw.cast("string")), *[F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, most - k).cast("string")) for k in (1, 2, 3)])
    return F.when(F.octet_length(text) > most, F.concat(whole, F.lit("...\n[truncated: "), F.octet_length(text).cast("string"), F.lit(" chars total]"))).otherwise(text)


def page_text(html: Column) -> Column:
    """The readable text of a page: furniture and tags dropped, entities decoded, white space single."""
    plain = reduce(lambda t, e: F.regexp_replace(t, f"(?s)<{e}[^>]*>.*?</{e}>", ""), PAGE_FURNITURE, html)
    plain = F.regexp_replace(plain, "<[^>]+>", " ")
    for entity, sign in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(plain, r"[\s ]+", " "))


def print_cleanup(text: Column) -> Column:
    """Text from printed pages: ligatures spelled out, words joined at line ends, blanks and empty lines single."""
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    text = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def context_prefix(source: Column, path: Column, parent: Column | None = None, most: int = 300) -> Column:
    """``[source] path > parent``, at most ``most`` characters with three dots at the end."""
    whole = F.concat(F.lit("["), source, F.lit("] "), path)
    if parent is not None:
        whole = F.concat(whole, F.coalesce(F.concat(F.lit(" > "), parent), F.lit("")))
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole)


def slug(text: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, most)


def framed_hash(*parts: Column) -> Column:
    """SHA-256 over parts that are each preceded by their length in bytes, so that no two lists of parts agree."""
    framed = [F.concat(F.lpad(F.lower(F.hex(F.octet_length(p))), 16, "0"), F.lower(F.hex(F.encode(p, "UTF-8")))) for p in parts]
    return F.sha2(F.unhex(F.concat(*framed)), 256)


# What is taken out of the sources of a language before they are shown.
REMOVED = {
    "rust": [r"(?dm)^use\s+[^;]+;\s*\n", r"(?dm)^extern\s+crate\s+[^;]+;\s*\n", r"(?dm)^mod\s+\w+;\s*\n", r"(?dm)^//[!/]?\s*(Copyright|SPDX|License|Author).*\n", r"(?dm)^\s*///\s*\n"],
    "python": [r"(?dm)^import\s+[^\n]+\n", r"(?dm)^from\s+\S+\s+import\s+[^\n]+\n", r"(?dm)^#\s*(Copyright|License|Author|SPDX).*\n", r"(?dm)^#!.*\n", r"(?dm)^#.*coding[:=].*\n"],
    "javascript": [
        r"(?dm)^import\s+.*from\s+[\"'][^\"']+[\"'];\s*\n", r"(?dm)^import\s+[\"'][^\"']+[\"'];\s*\n", r"(?dm)^(const|let|var)\s+\w+\s*=\s*require\([^)]+\);\s*\n",
        r"(?dm)^//\s*(Copyright|License|Author|SPDX).*\n", r"(?ds)/\*\*?\s*(Copyright|License|MIT|Apache).*?\*/\s*\n?",
    ],
    "go": [r"(?ds)import\s*\([^)]*\)\s*\n", r"(?dm)^import\s+\"[^\"]+\"\s*\n", r"(?dm)^//\s*(Copyright|License|Author|SPDX).*\n"],
    "java": [r"(?dm)^import\s+[^;]+;\s*\n", r"(?dm)^package\s+[^;]+;\s*\n", r"(?ds)/\*\*?\s*(Copyright|License|Author).*?\*/\s*\n?"],
    "c": [r"(?dm)^#include\s*[<\"][^>\"]+[>\"]\s*\n", r"(?dm)^//\s*(Copyright|License|Author|SPDX).*\n", r"(?ds)/\*\*?\s*(Copyright|License|Author).*?\*/\s*\n?"],
}
SAME_RULES = {"rust": ["rust"], "python": ["python"], "javascript": ["javascript", "typescript", "ts", "tsx", "jsx"], "go": ["go"], "java": ["java"], "c": ["c", "cpp", "h", "hpp"]}
REMOVED_ELSE = r"(?dm)^[#/]+\s*(Copyright|License|Author|SPDX).*\n"


def compressed(text: Column, language: Column, least: int = 100) -> Column:
    """``text`` without imports and licence heads; texts under ``least`` bytes stay as they are."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, REMOVED_ELSE, ""), "\n{3,}", "\n\n"), "[ \t]+\n", "\n")
    for rules, languages in SAME_RULES.items():
        plain = reduce(lambda t, p: F.regexp_replace(t, p, ""), REMOVED[rules], text)
        out = F.when(language.isin(languages), F.regexp_replace(plain, "\n{3,}", "\n\n")).otherwise(out)
    return F.when(F.octet_length(text) < least, text).otherwise(F.regexp_replace(out, r"^\s+|\s+$", ""))
