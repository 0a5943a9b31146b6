"""Text that was decoded with the wrong character encoding: found and, where it still can be, restored.

Round-trip repair: a suspicious stretch is encoded again under a candidate legacy encoding and strictly decoded as the
encoding that was meant; the result stands if the garbling cost drops. Layers are undone until nothing drops any more.
Signs that a text only quotes (short code spans) are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that texts are read in by mistake, the likeliest first.
SEEN_AS = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "koi8_r", "cp866", "cp1254", "cp1253", "cp1257", "mac_cyrillic"]
# Two-byte encodings, tried on whole runs only.
SEEN_AS_WIDE = ["gbk", "shift_jis", "cp932", "big5", "euc_jp", "euc_kr"]
# Encodings that were meant, other than UTF-8.
MEANT = ["cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859-2", "cp850", "cp437", "mac_roman", "shift_jis", "euc_jp", "gbk", "latin-1"]
# Letters beyond ASCII of the languages that are told apart, and signs that are usual anywhere.
ALPHABETS = {
    "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "pt": "áâãàçéêíóôõúü", "pl": "ąćęłńóśźż", "en": "éïè", "it": "àèéìòù",
    "cs": "áčďéěíňóřšťúůýž", "tr": "çğıöşü", "nordic": "åäöæøé",
}
USUAL = set("†‡‰Μ’‘“”„‚«»‹›–—…•·×÷±≥≤≠→←↔⇒€£¥©®™§°µ¿¡ªº½¼¾✓✔✗│─├└┌┐┘┤┬┴┼═║")
# Common short words by which a language is told.
COMMON = {
    "de": {"der", "die", "das", "und", "nicht", "ist", "für", "mit", "muss", "wird", "gilt", "auch", "ohne", "bei", "ein", "eine"},
    "fr": {"de", "le", "la", "les", "des", "est", "dans", "pour", "pas", "une", "nous", "avant", "sur", "du", "et"},
    "es": {"la", "de", "y", "en", "no", "está", "el", "los", "las", "que", "una", "con", "para", "del", "por", "más", "es", "se"},
    "pt": {"de", "a", "o", "e", "não", "os", "uma", "para", "com", "são", "da", "do", "na", "em", "que", "foram"},
    "pl": {"nie", "się", "jest", "na", "pliki", "przed", "po", "jeszcze", "dla", "przy", "oraz", "rozmowy"},
    "en": {"the", "and", "of", "is", "in", "to", "was", "were", "after", "with", "that", "every"},
}
# Per mille of each letter in Russian text.
_RU = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", [110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1], strict=True))
_LETTERS = set("".join(ALPHABETS.values())) | {x.upper() for x in "".join(ALPHABETS.values()) if len(x.upper()) == 1}
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_QUOTED = re.compile(r"`[^`\n]{0,12}`|[\"“„][^\x00-\x7f]{1,4}[\"”“]|\([^\x00-\x7f]{1,3}\)")
#: Signs that don't stand inside or right behind a word.
_SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[¹²³´¸¨°¶¬¦¤§ªº¯±¼½¾µ·ˆ˜ˇ˘˙˚˛˝‰†‡ﬁﬂ∂∑∏π∫ΩΩ√∞≈∆◊⌐-⌠─-▟√ƒ£¥¢©®™÷×¿¡„‚‹›‘“«»ÐÞþð†‡•€–](?=[^\W\d_])|(?<=[^\W\d_]{3})[¹²³´¸¨¶¬¤§¯¼½¾ˆ˜ˇ˘˙˛˝ﬁﬂ∂∑∏∫√∞≈∆◊⌐-⌠─-▟¿¡¥¢‘‚€‡†](?![\w)])|(?<![\w(])[ˆ¨´¸¹¬¶ˇ˘˝](?=[^\W\d_]{2})")
_UPPER_INSIDE = re.compile(r"(?<=[a-zß-öø-ÿа-яё])[À-ÖØ-ÞĄĆĘŁŃŚŹŻА-ЯЁ]")
_MIXED = re.compile(r"[A-Za-zÀ-ÿ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÿ]")
_LONG_ACCENTS = re.compile(r"[À-ÿŒœŠšŸŽžĀ-ſ¨°¸´¹²³]{4,}")
_CONTROL = re.compile("[\x80-\x9f\ufffd]")
_ACCENTED = re.compile("[À-ſ]")
_CYRILLIC = re.compile(r"[А-Яа-яЁё]{3,}")


def language(text: str) -> str | None:
    """The language that most common words of ``text`` belong to, None where too few do."""
    words = {w.lower() for w in _WORD.findall(text)}
    found = {k: sum(w in v for w in words) for k, v in COMMON.items()}
    first, second = sorted(found, key=found.get)[:-3:-1]
    return first if found[first] >= 3 and found[first] > 2 * found[second] else None


@lru_cache(maxsize=1 << 17)
def _run_cost(before: str, run: str, after: str) -> float:
    """The cost of one run of characters beyond ASCII, seen with what stands next to it."""
    context, first, last = before + run + after, len(before), len(before) + len(run)
    total = 2.0 * len(_CONTROL.findall(run)) + sum(len(x) for x in _LONG_ACCENTS.findall(run))
    for pattern in (_SIGN_IN_WORD, _UPPER_INSIDE, _MIXED):
        for m in pattern.finditer(context):
            at = m.start() + (context[m.start()] < "\x80")
            total += first <= at < last
    for x in run:
        if "À" <= x <= "ſ" and x not in _LETTERS:
            total += 0.7
        elif x in "¬¶¤¦¨¸¯" or "⌐" <= x <= "⌠" or "▀" <= x <= "▟":
            total += 0.5
    return total


def cost(text: str, lang: str | None = None) -> float:
    """How garbled ``text`` looks; 0 for clean text of any script."""
    total, foreign, own = 0.0, 0, ALPHABETS.get(lang or "")
    cyrillic = False
    for m in _RUN.finditer(text):
        a, b = m.span()
        run = m.group()
        total += _run_cost(text[max(0, a - 4) : a], run, text[b : b + 4])
        cyrillic = cyrillic or "Ѐ" <= run[0] <= "ӿ" or "Ѐ" <= run[-1] <= "ӿ"
        if own:
            foreign += sum("À" <= x <= "ſ" and x in _LETTERS and x.lower() not in own for x in run)
    if cyrillic and (words := _CYRILLIC.findall(text)):
        letters = "".join(words)
        if len(letters) >= 6:
            mean = sum(_RU.get(c, 0.5) for c in letters.lower()) / len(letters)
            if mean < 36:
                total += (36 - mean) / 36 * len(letters)
    return total + 0.3 * foreign


@lru_cache(maxsize=1 << 16)
def _bytes_of(char: str, encoding: str) -> bytes | None:
    try:
        return char.encode(encoding)
    except UnicodeEncodeError:
        if encoding in ("cp1252", "cp1254", "cp1250", "cp1253", "cp1257", "cp1251") and ord(char) < 256:
            return bytes([ord(char)])  # undefined bytes pass as control characters
        return None


_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})")


# Code blocks that restored signs come from.
_BLOCKS = [(0xA0, 0x17F), (0x218, 0x21B), (0x400, 0x45F), (0x490, 0x491), (0x1E9E, 0x1E9E), (0x2002, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x22FF), (0x2460, 0x257F), (0x25A0, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF)]


@lru_cache(maxsize=1 << 14)
def _plain(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _BLOCKS)


def _utf8_run(run: str, encoding: str) -> tuple[str, int]:
    """``run`` with each stretch that is UTF-8 when encoded again restored; how many characters vanished."""
    parts = [_bytes_of(c, encoding) for c in run]
    out, k, gone = [], 0, 0
    while k < len(run):
        if parts[k] is None or len(parts[k]) != 1:
            out.append(run[k])
            k += 1
            continue
        j = k
        while j < len(run) and j < k + 4 and parts[j] is not None and len(parts[j]) == 1:
            j += 1
        m = _UTF8.match(b"".join(parts[k:j]))
        if m:
            c = m.group().decode()
            if _plain(c) or "\x80" <= c <= "\xff":
                out.append(c)
                gone += len(m.group()) - 1
                k += len(m.group())
                continue
        out.append(run[k])
        k += 1
    return "".join(out), gone


@lru_cache(maxsize=1 << 16)
def _mended(run: str) -> str:
    """``run`` read in as the single wrong encoding that explains most of it, or as it is."""
    best, saved = run, 0
    for encoding in SEEN_AS:
        if encoding in ("cp866", "mac_cyrillic") and run.isalpha():
            continue  # Cyrillic words can look like UTF-8 there
        mended, gone = _utf8_run(run, encoding)
        if gone > saved and _signs(mended) <= _signs(run):
            best, saved = mended, gone
    if not saved and len(run) >= 4:
        for encoding in SEEN_AS_WIDE:
            try:
                mended = run.encode(encoding).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if len(mended) < len(run) * 1.1 and all(_plain(c) for c in mended):
                return mended
    return best


def _utf8_layer(text: str) -> str:
    # Runs come back again and again: what one is mended to is remembered.
    return _RUN.sub(lambda m: _mended(m.group()) if len(m.group()) > 1 else m.group(), text)


def _signs(run: str) -> int:
    return sum(c not in USUAL and not c.isalpha() and not c.isspace() for c in run)


def _legacy(stretch: str, lang: str | None, before: float) -> str | None:
    best, least = None, before - 0.9
    for seen in SEEN_AS:
        raw = [_bytes_of(c, seen) for c in stretch]
        if None in raw:
            continue
        raw = b"".join(raw)
        for meant in MEANT:
            if meant == seen:
                continue
            try:
                mended = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if mended == stretch:
                continue
            now = cost(mended, lang)
            if meant in ("shift_jis", "euc_jp", "gbk"):
                wide = sum(c > "⿿" for c in mended)
                kana = sum("぀" <= c <= "ヿ" for c in mended)
                if wide < 3 or wide < 0.3 * sum(c.isalpha() for c in mended) or (meant != "gbk" and kana < 1):
                    continue
            if now < least:
                best, least = mended, now
    return best


def _layer(text: str) -> str:
    """``text`` with one layer of wrong decoding undone, line by line."""
    fallback = ""  # the language of the whole text, told when a line's own can't be
    out = []
    for line in text.split("\n"):
        if not line.isascii():
            mended, lang = line, None
            last = None
            while mended != last:  # inner layers show only when outer ones are gone; each makes the line shorter
                mended, last = _utf8_layer(mended), mended
                if len(mended) >= len(last):
                    break
            if len(_ACCENTED.findall(line)) >= 3:  # fewer letters foreign to a language are no sign
                lang = language(line)
            before = cost(line, lang)
            if before >= 0.9 and lang is None:
                if not (lang := language(line)):
                    fallback = fallback if fallback != "" else language(text)
                    lang = fallback
            now = cost(mended, lang)
            if now >= 0.9 and before >= 0.9:
                other = _legacy(line, lang, before)
                if other is not None and cost(other, lang) < now:
                    mended = other
                elif mended == line:  # only words of the line may be garbled
                    words = re.split(r"(\s+)", line)
                    for k, w in enumerate(words):
                        if not w.isascii() and (own := cost(w, lang)) >= 0.9 and (fixed := _legacy(w, lang, own)) is not None:
                            words[k] = fixed
                    mended = "".join(words)
            line = mended
        out.append(line)
    return "\n".join(out)


def repair(text: str) -> tuple[str, bool]:
    """(the text as far as it can be restored, whether any of it is garbled).

    Layer after layer is undone until nothing changes any more.
    """
    if text.isascii():
        return text, False
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        if m.group().isascii():
            return m.group()
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x00"

    hidden = _QUOTED.sub(hide, text)
    mended = hidden
    seen = {mended}
    while (after := _layer(mended)) not in seen:
        seen.add(after)
        mended = after
    garbled = mended != hidden or "�" in hidden or bool(re.search(r"[\x80-\x9f]", hidden))
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], mended), garbled


def _repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [(None, False) if t is None else repair(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "restored": [x for x, _ in found], "garbled": [y for _, y in found]})


def repair_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, restored, garbled``: every document with its text restored as far as it can be.

    A null text gives a null and isn't garbled; an empty one stays empty; a row given twice comes out twice; an empty
    table gives none; other columns are ignored. Each text is looked at as a whole, whatever its length.
    """
    # Ids go through as text: numbers beside nulls would lose digits on the way.
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_repair_batches, "doc_id string, restored string, garbled boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
