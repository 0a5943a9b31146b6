"""Credentials embedded in files: found over the whole corpus and redacted in place.

Three passes. (1) Every file gives the literals that stand where a credential could stand. (2) The literals are
indexed over the corpus; one that many owners share is a stand-in, a rare one with the shape of a credential is
confirmed. (3) Files that hold a confirmed literal are read again and searched with an Aho-Corasick automaton of
exactly the confirmed literals that the index routes to them, which also finds bare repeats in prose or logs.

No step gathers the confirmed literals on the driver or broadcasts them: they are routed to files by a shuffle join,
so the cost grows with the corpus and not with its square.
"""

from __future__ import annotations

import base64
import bisect
import binascii
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.core.storage import cut

# Prefixes and shapes of publicly documented token formats.
TOKEN_SHAPES = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{50,}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}",
    r"xox[abposr]-[0-9A-Za-z\-]{20,}",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"SG\.[\w\-]{16,}\.[\w\-]{16,}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_\-]{40,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"sk-[A-Za-z0-9]{32,}",
    r"eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]{10,}",
]
# The openings above, for split and for encoded literals.
TOKEN_OPENINGS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "SG.", "npm_", "eyJ"]
# The last words of a setting's name that holds a credential.
KEY_WORDS = [
    r"pass(?:word|wd|phrase|code)?", r"pw", r"pwd", r"clave", r"kennwort", r"passwort", r"contrase(?:n|ñ)a", r"mot_?de_?passe", r"senha", r"has(?:l|ł)o",
    r"secret", r"secret[_\-]?(?:access[_\-]?)?key", r"token", r"bearer", r"api[_\-]?key", r"access[_\-]?key", r"private[_\-]?key", r"signing[_\-]?key",
    r"identified by", r"encryption[_\-]?key", r"auth[_\-]?key", r"credentials?", r"auth", r"authorization",
]
# Words that show that a value only stands in for a credential.
STAND_INS = r"(?i)example|change.?me|placeholder|your[_\- ]|insert|replace|dummy|sample|todo\b|redacted|xxxx|\*\*\*|<[^>]*>|\$\{|\$\(|\{\{|%[A-Z_]+%|^\$\w|\bnull\b|undefined|enc\[|^vault:|^ssm:|^arn:|^env[:.]|^file:|^/|secretsmanager|process\.env|os\.environ"
# Shapes that look random but are none (hashes, digests, identifiers, public material, patterns).
HARMLESS = r"^\$(?:2[abxy]|argon2\w*|[156]|scrypt|pbkdf2\S*)\$|^\{(?:SSHA|SHA|MD5)|^(?:sha\d+|md5)[:\-]|^ssh-|^data:|scram-sha|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|\]\{\d|\.\*|\]\+|\]\*|\\[dwsb]|-----BEGIN CERT|-----BEGIN PUBLIC"

# What may follow each sign that the automaton finds; all of these are matched in place, none searches the text.
TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(TOKEN_SHAPES) + r")(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----)){0,300}")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What stands between two pieces of a key's body: line breaks, also escaped ones, quotes, joining and comment signs.
_PEM_GAP = re.compile(r"""(?:\\+[nrt]|&#1[03];|[\s"'`,;.(){}\[\]|#*<>\\-]|[+/](?![A-Za-z0-9+/]))*""")
_PEM_NOTE = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID): [^\n\\\"'`]*")
_PEM_PIECE = re.compile(r"[A-Za-z0-9+/]+={0,2}(?![\w.(:\[])")
_PEM_SIGNS = re.compile(r"""\\+[nrt]|\\+u000[aAdD]|&#1[03];|[A-Za-z0-9+/=]+""")
URL = re.compile(r"://([^\s:/@\"'<>`]{0,80}):([^\s@/\"'`]{2,})@")
_GLUE = r"""["'`\])]*[ \t]*(?:(?::[ \t]*&?'?(?:\w+[ \t]+)?\w+[ \t]*)?(?:=>|:=|===?|!==?|=|:)|,|[ \t]+BY|[ \t]+value[ \t]*=)?[ \t]*"""
QUOTED = re.compile(r"(?i)" + _GLUE + r"""(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n]){4,})(?P=q)""")
BARE = re.compile(r"""["']?[ \t]*(?:=|:[ \t])[ \t]*(?P<v>[^\s"'`<>]{5,})""")
ELEMENT = re.compile(r">(?P<v>[^<\n]{5,})</")
#: A setting whose name and value stand on two lines, as in lists of environment variables.
NAMED = re.compile(r"""(?i)["']?,?[ \t]*\r?\n[ \t\-]*["']?value["']?\s*[:=][ \t]*["']?(?P<v>[^\s"']{5,})""")
NAMED_BEFORE = re.compile(r"""(?i)\bname["']?\s*[:=]\s*["']?[\w.\-]*$""")
BEARER = re.compile(r"(?i)(?:bearer|basic|(?<=[\"'`])token)\s+(?P<v>[A-Za-z0-9_\-.=+/~]{10,})")
CALL = re.compile(r"""(?i)(?:login|open|connect|auth\w*|bind|configure|setup|init\w*|credentials?)\((?:[^()\n]{0,160},)?\s*(["'])[\w@.\-]+\1\s*,\s*(["'])(?P<v>(?:\\.|(?!\2)[^\\\n]){6,})\2""")
PROSE = re.compile(r"(?i)(?:log-?in\s+[\w.@\-]+\s+(?:password|passwd)\s+|(?:log-?in|creds?|credentials|account)\b:?\s+[\w.@\-]+\s*[:/]\s*|with\s+(?:the\s+)?(?:password|passphrase|token|key)\s*:?\s+[`\"']?|-u\s+['\"]?[\w.@\-]+:|(?:password|passphrase)\s+is\s+[`\"']?)(?P<v>[^\s`\"']{5,})")
#: A call with host, port, user and password, whatever its name.
DIAL = re.compile(r"""\((["'])[\w.\-]+\1\s*,\s*\d+\s*,\s*(["'])[\w@.\-]+\2\s*,\s*(["'])(?P<v>(?:\\.|(?!\3)[^\\\n]){5,})\3""")
#: A database client's password option behind its user option.
OPTION = re.compile(r"""-p(?P<q>["']?)(?P<v>[^\s"'`$]{5,})(?P=q)""")
#: Values put into a database, with the columns before them.
INSERT = re.compile(r"(?i)values\s*\((?P<values>(?:[^()'\n]|'(?:''|[^'\n])*')*)\)")
INSERT_COLUMNS = re.compile(r"\(([\w\s,`\"]+)\)\s*$")
#: A row of a table with a host and a user before the password.
ROW = re.compile(r"""\|\s*[\w\-]+(?:\.[\w\-]+)+\s*\|\s*[\w@.\-]+\s*\|\s*`?(?P<v>[^\s|`]{5,})`?\s*\|""")
SPLIT = re.compile(r"""(["'])[\w.\-]+\1(?:\s*(?:\+|\.\.|\.|<>|\|\||&|,)?\s*(["'])[\w.\-=+/]{2,}\2){1,4}""")
_PARTS = re.compile(r"""(["'])([\w.\-=+/]+)\1""")
_ENCODED_OPENINGS = sorted({base64.b64encode(x.encode()[: len(x) // 3 * 3]).decode() for x in TOKEN_OPENINGS} | {x.encode().hex() for x in TOKEN_OPENINGS if len(x) > 3})
ENCODED = re.compile(r"(?<![A-Za-z0-9+/=])(?:" + "|".join(_ENCODED_OPENINGS) + r")[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/])")
# What the bare repeat of a literal is known by: its runs of letters and digits stand whole wherever it stands by itself.
_SEPARATOR = r"[^A-Za-z0-9\s\"'`(){}\[\];,<>|]"
_ALNUM = re.compile(r"[A-Za-z0-9]+")
_PAIR = re.compile(rf"(?<![A-Za-z0-9])(?=([A-Za-z0-9]+{_SEPARATOR}+[A-Za-z0-9]+))")
_SIGNED = re.compile(rf"(?<![A-Za-z0-9])(?=([A-Za-z0-9]+{_SEPARATOR}))|(?=({_SEPARATOR}[A-Za-z0-9]+))")
_COMPARED = re.compile(r"""["'`\])]*[ \t]*[=!]==?[ \t]*["'`]""")
_KEY_NAME = re.compile(r"(?i)(?:^|_)(?:" + "|".join(KEY_WORDS) + r")$")
_STAND_IN, _HARMLESS = re.compile(STAND_INS), re.compile(HARMLESS)
_GENERIC = re.compile(r"(?i)^(?:password|passwd|pass|secret|token|user|pwd|test|none|true|false|x+|\.+|-+|[\d.,:_\-/ ]+)$")
_WORDS = re.compile(r"^[A-Za-z]{3,}(?:[-+_ ][A-Za-z]{3,}){2,}$")
#: A passphrase: words with single blanks between them, without the words that make a sentence of a message.
_PHRASE = re.compile(r"^[^\W_]{2,}(?: [^\W_]{2,}){2,9}$")
# Words of messages and stand-ins about credentials.
_MESSAGE = re.compile(
    r"(?i)\b(?:the|your|you|our|and|for|not|with|from|this|that|must|was|are|has|been|can|please|enter|set|use|see|value|here|password|passwort|passphrase|secret|credentials?|token|key|"
    r"required|invalid|missing|wrong|incorrect|expired|failed|error|field|login|user|username|new|old|current|forgot|reset|confirm|repeat|choose|own|mot|passe|que|por|para|pour|votre|der|die|das|und|nicht)\b"
)

EXTRACTED = "value string, file_id long, owner long, line_no long, kind string, anchor long"


def stands_in(value: str) -> bool:
    """True for a value that isn't a credential by its own look: stand-ins, references, hashes, patterns, plain numbers."""
    return bool(_GENERIC.match(value) or _STAND_IN.search(value) or _HARMLESS.search(value)) or len(set(value)) < 4


def looks_secret(value: str, key: str = "pass") -> bool:
    """True for a value that has a credential's shape under a setting named ``key``."""
    if stands_in(value):
        return False
    low = key.lower()
    letters, digits = sum(c.isalpha() for c in value), sum(c.isdigit() for c in value)
    odd = sum(not c.isalnum() and c not in "_-., :/" for c in value)
    token_like = low.endswith(("token", "auth", "bearer"))
    if " " in value.strip():
        return not token_like and len(value) >= 15 and bool(_PHRASE.match(value)) and not _MESSAGE.search(value) and (value == value.lower() or value == value.upper() or digits > 0)
    if _WORDS.match(value):
        return not token_like and "_" not in value
    if re.search(r"[(){}\[\];,<>|]", value):
        return False
    if len(value) < (12 if token_like else 6) or letters == 0:
        return False
    return bool(digits >= 2 or (digits and odd) or (odd and letters >= 4 and len(value) >= 8) or (digits and len(value) >= 10) or (len(value) >= (16 if token_like else 8) and re.search("[a-z][A-Z]", value) and re.search("[A-Z]{2}|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{4}", value)))


def _plausible(value: str) -> bool:
    return "EXAMPLE" not in value.upper() and len(set(value)) >= 8 and not re.search(r"(?i)x{6}|0{8}|1234567", value)


def _key_is_code(value: str, text: str, end: int) -> bool:
    """An unquoted value that is program text rather than a literal."""
    return bool(re.search(r"[()\[\]{};,|]|->|::|^[&*$@%]|^\d+[;,]?$", value)) or text[end : end + 1] in ("(", "[") or bool(re.fullmatch(r"[A-Za-z_.]+", value))


def _spellings(pattern: str) -> list[str]:
    """The texts that one of the KEY_WORDS stands for."""
    out = [""]
    for piece in re.findall(r"\(\?:[^)]*\)\??|\[[^\]]*\]\?|.\??", pattern):
        optional = piece.endswith("?") and piece != "?"
        body = piece[:-1] if optional else piece
        choices = body[3:-1].split("|") if body.startswith("(?:") else ["_", "-"] if body.startswith("[") else [body]
        out = [o + c for o in out for c in [*choices, *([""] if optional else [])]]
    return out


def _signs() -> ahocorasick.Automaton:
    """All signs near which a credential can stand, in small letters, with what kind of place they open."""
    kinds: dict[str, set[str]] = {}

    def add(text: str, kind: str) -> None:
        kinds.setdefault(text.lower(), set()).add(kind)

    for pattern in KEY_WORDS:
        for word in _spellings(pattern):
            add(word, "key")
    for opening in TOKEN_OPENINGS:
        add(opening, "token")
    for opening in ["github_pat_", "pk_live_", "sk_test_", "rk_test_", "xoxa-", "xoxo-", "xoxs-", "xoxr-", "pypi-", "hf_", "sk-"]:
        add(opening, "token")
    for opening in _ENCODED_OPENINGS:
        add(opening, "encoded")
    for text in ("login", "log-in", "creds", "cred ", "credentials", "account", "with ", "-u ", "password is", "passphrase is"):
        add(text, "prose")
    for text in ("login(", "open(", "connect(", "auth", "bind(", "configure(", "setup(", "init", "credential"):
        add(text, "call")
    for text in ("bearer", "basic", "token "):
        add(text, "bearer")
    for text in ('("', "('"):
        add(text, "dial")
    add(" -p", "option")
    add("| ", "row")
    add("values", "insert")
    add("://", "url")
    add("-----begin ", "pem")
    automaton = ahocorasick.Automaton()
    for text, found in kinds.items():
        automaton.add_word(text, (len(text), tuple(sorted(found))))
    automaton.make_automaton()
    return automaton


_SIGNS = _signs()
_ORDER = ("pem", "token", "encoded", "url", "key", "bearer", "call", "dial", "option", "row", "insert", "prose")


def literals(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, raw literal, kind) of each place in ``text`` where a credential seems to begin."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places: dict[str, list[tuple[int, int]]] = {}
    for last, (size, found) in _SIGNS.iter(low):
        for kind in found:
            places.setdefault(kind, []).append((last + 1 - size, last + 1))
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str):
        k = bisect.bisect_left(taken, (a, b))
        if not ((k < len(taken) and taken[k][0] < b) or (k and taken[k - 1][1] > a)):
            bisect.insort(taken, (a, b))
            yield a, text[a:b], kind

    for order in _ORDER:
        if order in places:
            yield from _PLACES[order](text, places[order], take)


def key_block_stop(text: str, at: int) -> int:
    """Where the key block that begins at ``at`` stops: behind its END line, or behind the last piece of its body where END is missing."""
    head = text.index("-----", at + 10) + 5
    following = text.find("-----BEGIN", head)
    if m := PEM_END.search(text, head, following if following >= 0 else len(text)):
        return m.end()
    stop, place = head, _PEM_GAP.match(text, head).end()
    while m := _PEM_NOTE.match(text, place) or _PEM_PIECE.match(text, place):
        # A body may end in a short piece; a plain word or name there is the text behind it.
        if m.re is _PEM_PIECE and len(m[0]) < 40 and (re.fullmatch(r"[A-Z]?[a-z]+|[A-Z]+", m[0]) or (len(m[0]) < 16 and "\n" not in text[m.end() : m.end() + 2] and text[m.end() : m.end() + 1] not in ("", "\\", '"', "'", "`", "<"))):
            break
        stop, place = m.end(), _PEM_GAP.match(text, m.end()).end()
    return stop


def _blank_key_block(block: str, commented: bool) -> str:
    """``block`` with all its letters, digits and base64 signs blanked; escaped line breaks and signs that join or comment stay."""

    def blank(m: re.Match) -> str:
        run = m[0]
        if run[0] in "\\&" or not any(map(str.isalnum, run)) and len(run) < 3:
            return run
        kept = 2 if commented and run.startswith("//") and not block[block.rfind("\n", 0, m.start()) + 1 : m.start()].strip() else 0
        return run[:kept] + "x" * (len(run) - kept)

    return _PEM_SIGNS.sub(blank, block)


def _pem(text, places, take):
    for a, _ in places:
        if (m := PEM.match(text, a)) and re.search(r"[A-Za-z0-9+/]{40}", m.group()[(head := m.group().index("-----", 10) + 5) :]):
            yield from take(a, min(m.end(), a + head + 100), "pem")


def _token(text, places, take):
    for a, _ in places:
        if m := TOKEN.match(text, a):
            if _plausible(m.group()):
                yield from take(*m.span(), "token")
        elif a and text[a - 1] in "\"'" and (m := SPLIT.match(text, a - 1)):
            joined = ""
            for part in _PARTS.finditer(text, m.start(), m.end()):
                joined += part[2]
                if TOKEN.fullmatch(joined) and _plausible(joined) and joined != part[2]:
                    yield from take(m.start(), part.end(), "token")
                    break


def _encoded(text, places, take):
    for a, _ in places:
        if m := ENCODED.match(text, a):
            raw = m.group()
            try:
                plain = (bytes.fromhex(raw) if re.fullmatch("[0-9a-f]+", raw) else base64.b64decode(raw + "=" * (-len(raw) % 4))).decode("ascii")
            except (ValueError, binascii.Error):
                continue
            if TOKEN.search(plain) and _plausible(plain):
                yield from take(*m.span(), "token")


def _url(text, places, take):
    for a, _ in places:
        if (m := URL.match(text, a)) and a and text[a - 1].isalnum() and len(m[2]) >= 4 and not stands_in(m[2]) and not re.search(r"[{}$<>()]", m[2]) and not _STAND_IN.search(m[1]):
            yield from take(*m.span(2), "url")


def _key(text, places, take):
    for a, b in places:
        after = text[b : b + 1]
        if after.isalnum() or after == "_" or (a and text[a - 1].isalpha() and b - a < 8 and not (text[a - 1].islower() and text[a].isupper())):
            continue
        key = text[a:b] if not _COMPARED.match(text, b) else "pass"  # what something is compared with is a value, not a name
        if (m := QUOTED.match(text, b)) and looks_secret(m["v"], key):
            yield from take(*m.span("v"), "keyed")
        elif after == ">" and (m := ELEMENT.match(text, b)):
            if looks_secret(m["v"].strip(), key):
                yield from take(*m.span("v"), "keyed")
        elif m := BARE.match(text, b):
            value = m["v"].rstrip(";\\,.)")
            if not _key_is_code(value, text, m.end()) and looks_secret(value, key):
                yield from take(m.start("v"), m.start("v") + len(value), "keyed")
        elif (m := NAMED.match(text, b)) and NAMED_BEFORE.search(text, max(0, a - 80), a) and looks_secret(m["v"], key):
            yield from take(*m.span("v"), "keyed")


def _matched(pattern: re.Pattern, kind: str, word: bool):
    def run(text, places, take):
        for a, _ in places:
            if not (word and a and (text[a - 1].isalnum() or text[a - 1] == "_")) and (m := pattern.match(text, a)) and looks_secret(m["v"], "pass"):
                yield from take(*m.span("v"), kind)

    return run


def _option(text, places, take):
    for a, _ in places:
        line = text[text.rfind("\n", 0, a) + 1 : a]
        if re.search(r"\s-u\s?\S", line) and (m := OPTION.match(text, a + 1)) and looks_secret(m["v"], "pass"):
            yield from take(*m.span("v"), "pair")


def _insert(text, places, take):
    for a, _ in places:
        if (m := INSERT.match(text, a)) and (columns := INSERT_COLUMNS.search(text, max(0, a - 400), a)):
            names = [c.strip(" `\"\n") for c in columns[1].split(",")]
            for name, v in zip(names, re.finditer(r"'((?:''|[^'\n])*)'|[^\s,][^,]*", m["values"]), strict=False):
                if v[1] and _KEY_NAME.search(name) and looks_secret(v[1], "pass"):
                    yield from take(m.start("values") + v.start(1), m.start("values") + v.end(1), "keyed")


_PLACES = {"insert": _insert, "dial": _matched(DIAL, "pair", False), "option": _option, "row": _matched(ROW, "pair", False), "pem": _pem, "token": _token, "encoded": _encoded, "url": _url, "key": _key, "bearer": _matched(BEARER, "keyed", True), "call": _matched(CALL, "pair", False), "prose": _matched(PROSE, "pair", True)}


def _telling(run: str) -> bool:
    """True for a run of letters and digits that is no plain word, name or number."""
    return len(run) > 1 and not run.isdigit() and (not run.isalpha() or len(run) >= 8 and bool(re.search("[a-z][A-Z]", run)) and bool(re.search("[A-Z]{2}|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{4}", run)))


def anchors(text: str) -> set[str]:
    """What of ``text`` a literal that stands there by itself can be routed by: telling runs, joined runs, and runs with a sign."""
    return {r for r in set(_ALNUM.findall(text)) if _telling(r)} | set(_PAIR.findall(text)) | {x or y for x, y in _SIGNED.findall(text)}


def anchor_of(literal: str) -> str | None:
    """The one of its ``anchors`` that every text has in which ``literal`` stands by itself; None for one without any."""
    # The index value of a key block ends anywhere within its body.
    whole = literal.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") if literal.startswith("-----BEGIN") else literal
    runs = _ALNUM.findall(whole)
    for found in ([r for r in runs if _telling(r)], _PAIR.findall(whole), [x or y for x, y in _SIGNED.findall(whole)]):
        if found:
            return max(found, key=lambda x: (len(x), x))
    return None


def _hashed(anchor: str) -> int:
    return xxhash.xxh3_64_intdigest(anchor) - (1 << 63)


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, owner, text in zip(batch["file_id"], batch["owner"], batch["text"], strict=True):
            starts = _line_starts(text)
            for at, raw, kind in literals(text):
                anchor = anchor_of(raw)
                rows.append((raw, file_id, owner, bisect.bisect_right(starts, at), kind, anchor and _hashed(anchor)))
        yield pd.DataFrame(rows, columns=["value", "file_id", "owner", "line_no", "kind", "anchor"]).astype({"line_no": "Int64", "anchor": "Int64"})


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(file_id, _hashed(x)) for file_id, text in zip(batch["file_id"], batch["text"], strict=True) for x in anchors(text)]
        yield pd.DataFrame(rows, columns=["file_id", "anchor"])


def _texts(files: DataFrame) -> DataFrame:
    return files.select(F.col("id").cast("long").alias("file_id"), F.coalesce(F.col("source_id").cast("long"), F.lit(-1)).alias("owner"), F.col("content_text").alias("text")).where("text is not null and file_id is not null and length(text) >= 8")


def confirmed_literals(index: DataFrame, owners: DataFrame, widely_shared: float = 0.2, least_owners: int = 5) -> DataFrame:
    """``value``: the literals of the corpus index that are credentials.

    A value that more than ``widely_shared`` of all owners have (and more than ``least_owners``) is a stand-in.
    """
    by_owner = index.groupBy("value", "owner").agg(F.count("*").alias("n"))
    by_value = by_owner.groupBy("value").agg(F.count("*").alias("owners"))
    most = max(least_owners, widely_shared * owners.select("owner").distinct().count())
    return by_value.where(F.col("owners") <= most).select("value")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edge = re.compile(r"[A-Za-z0-9]")
    for batch in batches:
        rows = []
        for file_id, text, values in zip(batch["file_id"], batch["text"], batch["values"], strict=True):
            automaton = ahocorasick.Automaton()
            for v in values:
                automaton.add_word(v, v)
            automaton.make_automaton()
            starts = _line_starts(text)
            for last, v in automaton.iter(text):
                a, b = last - len(v) + 1, last + 1
                # A key block is known by its beginning and found through its end; any other literal must stand by itself.
                if v.startswith("-----BEGIN"):
                    rows.append((file_id, bisect.bisect_right(starts, a), a, max(b, key_block_stop(text, a))))
                elif (not (a and edge.match(text[a - 1]) and edge.match(v[0])) and not (edge.match(text[b : b + 1]) and edge.match(v[-1]))):
                    rows.append((file_id, bisect.bisect_right(starts, a), a, b))
        yield pd.DataFrame(rows, columns=["file_id", "line_no", "start", "stop"])


def find_credentials(files: DataFrame) -> DataFrame:
    """``file_id, line_no, start, stop``: each place of ``files`` where a credential stands (line from 1, characters from 0).

    Null ids and null texts give no row, an empty table gives none; a repeated row gives the place once; other columns
    of ``files`` are ignored. A value in several files is reported in each.
    """
    texts = _texts(files)
    index = cut(texts.mapInPandas(_extract, EXTRACTED))
    confirmed = confirmed_literals(index, files.select(F.coalesce("source_id", F.lit(-1)).alias("owner")))
    known = index.select("value", "file_id", "anchor").join(confirmed, "value")
    repeats = texts.select("file_id", "text").mapInPandas(_places, "file_id long, anchor long").join(known.select("value", "anchor").distinct(), "anchor").select("file_id", "value")
    routed = known.select("file_id", "value").unionByName(repeats).groupBy("file_id").agg(F.collect_set("value").alias("values"))
    return texts.dropDuplicates(["file_id"]).drop("owner").join(routed, "file_id").mapInPandas(_scan, "file_id long, line_no long, start int, stop int").distinct()


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            if text is None or spans is None:
                out.append(text)
                continue
            parts, at = [], 0
            for s in sorted(((s["start"], s["stop"]) for s in spans)):
                if s[1] <= at:
                    continue
                a = max(s[0], at)
                if text.startswith("-----BEGIN", s[0]):
                    blanked = _blank_key_block(text[a : s[1]], text[text.rfind("\n", 0, s[0]) + 1 : s[0]].strip().startswith("//"))
                else:
                    blanked = re.sub(r"[^\W_]", "x", text[a : s[1]])
                parts += [text[at:a], blanked]
                at = s[1]
            out.append("".join([*parts, text[at:]]))
        yield pd.DataFrame({"file_id": batch["file_id"], "redacted": out})


def redact(files: DataFrame) -> DataFrame:
    """``file_id, redacted``: every text with its credentials blanked, letter for letter, quotes and line breaks kept.

    The length of each text, its lines and its quoting stay as they are, so the code around still parses. Null texts
    stay null; null ids give no row.
    """
    spans = find_credentials(files).groupBy("file_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    texts = files.select(F.col("id").cast("long").alias("file_id"), F.col("content_text").alias("text")).where("file_id is not null").dropDuplicates(["file_id"])
    return texts.join(spans, "file_id", "left").mapInPandas(_redact, "file_id long, redacted string")
