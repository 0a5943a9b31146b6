"""Declarations and calls of source texts, by parsing their token trees.

A text becomes tokens (comments and strings whole), brackets and block words are matched, and declarations are read off
the token tree by rules of the language's family: bodies in braces, by indentation, or up to an ``end``. Nothing is
given up on an error: a bracket without a partner is closed with the block around it, and what fits no rule costs only
itself. Every step is linear in the text.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, replace
from functools import lru_cache

# Which family of rules a language is read by.
FAMILIES = {
    "rust": "braces", "javascript": "braces", "typescript": "braces", "go": "braces", "java": "braces", "csharp": "braces", "c": "braces", "cpp": "braces", "php": "braces", "zig": "braces",
    "python": "indent", "ruby": "end", "lua": "end", "sql": "sql",
}
# Words that are no names of called functions, in all languages and in some.
_COMMON = {
    "if", "for", "while", "switch", "return", "catch", "else", "do", "throw", "case", "function", "class", "new", "import", "try", "finally", "const", "static", "struct", "enum", "interface", "type", "var", "let", "void", "int",
    "public", "private", "protected", "extern", "async", "await", "super", "break", "continue",
}
_WORDS = {
    "rust": {"fn", "match", "loop", "where", "mut", "pub", "impl", "trait", "in", "as", "move", "unsafe", "mod", "use", "dyn", "ref", "crate"},
    "python": {"def", "and", "or", "not", "in", "is", "elif", "assert", "del", "raise", "with", "as", "lambda", "except", "yield", "from", "global", "nonlocal", "pass"},
    "javascript": {"typeof", "instanceof", "in", "of", "yield", "delete", "export"}, "typescript": {"typeof", "instanceof", "in", "of", "yield", "delete", "export", "keyof", "as"},
    "go": {"func", "go", "defer", "select", "range", "chan", "map", "package", "fallthrough"}, "java": {"synchronized", "assert", "instanceof", "throws", "yield"},
    "csharp": {"foreach", "using", "lock", "fixed", "sizeof", "nameof", "typeof", "default", "checked", "unchecked", "delegate", "when", "where", "is", "as", "in", "not", "and", "or"},
    "c": {"sizeof", "goto", "alignof", "_Alignof", "_Static_assert", "__attribute__", "typeof", "defined"}, "cpp": {"sizeof", "goto", "alignof", "decltype", "noexcept", "static_assert", "alignas", "typeid", "delete", "co_await", "co_return", "co_yield", "requires", "__attribute__", "operator"},
    "php": {"foreach", "elseif", "isset", "empty", "array", "list", "echo", "print", "exit", "die", "unset", "fn", "match", "and", "or", "xor", "instanceof", "use", "declare", "require", "include", "require_once", "include_once"},
    "ruby": {"def", "module", "and", "or", "not", "in", "elsif", "unless", "until", "when", "then", "begin", "end", "yield", "rescue", "ensure", "redo", "retry", "self", "undef", "alias", "defined?"},
    "lua": {"and", "or", "not", "in", "elseif", "then", "end", "local", "repeat", "until", "goto", "nil", "true", "false"}, "zig": {"fn", "and", "or", "orelse", "comptime", "defer", "errdefer", "pub", "catch", "test", "inline", "align"},
}
_NO_CALLS = {language: _COMMON | words for language, words in _WORDS.items()}
_NO_CALLS["rust"] -= {"new", "class", "function", "import", "try", "catch", "throw", "switch", "void", "int", "var", "interface", "case", "new", "do", "public", "private", "protected", "finally"}
_NO_CALLS["python"] -= {"new", "switch", "catch", "do", "throw", "case", "function", "const", "static", "struct", "enum", "interface", "type", "var", "let", "void", "int", "public", "private", "protected", "extern", "super"}
_NO_CALLS["ruby"] -= {"new", "switch", "catch", "throw", "function", "import", "const", "static", "struct", "enum", "interface", "type", "var", "let", "void", "int", "public", "private", "protected", "extern", "async", "await", "try"}
_NO_CALLS["lua"] -= {"new", "switch", "catch", "throw", "case", "class", "import", "const", "static", "struct", "enum", "interface", "type", "var", "let", "void", "int", "public", "private", "protected", "extern", "async", "await", "super", "try", "finally", "continue"}
_NO_CALLS["go"] -= {"new", "catch", "throw", "function", "class", "try", "finally", "static", "enum", "let", "void", "int", "public", "private", "protected", "extern", "async", "await", "super", "while", "do"}
_NO_CALLS["c"] -= {"new", "catch", "throw", "function", "class", "import", "try", "finally", "interface", "type", "var", "let", "public", "private", "protected", "async", "await", "super"}
_NO_CALLS["sql"] = set()
# Words behind which a name is an expression and no declared name.
_BEFORE_CALL = {"return", "else", "throw", "await", "yield", "case", "in", "do", "goto", "and", "or", "not", "assert", "is", "as", "when", "co_return", "co_await", "co_yield", "new", "default", "delete", "sizeof", "using"}
# Words that are no part of the type before a function's name.
_NO_TYPE = (_COMMON | _WORDS["java"] | _WORDS["csharp"] | _WORDS["c"] | _WORDS["cpp"]) - {"void", "int", "const", "static", "type", "var", "public", "private", "protected", "struct", "enum", "async", "extern"}

# Words that may stand before a declaration and belong to it.
_MODIFIERS = {
    "pub", "async", "unsafe", "extern", "const", "default", "export", "declare", "abstract", "public", "private", "protected", "internal", "static", "final", "synchronized", "native", "strictfp", "override", "virtual", "sealed",
    "partial", "readonly", "inline", "constexpr", "explicit", "friend", "get", "set", "local", "volatile", "transient", "new", "typedef", "template", "crate", "record",
}
_TYPE_WORDS = {"class", "interface", "enum", "struct", "trait", "union", "record", "namespace", "mod", "module"}
#: A longer receiver of a call isn't given.
LONGEST = 500
#: Kinds whose name qualifies what is declared directly within them.
QUALIFYING = {"class", "struct", "trait", "module"}

_NAME = r"(?:[^\W\d]|\$)[\w$]*"
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_PLAIN = r"\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_OPERATORS = r"::|->|=>|\?\.|:=|\.\.\.?|&&|\|\||[<>!=]=|[^\s\w]"
_PATTERNS = {
    "rust": (r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\[^\n]{1,8}?|[^'\\\n])'", r"'[^\W\d]\w*|" + _NAME),
    "javascript": (_C_COMMENT, _PLAIN + r"|`(?:\\.|[^`\\])*(?:`|\Z)", r"#?" + _NAME),
    "go": (_C_COMMENT, r"`[^`]*(?:`|\Z)|" + _PLAIN, _NAME),
    "java": (_C_COMMENT, r"\"\"\".*?(?:\"\"\"|\Z)|" + _PLAIN, r"@?" + _NAME),
    "csharp": (_C_COMMENT + r"|(?m:^[ \t]*#[^\n]*)", r"\$?@\"(?:\"\"|[^\"])*(?:\"|\Z)|\$?" + _PLAIN, r"@?" + _NAME),
    "c": (_C_COMMENT + r"|(?m:^[ \t]*#(?:\\\r?\n|[^\n])*)", r"R\"\w*\(.*?\)\w*\"|(?:L|u8?|U)?(?:" + _PLAIN + ")", _NAME),
    "php": (_C_COMMENT + r"|#(?!\[)[^\n]*|<\?(?:php\b|=)?|\?>", r"\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)", r"\$?[^\W\d][\w\\]*"),
    "python": (r"#[^\n]*", r"(?i:[rbfu]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _PLAIN + ")", _NAME),
    "ruby": (r"#[^\n]*|(?ms:^=begin\b.*?(?:^=end\b[^\n]*|\Z))", _PLAIN.replace(r"[^\"\\\n]", r"[^\"\\]"), r"(?:@@?|\$)?[^\W\d]\w*[?!]?"),
    "lua": (r"--\[(=*)\[.*?\]\2\]|--[^\n]*", r"\[(=*)\[.*?\]\3\]|" + _PLAIN, _NAME),
    "sql": (r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"'(?:''|[^'])*(?:'|\Z)|\$(\w*)\$.*?\$\2\$|\"[^\"\n]*\"", _NAME),
}
_PATTERNS |= {"typescript": _PATTERNS["javascript"], "cpp": _PATTERNS["c"], "zig": (r"//[^\n]*", _PLAIN, r"@?" + _NAME)}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Unit:
    """A declaration: ``kind`` and ``name``, from character ``start`` to ``stop``, within the unit ``parent`` (a place in the list, or -1)."""

    kind: str
    name: str
    start: int
    stop: int
    parent: int = -1
    depth: int = 0
    visibility: str | None = None


@dataclass(frozen=True)
class Call:
    callee: str
    kind: str
    at: int
    caller: str | None


@dataclass
class _Tokens:
    kinds: list[str]
    values: list[str]
    starts: list[int]
    stops: list[int]
    pair: list[int]


@lru_cache(maxsize=32)
def _lexer(language: str) -> re.Pattern:
    comment, string, name = _PATTERNS[language]
    # The first group is the comment, so back-references within the patterns above count from 2, or from 1 where a language has none before.
    if language == "rust":
        string = string.replace(r"\1", r"\3")
    elif language == "lua":
        string = string.replace(r"\3", r"\4")
    elif language == "sql":
        string = string.replace(r"\2", r"\3")
    return re.compile(rf"(?P<comment>{comment})|(?P<string>{string})|(?P<name>{name})|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<mark>{_OPERATORS})", re.S)


def _tokens(text: str, language: str) -> _Tokens:
    kinds, values, starts, stops, pair = [], [], [], [], []
    open_: list[int] = []
    for m in _lexer(language).finditer(text):
        kind = m.lastgroup if m.lastgroup in ("name", "number", "line", "mark") else "comment" if m["comment"] is not None else "string"
        if kind == "comment":
            continue
        value, at = m[0], len(kinds)
        kinds.append(kind)
        values.append(value)
        starts.append(m.start())
        stops.append(m.end())
        pair.append(-1)
        if kind == "mark":
            if value in _PAIRS:
                open_.append(at)
            elif value in ")]}":
                # A bracket without a partner is passed over; those left open within a closed one end there.
                depth = next((k for k in range(len(open_) - 1, max(-1, len(open_) - 64), -1) if _PAIRS[values[open_[k]]] == value), None)
                if depth is not None:
                    for k in open_[depth:]:
                        pair[k] = at
                    pair[at] = open_[depth]
                    del open_[depth:]
    for k in open_:
        pair[k] = len(kinds) - 1
    return _Tokens(kinds, values, starts, stops, pair)


class _Finder:
    """Reads the declarations off one text's tokens. ``found``: (kind, name, first token, last token, token of the name, first token of the body or -1)."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.t = _tokens(text, language)
        self.found: list[tuple[str, str, int, int, int, int]] = []
        self.heads: set[int] = set()
        self.words = _NO_CALLS[language]
        self.chains: dict[int, int] = {}
        # Where scans that passed a token have ended: no stretch is scanned twice from within.
        self.known: dict[tuple[str, int], int] = {}

    def value(self, at: int) -> str:
        return self.t.values[at] if 0 <= at < len(self.t.values) else ""

    def kind(self, at: int) -> str:
        return self.t.kinds[at] if 0 <= at < len(self.t.kinds) else ""

    def after(self, at: int) -> int:
        """The next token that is no line end."""
        at += 1
        while self.kind(at) == "line":
            at += 1
        return at

    def before(self, at: int) -> int:
        at -= 1
        while self.kind(at) == "line":
            at -= 1
        return at

    def close(self, at: int) -> int:
        """Behind the group that opens at ``at``, else behind the token."""
        return self.t.pair[at] if self.value(at) in _PAIRS and self.t.pair[at] > at else at

    def generic(self, at: int) -> int:
        """The last token of the ``<...>`` that opens at ``at``, or ``at - 1``."""
        depth, k = 0, at
        while k < len(self.t.values) and k < at + 200:
            v = self.value(k)
            depth += v == "<"
            depth -= v == ">"
            if v in "([{" and v:
                k = self.close(k)
            elif v == ";":
                return at - 1
            if depth == 0:
                return k
            k += 1
        return at - 1

    def scanned(self, scan: str, passed: list[int], result: int) -> int:
        self.known.update(((scan, k), result) for k in passed)
        return result

    def opening(self, at: int, stop: str = ";") -> int:
        """The ``{`` that a head from ``at`` on leads to, or -1 where ``stop`` or the end of its block comes first."""
        passed: list[int] = []
        while at < len(self.t.values):
            if (stop, at) in self.known:
                return self.scanned(stop, passed, self.known[stop, at])
            v = self.value(at)
            if v == "{":
                return self.scanned(stop, passed, at)
            if v == stop or v in (")", "]", "}"):
                return self.scanned(stop, passed, -1)
            passed.append(at)
            at = self.close(at) + 1 if v in ("(", "[") else at + 1
        return self.scanned(stop, passed, -1)

    def ending(self, at: int) -> int:
        """The ``;`` that ends a statement from ``at`` on, or the last token of its block."""
        passed: list[int] = []
        while at < len(self.t.values):
            if ("ending", at) in self.known:
                return self.scanned("ending", passed, self.known["ending", at])
            v = self.value(at)
            if v == ";":
                return self.scanned("ending", passed, at)
            if v in (")", "]", "}"):
                return self.scanned("ending", passed, at - 1)
            passed.append(at)
            at = self.close(at) + 1
        return self.scanned("ending", passed, len(self.t.values) - 1)

    def first(self, at: int) -> int:
        """The first token of the modifiers before ``at``."""
        while True:
            p = self.before(at)
            if self.value(p) in _MODIFIERS and self.kind(p) == "name" or self.language == "rust" and self.kind(p) == "string" and self.value(self.before(p)) == "extern":
                at = p
            elif self.value(p) == ")" and self.t.pair[p] >= 0 and self.value(self.before(self.t.pair[p])) == "pub":
                at = self.before(self.t.pair[p])
            else:
                return at

    def add(self, kind: str, name: str, start: int, stop: int, named: int, body: int = -1) -> None:
        self.found.append((kind, name, start, stop, named, body))
        self.heads.add(named)

    # --- bodies in braces ---------------------------------------------------------------------------------------------

    def braces(self) -> None:
        t, n = self.t, len(self.t.values)
        inside: list[tuple[int, str]] = []  # closing token and what the block belongs to
        bodies: dict[int, str] = {}
        rules = {"rust": self._rust, "go": self._go, "php": self._php, "zig": self._zig}.get(self.language, self._script if self.language in ("javascript", "typescript") else self._typed)
        for at in range(n):
            while inside and at > inside[-1][0]:
                inside.pop()
            v, kind = t.values[at], t.kinds[at]
            if v == "{" and t.pair[at] > at:
                where = bodies.get(at)
                if where is None:
                    before = self.before(at)
                    where = "top" if kind == "mark" and self.kind(before) == "string" and self.value(self.before(before)) == "extern" else "block"
                inside.append((t.pair[at], where))
                continue
            if kind not in ("name", "mark") or (kind == "mark" and v != "=>"):
                continue
            count = len(self.found)
            rules(at, inside[-1][1] if inside else "top")
            for what, _, _, _, _, body in self.found[count:]:
                if body >= 0:
                    bodies[body] = what

    def _block(self, kind: str, at: int, named: int, head: int, start: int | None = None) -> None:
        """A unit with a body in braces behind ``head``; without one there is no unit."""
        body = self.opening(head)
        if body >= 0:
            if self.language == "typescript" and self.value(self.after(self.close(body))) == "{":
                body = self.after(self.close(body))  # the first was the type of what comes back
            self.add(kind, self.value(named), self.first(at) if start is None else start, self.close(body), named, body)

    def _rust(self, at: int, where: str) -> None:
        v, named = self.value(at), self.after(at)
        if self.kind(named) != "name" and v != "impl":
            return
        if v == "fn":
            self.heads.add(named)
            self._block("function", at, named, named + 1)
        elif v in ("struct", "union"):
            body = self.opening(named + 1)
            self.add("struct", self.value(named), self.first(at), self.close(body) if body >= 0 else self.ending(named), named, body)
        elif v in ("enum", "trait"):
            self._block(v, at, named, named + 1)
        elif v == "mod":
            self._block("module", at, named, named + 1)
        elif v == "impl" and where in ("top", "module", "function", "block") and self.value(self.before(at)) not in ("->", ":", "(", "<", ",", "&", "="):
            body = self.opening(at + 1)
            if body >= 0:
                head = at + 1 if self.value(at + 1) != "<" else self.generic(at + 1) + 1
                names = [k for k in range(head, min(body, head + 200)) if self.kind(k) == "name"]
                of = next((k for k in names if self.value(self.before(k)) == "for"), names[0] if names else at)
                self.add("impl", self.value(of), self.first(at), self.close(body), of, body)
        elif v in ("const", "static") and self.value(named) not in ("fn", "unsafe", "extern", "async"):
            named = self.after(named) if self.value(named) == "mut" else named
            if self.value(self.after(named)) == ":":
                self.add("constant" if v == "const" else "variable", self.value(named), self.first(at), self.ending(named), named)
        elif v == "type":
            self.add("type", self.value(named), self.first(at), self.ending(named), named)

    def _go(self, at: int, where: str) -> None:
        v, named = self.value(at), self.after(at)
        if where == "struct" and self.value(at + 1) == "(":
            self.heads.add(at)
        elif v == "func":
            kind = "function"
            if self.value(named) == "(":
                kind, named = "method", self.after(self.close(named))
            if self.kind(named) == "name" and self.value(named + 1) in ("(", "["):
                head = named + 1
                while self.value(head) in ("(", "["):
                    head = self.close(head) + 1
                body = self.opening(head, stop="\n" if self.kind(head) == "line" else ";")
                if body >= 0:
                    self.add(kind, self.value(named), at, self.close(body), named, body)
        elif v == "type" and where in ("top", "block", "function", "method"):
            specs = [named]
            if self.value(named) == "(":
                k, specs = named + 1, []
                while k < self.t.pair[named]:
                    if self.kind(k) == "name" and self.kind(k - 1) in ("line", "mark") and self.value(k - 1) in ("\n", "(", ";"):
                        specs.append(k)
                    k = self.close(k) + 1
            for k in specs:
                if self.kind(k) == "name":
                    stop = k
                    while self.kind(stop + 1) not in ("line", "") and self.value(stop + 1) not in (";", ")"):
                        stop = self.close(stop + 1)
                    body = next((j for j in range(k, min(stop, k + 8) + 1) if self.value(j) == "{"), -1)
                    self.add("struct", self.value(k), at if k == named else k, stop, k, body)

    def _php(self, at: int, where: str) -> None:
        v, named = self.value(at).lower(), self.after(at)
        if self.value(self.before(at)) in ("->", "::"):
            return
        if v == "function":
            named = self.after(named) if self.value(named) == "&" else named
            if self.kind(named) == "name" and self.value(self.after(named)) == "(":
                self.heads.add(named)
                self._block("method" if where in ("class", "trait", "interface", "enum") else "function", at, named, named + 1)
        elif v in ("class", "interface", "trait", "enum") and self.kind(named) == "name":
            self._block(v, at, named, named + 1)

    def _zig(self, at: int, where: str) -> None:
        named = self.after(at)
        if self.value(at) == "fn" and self.kind(named) == "name":
            self._block("function", at, named, named + 1)
        elif self.value(at) in ("struct", "enum") and self.value(self.before(at)) == "=":
            name = self.before(self.before(at))
            self._block(self.value(at), self.before(name), name, at + 1)

    def _script(self, at: int, where: str) -> None:
        v, before = self.value(at), self.value(self.before(at))
        named = self.after(at)
        if before in (".", "?."):
            return
        if v == "=>":
            body = self.after(at)
            head = self.before(at)
            if self.language == "typescript" and self.value(head) not in (")",) and self.kind(head) == "name":
                back = head
                while back > 0 and back > head - 40 and self.value(back) not in (")", "(", "=", ",", ";", "{"):
                    back -= 1
                head = back if self.value(back) == ")" and self.value(back + 1) == ":" else head
            start = self.t.pair[head] if self.value(head) == ")" and self.t.pair[head] >= 0 else head
            start = self.before(start) if self.value(self.before(start)) == "async" else start
            stop = self.close(body) if self.value(body) == "{" else self._expression(body)
            self.found.append(("arrow", "", start, stop, -1, body if self.value(body) == "{" else -1))
        elif v == "function":
            named = self.after(named) if self.value(named) == "*" else named
            if self.kind(named) == "name" and before not in ("=", "(", ",", ":", "return", "!", "&&", "||", "?"):
                self._block("function", at, named, named + 1)
        elif v in ("class", "interface", "enum", "namespace") and self.kind(named) == "name" and (v != "namespace" or self.language == "typescript"):
            if v == "class" or self.language == "typescript":
                self._block({"namespace": "module"}.get(v, v), at, named, named + 1)
        elif v in ("const", "let", "var") and self.kind(at) == "name":
            k = named
            while self.kind(k) == "name":
                stop = self._expression(k)
                self.add("variable", self.value(k), k, stop, k)
                if self.value(self.after(stop)) != ",":
                    break
                k = self.after(self.after(stop))
        elif where == "interface" and self.value(self.after(at)) == "(":
            self.heads.add(at)
        elif where == "class" and self.kind(at) == "name" and v not in self.words and (self.kind(at - 1) == "line" or before in ("{", "}", ";", "*", "get", "set", "static", "async", "public", "private", "protected", "readonly", "abstract", "override", ")")):
            head = self.after(at) if self.value(self.after(at)) != "<" else self.after(self.generic(self.after(at)))
            if self.value(head) == "(" and (body := self.opening(self.close(head) + 1)) >= 0 and self.value(self.after(self.close(head))) in ("{", ":"):
                if self.value(self.after(self.close(body))) == "{":
                    body = self.after(self.close(body))
                start = self.before(at) if before == "*" else at
                self.add("method", v, self.first(start), self.close(body), at, body)

    def _expression(self, at: int) -> int:
        """The last token of the expression or declarator that begins at ``at``: up to a comma, a statement's end, or a line that doesn't go on."""
        last, passed = at, []
        while at < len(self.t.values):
            if ("expression", at) in self.known:
                return self.scanned("expression", passed, self.known["expression", at])
            v, kind = self.value(at), self.kind(at)
            if v in (",", ";", ")", "]", "}"):
                break
            if kind == "line":
                following = self.after(at)
                opens = self.kind(last) == "mark" and self.value(last) not in (")", "]", "}")
                goes_on = self.kind(following) == "mark" and self.value(following) not in ("{", "[", "(", "!", "}", ")", "]", "@", ";", ",")
                if not opens and not goes_on:
                    break
                at = following
                continue
            passed.append(at)
            at = self.close(at)
            last, at = at, at + 1
        return self.scanned("expression", passed, min(last, len(self.t.values) - 1))

    def _typed(self, at: int, where: str) -> None:
        """Java, C#, C and C++."""
        v, named, before = self.value(at), self.after(at), self.before(at)
        if self.value(before) in (".", "->", "?."):
            return
        if v in _TYPE_WORDS and v not in ("mod", "module", "trait"):
            if v == "namespace":
                while self.value(self.after(named)) in (".", "::") and self.kind(named) == "name":
                    named = self.after(self.after(named))
                body = self.opening(named if self.kind(named) == "name" else at + 1)
                name = "".join(self.text[self.t.starts[self.after(at)] : self.t.stops[named]].split()) if self.kind(named) == "name" else ""
                if body >= 0:
                    self.found.append(("module" if self.language == "csharp" else "namespace", name, at, self.close(body), named, body))
                elif self.language == "csharp" and self.value(self.after(named)) == ";":
                    self.found.append(("module", name, at, len(self.t.values) - 1, named, -1))
                self.heads.add(named)
                return
            named = self.after(named) if v == "enum" and self.value(named) in ("class", "struct") else named
            if v == "record" and self.value(named) in ("class", "struct"):
                named = self.after(named)
            if self.kind(named) != "name" or self.value(before) in ("<", ",") or v == "class" and self.value(before) == "enum" or v == "struct" and self.value(before) == "enum":
                return
            if v == "record" and self.value(self.after(named)) not in ("(", "{", "<", ":"):
                return
            head = self.after(named)
            if self.language in ("c", "cpp") and self.value(head) not in ("{", ":", "final"):
                return
            kind = {"record": "class", "union": "struct"}.get(v, v)
            self._block(kind, at, named, head)
            return
        if self.language in ("java", "csharp") and v == "@interface":
            self._block("interface", at, named, named + 1)
            return
        if self.kind(at) != "name" or v in self.words or self.value(before) == "," or self.value(before) == ":" and self.value(self.before(before)) not in ("public", "private", "protected", "slots", "signals"):
            return
        head = self.after(at)
        if self.value(head) == "<" and self.language in ("java", "csharp", "cpp"):
            head = self.after(self.generic(head))
        plain = where in ("top", "namespace", "module", "class", "struct", "interface", "enum")
        if not plain:
            return
        if self.language == "csharp" and where in ("class", "struct", "interface") and self._typelike(before) and self.value(head) in ("{", "=>"):
            first = self.value(self.after(head))
            if self.value(head) == "=>" or first in ("get", "set", "init", "private", "protected", "internal", "["):
                stop = self.close(head) if self.value(head) == "{" else self.ending(head)
                self.add("property", v, self._declaration(at), stop, at, head if self.value(head) == "{" else -1)
            return
        if self.value(head) != "(" or self.close(head) == head:
            return
        typed = self._typelike(before)
        qualified = self.value(before) == "::" or self.value(before) == "~"
        if not typed and not qualified and (where not in ("class", "struct", "enum") or self.value(before) not in ("{", "}", ";", ":", ")", *_MODIFIERS)):
            return
        behind = self.after(self.close(head))
        body = self._body(behind)
        bodiless = typed and body < 0 and self.value(self.ending(behind)) == ";" and where in ("class", "interface", "struct", "enum") and self.language in ("java", "csharp") and self.value(behind) in (";", "throws", "where", "=>")
        if body < 0 and not bodiless:
            return
        start = self._declaration(at)
        stop = self.close(body) if body >= 0 else self.ending(behind)
        if self.language in ("java", "csharp"):
            kind = "method" if typed else "constructor"
        else:
            kind, first = "function", at
            while self.value(self.before(first)) in ("::", "~"):
                first = self.before(first) if self.value(self.before(first)) == "~" else self.before(self.before(first))
            v = re.sub(r"\s+", "", self.text[self.t.starts[first] : self.t.stops[at]])
        self.add(kind, v, start, stop, at, body)

    def _typelike(self, at: int) -> bool:
        v = self.value(at)
        if self.kind(at) == "name":
            return v not in _NO_TYPE and v not in ("public", "private", "protected", "internal", "static", "virtual", "explicit", "inline", "override", "sealed", "abstract", "final", "extern")
        return v in (">", "]", "*", "&", "?", "&&")

    def _declaration(self, at: int) -> int:
        """The first token of the declaration whose name is ``at``: its type and modifiers."""
        first = at
        while True:
            k = self.before(first)
            v = self.value(k)
            if self.kind(k) == "name" and v not in _NO_TYPE and not v.startswith("@"):
                first = k
            elif v in ("*", "&", "::", "~", ".", "?", "&&"):
                first = k
            elif v in ("]", ">"):
                depth, j = 0, k
                while j >= 0 and k - j < 60:
                    depth += self.value(j) == v
                    depth -= self.value(j) == {"]": "[", ">": "<"}[v]
                    if depth == 0:
                        break
                    j -= 1
                if depth or self.value(self.before(j)) in ("", ";", "}", "{"):
                    return first
                first = j
            else:
                return first

    def _body(self, at: int) -> int:
        """The ``{`` of a function's body behind its parameters, or -1; behind ``:`` stand what members begin with."""
        scan, passed = "body", {"body": [], "listed": []}

        def end(result: int) -> int:
            for name, tokens in passed.items():
                self.scanned(name, tokens, result)
            return result

        while at < len(self.t.values):
            if (scan, at) in self.known:
                return end(self.known[scan, at])
            v = self.value(at)
            if v == "{":
                if not (scan == "listed" and self.language == "cpp" and self.kind(self.before(at)) == "name"):
                    return end(at)
            elif v in (";", "=", ")", "]", "}", "=>") or self.kind(at) in ("number", "string"):
                break
            elif scan == "listed" and v == "(":
                self.heads.add(self.before(at))  # what a member begins with is no call
            passed[scan].append(at)
            scan = "listed" if v == ":" else scan
            at = self.after(self.close(at))
        return end(-1)

    # --- bodies by indentation ----------------------------------------------------------------------------------------

    def indent(self) -> None:
        t = self.t
        open_: list[tuple[int, int]] = []  # indentation, place in `found`
        last, begins, depth_end = -1, True, -1
        for at in range(len(t.values)):
            if t.kinds[at] == "line":
                begins = begins or at > depth_end
                continue
            if begins:
                begins = False
                column = t.starts[at] - (self.text.rfind("\n", 0, t.starts[at]) + 1)
                while open_ and open_[-1][0] >= column:
                    self._shut(open_.pop()[1], last)
            if t.values[at] in _PAIRS and t.pair[at] > at and at > depth_end:
                depth_end = t.pair[at]
            v = t.values[at]
            if v in ("def", "class") and t.kinds[at] == "name" and t.kinds[at + 1 : at + 2] == ["name"] and self.value(at - 1) != "." and (at == 0 or t.kinds[at - 1] == "line" or self.value(at - 1) in ("async", ":", ";")):
                first = at - 1 if self.value(at - 1) == "async" else at
                column = t.starts[first] - (self.text.rfind("\n", 0, t.starts[first]) + 1)
                self.add("function" if v == "def" else "class", t.values[at + 1], first, len(t.values) - 1, at + 1)
                open_.append((column, len(self.found) - 1))
            last = at
        for _, k in open_:
            self._shut(k, last)

    def _shut(self, place: int, last: int) -> None:
        kind, name, first, _, named, body = self.found[place]
        self.found[place] = (kind, name, first, max(last, named), named, body)

    # --- bodies up to an end ------------------------------------------------------------------------------------------

    def ends(self) -> None:
        t = self.t
        open_: list[tuple[str, int]] = []  # the word that opens a block, place in `found` or -1
        ruby, waiting = self.language == "ruby", 0  # heads of loops whose `do` opens nothing more
        for at in range(len(t.values)):
            v, kind = t.values[at], t.kinds[at]
            if kind == "line":
                waiting = 0 if ruby else waiting
                continue
            before = self.value(at - 1)
            if kind != "name" or before in (".", "?.", "&.", ":") and not (before == ":" and self.value(at - 2) == ":") and ruby or before in (".", ":") and not ruby:
                continue
            fresh = at == 0 or t.kinds[at - 1] == "line" or before in (";", "=", "(", "{", "|", "then", "do", "else", "[", ",", "return", "&&", "||", "!", "<<", "=>", "private", "public", "protected")
            if v in ("end", "until") and (v == "end" or not ruby):
                if open_:
                    _, place = open_.pop()
                    if place >= 0:
                        self._shut(place, at)
            elif ruby and v in ("def", "class", "module") and fresh:
                named = at + 1
                while self.value(named + 1) in (".", "::", ":") and self.kind(named) == "name":
                    named += 2 if self.value(named + 1) != ":" else 3
                if self.kind(named) == "name":
                    k = named + 1
                    k = self.close(k) + 1 if self.value(k) == "(" else k
                    if v == "def" and self.value(k) == "=" and self.kind(named + 1) != "line":
                        while self.kind(k) not in ("line", ""):
                            k += 1
                        self.add("method", t.values[named], at, k - 1, named)
                        continue
                    self.add("method" if v == "def" else v, t.values[named], at, len(t.values) - 1, named)
                    open_.append((v, len(self.found) - 1))
                else:
                    open_.append((v, -1))
            elif ruby and v in ("begin", "case") or ruby and v in ("if", "unless", "while", "until", "for") and fresh:
                open_.append((v, -1))
                waiting = 1 if v in ("while", "until", "for") else waiting
            elif ruby and v == "do":
                if waiting:
                    waiting = 0
                else:
                    open_.append((v, -1))
            elif not ruby and v == "function":
                named = at + 1
                if self.kind(named) == "name":
                    while self.value(named + 1) in (".", ":") and self.kind(named + 2) == "name":
                        named += 2
                    first = at - 1 if before == "local" else at
                    name = self.text[t.starts[at + 1] : t.stops[named]]
                    self.add("function", name, first, len(t.values) - 1, named)
                    open_.append((v, len(self.found) - 1))
                else:
                    open_.append((v, -1))
            elif not ruby and v in ("if", "do", "repeat"):
                open_.append((v, -1))
        for _, k in open_:
            if k >= 0:
                self._shut(k, len(t.values) - 1)

    def sql(self) -> None:
        t = self.t
        kinds = {"function": "function", "procedure": "function", "trigger": "function", "table": "type", "view": "type", "index": "type"}
        for at in range(len(t.values)):
            if t.kinds[at] == "name" and t.values[at].lower() == "create" and self.value(self.before(at)) in ("", ";"):
                k = self.after(at)
                while self.value(k).lower() in ("or", "replace", "unique", "temp", "temporary", "materialized", "global", "local"):
                    k = self.after(k)
                kind = kinds.get(self.value(k).lower())
                named = self.after(k)
                while self.value(named).lower() in ("if", "not", "exists", "concurrently"):
                    named = self.after(named)
                while self.value(self.after(named)) == ".":
                    named = self.after(self.after(named))
                if kind and self.kind(named) in ("name", "string"):
                    self.add(kind, self.value(named).strip('"'), at, self.ending(named), named)

    def run(self) -> list[Unit]:
        {"braces": self.braces, "indent": self.indent, "end": self.ends, "sql": self.sql}[FAMILIES[self.language]]()
        t = self.t
        units: list[Unit] = []
        stack: list[int] = []
        for kind, name, first, last, named, _ in sorted(self.found, key=lambda x: (x[2], -x[3])):
            start, stop = t.starts[first], t.stops[max(first, min(last, len(t.stops) - 1))]
            while stack and units[stack[-1]].stop <= start:
                stack.pop()
            parent = stack[-1] if stack else -1
            shown = next((v for k in range(first, named) if (v := t.values[k]) in ("pub", "public", "private", "protected", "internal", "export")), None)
            if shown == "pub" and self.value(first + 1) == "(" and self.language == "rust":
                shown = self.text[start : t.stops[self.close(first + 1)]]
            units.append(Unit(kind, name, start, stop, parent, units[parent].depth + 1 if stack else 0, shown))
            stack.append(len(units) - 1)
        return units

    # --- calls --------------------------------------------------------------------------------------------------------

    def _chain(self, at: int) -> int:
        """The first token of the chain of names, groups and signs that ends with the name at ``at``."""
        back = self._receiver(at)
        self.chains[at] = at if back < 0 else self.chains.get(back, back)
        return self.chains[at]

    def _receiver(self, at: int) -> int:
        """The last name of what stands before the sign before ``at``, or the first token of a group there; -1 for none."""
        signs = (".", "::", "->", "?.", ":") if self.language == "lua" else (".", "::", "->", "?.")
        sign = self.before(at)
        if self.value(sign) not in signs:
            return -1
        k = self.before(sign)
        if self.value(k) == ">" and self.value(sign) == "::":
            low = k - 100
            while k > max(0, low) and self.value(k) not in ("<", ";"):
                k -= 1
            k = self.before(k)
            k = self.before(k) if self.value(k) == "::" else k
        while True:
            v = self.value(k)
            if v in (")", "]") and self.t.pair[k] >= 0:
                group = self.t.pair[k]
                k = self.before(group)
                if not (self.kind(k) == "name" and self.value(k) not in self.words or self.value(k) in (")", "]", "?", "!")):
                    return group
            elif self.kind(k) == "mark" and v in ("?", "!"):
                k = self.before(k)
            else:
                break
        if self.kind(k) not in ("name", "string", "number"):
            return -1
        if k not in self.chains:
            self._chain(k) if self._receiver_is_close(k) else None
        return k

    def _receiver_is_close(self, at: int) -> bool:
        """True where the name at ``at`` has a receiver of its own that isn't known yet: one step, as calls come in order."""
        return self.value(self.before(at)) in (".", "::", "->", "?.", ":")

    def calls(self, units: list[Unit]) -> list[Call]:
        t, out = self.t, []
        bare = self.language in ("java", "ruby", "php")
        typed = self.language in ("java", "csharp", "c", "cpp")
        functions = [u for u in units if u.kind in ("function", "method", "constructor")]
        stack: list[Unit] = []
        nextf = 0
        for at in range(len(t.values)):
            if t.kinds[at] != "name":
                continue
            first = self._chain(at)
            v, following = t.values[at], at + 1
            if at in self.heads or v in self.words and first == at and not (v == "super" and t.values[at + 1 : at + 2] == ["("]):
                continue
            generic = at
            if self.value(following) == "<" and (self.language in ("java", "csharp", "cpp", "typescript")) or self.language == "rust" and self.value(following) == "::" and self.value(following + 1) == "<":
                generic = self.generic(following + (self.language == "rust"))
                following = generic + 1 if generic > at else following
            while typed and self.kind(following) == "line":
                following += 1
            opened = self.value(following) == "("
            if self.language == "lua" and self.kind(following) == "string" and self.kind(at) == "name" and v not in ("return", "local", "in", "and", "or", "not"):
                opened = True
            sent = self.language == "ruby" and (self.value(at - 1) in (".", "&.") or self.value(at - 2) == "&" and self.value(at - 1) == ".")
            if self.language == "ruby" and not opened and not sent:
                command = (at == 0 or t.kinds[at - 1] == "line") and (self.kind(following) == "string" or self.kind(following) == "name" and self.value(following) not in self.words or self.value(following) == ":" and t.starts[following] > t.stops[at])
                if not command or v[0] in "@$":
                    continue
            elif not opened and not sent:
                continue
            p = self.before(first)
            long_ = t.stops[at] - t.starts[first] > LONGEST
            text = v if first == at else re.sub(r"\s+", "", self.text[t.starts[first] : t.stops[at]]) if not long_ else "..." + self.value(self.before(at)) + v
            made = self.value(p) == "new" and self.language in ("javascript", "typescript", "java", "csharp", "cpp", "php")
            called = made and any(self.value(k) == "(" for k in range(first, at if not long_ else first + 1))
            if made and called:
                text, first, p = "new " + text, p, self.before(p)
            if made and not called and self.language in ("javascript", "typescript", "java", "csharp", "cpp", "php"):
                kind, callee, first = "constructor", text, p
            else:
                # A name before the name: what follows is declared, not called.
                if typed and self.kind(p) == "name" and self.value(p) not in _BEFORE_CALL:
                    continue
                if typed and self.value(p) in ("*", "&", ">") and first == at and not any(u.start <= t.starts[at] < u.stop for u in stack) and self.language in ("c", "cpp"):
                    continue
                receiver = self.value(self.before(at)) in (".", "::", "->", "?.", "&.", ":") and first != at or sent
                sign = self.value(self.before(at)) if receiver else ""
                if self.language == "rust":
                    kind = "static" if "::" in text else "method" if receiver else "direct"
                elif self.language == "php":
                    kind = "static" if sign == "::" else "method" if receiver else "direct"
                elif self.language == "c":
                    kind = "method" if "->" in text else "direct"
                elif self.language == "cpp":
                    kind = "method" if "->" in text or "." in text else "static" if "::" in text else "direct"
                elif self.language == "lua":
                    kind = "method" if receiver else "direct"
                else:
                    kind = "method" if receiver else "direct"
                callee = v if bare else text
            place = t.starts[first]
            while nextf < len(functions) and functions[nextf].start <= place:
                while stack and stack[-1].stop <= functions[nextf].start:
                    stack.pop()
                stack.append(functions[nextf])
                nextf += 1
            while stack and stack[-1].stop <= place:
                stack.pop()
            out.append(Call(callee, kind, place, stack[-1].name if stack else None))
        return out


def parse(text: str, language: str) -> tuple[list[Unit], list[Call]]:
    """The declarations of ``text``, outer ones before inner ones, and its calls; none for languages without rules."""
    if language not in FAMILIES or not text:
        return [], []
    finder = _Finder(text, language)
    units = finder.run()
    return units, finder.calls(units) if language != "sql" else []


def symbols(units: list[Unit]) -> list[tuple[Unit, str | None]]:
    """The units that are symbols, with their qualified names: behind the name of the innermost class, struct, trait or module around them."""
    around: list[str | None] = []
    out = []
    for u in units:
        outer = around[u.parent] if u.parent >= 0 else None
        named = u.kind not in ("arrow", "impl", "constructor", "namespace")
        around.append(u.name if u.kind in QUALIFYING else outer)
        if named:
            out.append((replace(u, kind={"property": "variable"}.get(u.kind, u.kind)), f"{outer}::{u.name}" if outer else None))
    return out


# Most tokens of one chunk, by language.
LIMITS = {
    200: ["python", "javascript", "ruby", "lua", "scheme", "php"],
    300: ["rust", "c", "cpp", "java", "csharp", "go", "zig", "typescript", "json", "yaml", "toml", "bash"],
    400: ["markdown", "text", "html", "xml", "css", "sql"],
}
_KINDS = {"function": "function", "method": "function", "arrow": "function", "class": "class", "interface": "class", "impl": "module", "module": "module", "struct": "type", "enum": "type", "constant": "code", "variable": "code", "type": "code", "trait": "module"}


def token_limit(language: str) -> int:
    return next((n for n, languages in LIMITS.items() if language in languages), 512)


def line_numbers(text: str) -> list[int]:
    """Where the lines of ``text`` begin."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_of(starts: list[int], at: int) -> int:
    return bisect.bisect_right(starts, at)


_WORD = re.compile(r"\w+|[^\w\s]")


def _cut(text: str, start: int, stop: int, limit: int) -> list[tuple[int, int]]:
    """Parts of at most ``limit`` tokens, each repeating a tenth (at least 16) of the one before."""
    spans = [m.span() for m in _WORD.finditer(text, start, stop)]
    if len(spans) <= limit:
        return [(start, stop)]
    overlap = max(16, limit // 10)
    out, at = [], 0
    while True:
        last = min(len(spans), at + limit)
        out.append((spans[at][0], spans[last - 1][1]))
        if last == len(spans):
            return out
        at = last - overlap


def chunks(text: str, language: str, least_gap: int = 20) -> list[tuple[str, str, int, int, int, int]]:
    """(type, name, level, parent's place or -1, start, stop) of the pieces of ``text``.

    Units that hold others (classes, modules, types) are followed by those; what stands between the outermost units is a
    piece where it has more than ``least_gap`` characters; what has too many tokens for the language is cut, the later
    parts below the first. A text without units is cut by tokens alone.
    """
    limit = token_limit(language)
    units, _ = parse(text, language)
    taken: dict[int, int] = {}
    out: list[tuple[str, str, int, int, int, int]] = []
    spans: list[tuple[int, int]] = []

    def put(kind: str, name: str, level: int, parent: int, start: int, stop: int) -> int:
        first = len(out)
        for k, (a, b) in enumerate(_cut(text, start, stop, limit)):
            out.append((kind, name, level, parent if k == 0 else first, a, b))
        return first

    for place, u in enumerate(units):
        kind = _KINDS.get(u.kind)
        holder = u.parent
        while holder >= 0 and units[holder].kind == "namespace":
            holder = units[holder].parent
        if kind is None or kind == "code" and holder >= 0 or holder >= 0 and holder not in taken:
            continue
        taken[place] = put(kind, u.name, 2 if kind == "function" and holder >= 0 else 1, taken[holder] if holder >= 0 else -1, u.start, u.stop)
        if kind in ("function", "code"):
            taken.pop(place)  # what is declared within a function is part of it
        if holder < 0:
            spans.append((u.start, u.stop))
    if not out:
        return [("text" if language in ("markdown", "text") else "code", "", 1, -1, a, b) for a, b in (_cut(text, 0, len(text), 512) if text.strip() else [])]
    at = 0
    for start, stop in [*spans, (len(text), len(text))]:
        gap = text[at:start]
        if start > at and len(gap.strip()) > least_gap:
            put("code", "", 1, -1, at + len(gap) - len(gap.lstrip()), at + len(gap.rstrip()))
        at = max(at, stop)
    return out
