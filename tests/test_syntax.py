"""The token-tree parser: fixtures by language, broken texts, and random programs whose structure is known."""

from __future__ import annotations

import ast
import random
import time

import pytest

from quarrylight.core import syntax
from quarrylight.operators import chunking

# text, {(kind, name, qualified, first line, last line)}, {(caller, callee, kind, line)}
FIXTURES = {
    "rust": (
        'use a::b;\npub(crate) async fn one<T: Into<String>>(x: &\'a str, y: T) -> Result<(), E> where T: Clone {\n    let s = "a } b"; let c = \'{\';\n    helper(x).map(|v| v.go(1)); Vec::<u8>::new(); println!("{}", two(3));\n}\nstruct Q(u8, u16);\n'
        "impl<T> Tr for P<T> {\n    pub fn m(&self) -> u8 { self.a.get() }\n}\ntrait Tr { fn n(&self) -> u8; fn d(&self) { self.m() } }\nmod inner { pub const K: u8 = 3; }\nfn broken( {\nfn after() { go() }\n",
        {("function", "one", None, 2, 5), ("struct", "Q", None, 6, 6), ("function", "m", None, 8, 8), ("trait", "Tr", None, 10, 10), ("function", "d", "Tr::d", 10, 10), ("module", "inner", None, 11, 11), ("constant", "K", "inner::K", 11, 11), ("function", "after", None, 13, 13)},
        {("one", "helper", "direct", 4), ("one", "helper(x).map", "method", 4), ("one", "v.go", "method", 4), ("one", "Vec::<u8>::new", "static", 4), ("one", "two", "direct", 4), ("m", "self.a.get", "method", 8), ("d", "self.m", "method", 10), ("after", "go", "direct", 13)},
    ),
    "python": (
        'class A(Base):\n    """def no(): pass"""\n    @deco(1)\n    def m(self, a=(1,\n2)):\n        return self.n(a).k()\n\n        def inner(): return 1\n    # comment\nasync def one(): return two()\n',
        {("class", "A", None, 1, 8), ("function", "m", "A::m", 4, 8), ("function", "inner", "A::inner", 8, 8), ("function", "one", None, 10, 10)},
        {(None, "deco", "direct", 3), ("m", "self.n", "method", 6), ("m", "self.n(a).k", "method", 6), ("one", "two", "direct", 10)},
    ),
    "javascript": (
        "export async function one(a, b = {c: 1}) { return two(a) }\nclass K extends L {\n  #p = 1\n  constructor(x) { super(x); this.go() }\n  static async m(a) { if (a) { new Foo(a).run() } }\n}\nconst add = (a, b) => { return mul(a, b) }, z = 3;\n",
        {("function", "one", None, 1, 1), ("class", "K", None, 2, 6), ("method", "constructor", "K::constructor", 4, 4), ("method", "m", "K::m", 5, 5), ("variable", "add", None, 7, 7), ("variable", "z", None, 7, 7)},
        {("one", "two", "direct", 1), ("constructor", "super", "direct", 4), ("constructor", "this.go", "method", 4), ("m", "Foo", "constructor", 5), ("m", "new Foo(a).run", "method", 5), (None, "mul", "direct", 7)},
    ),
    "typescript": (
        "export interface I { a(): void }\nexport class C<T> implements I {\n  public m<K>(a: K[], b?: {c: number}): { d: string } { return this.n(a) }\n}\nexport const f = async (a: number): Promise<void> => { await g<number>(a) }\n",
        {("interface", "I", None, 1, 1), ("class", "C", None, 2, 4), ("method", "m", "C::m", 3, 3), ("variable", "f", None, 5, 5)},
        {("m", "this.n", "method", 3), (None, "g", "direct", 5)},
    ),
    "go": (
        "package a\ntype T struct {\n\ta int\n}\ntype (\n\tU interface { M() }\n\tV = string\n)\nfunc (t *T) M(a []string) (int, error) {\n\tfmt.Println(helper(a))\n}\nfunc F[T any](a T) T { return a }\n",
        {("struct", "T", None, 2, 4), ("struct", "U", None, 6, 6), ("struct", "V", None, 7, 7), ("method", "M", None, 9, 11), ("function", "F", None, 12, 12)},
        {("M", "fmt.Println", "method", 10), ("M", "helper", "direct", 10)},
    ),
    "java": (
        "public class A<T> extends B {\n    private int x = init();\n    @Override\n    public static <K> List<String> m(Map<String, Integer> a) throws E { return new Foo<>(a).bar(b); }\n    A(int x) { go(); }\n    abstract int n();\n    enum E { P, Q; void k() {} }\n}\ninterface I { void z(); }\n",
        {("class", "A", None, 1, 8), ("method", "m", "A::m", 4, 4), ("method", "n", "A::n", 6, 6), ("enum", "E", "A::E", 7, 7), ("method", "k", "A::k", 7, 7), ("interface", "I", None, 9, 9), ("method", "z", None, 9, 9)},
        {(None, "init", "direct", 2), ("m", "Foo", "constructor", 4), ("m", "bar", "method", 4), ("A", "go", "direct", 5)},
    ),
    "csharp": (
        "namespace A.B {\npublic class C : D {\n    public int P { get; set; }\n    public string Q => name;\n    public async Task<int> M<T>(List<T> a) where T : class { await Go(a); return new Foo(1).Bar(); }\n    public C(int x) : base(x) { Init(); }\n}\n}",
        {("module", "A.B", None, 1, 8), ("class", "C", "A.B::C", 2, 7), ("variable", "P", "C::P", 3, 3), ("variable", "Q", "C::Q", 4, 4), ("method", "M", "C::M", 5, 5)},
        {("M", "Go", "direct", 5), ("M", "Foo", "constructor", 5), ("M", "new Foo(1).Bar", "method", 5), ("C", "Init", "direct", 6)},
    ),
    "c": (
        "#define X(a) { a\nstatic int add(const char *a, int b)\n{\n\treturn mul(a->f(b));\n}\nstruct S { int a; };\nint proto(int a);\nunsigned long *p(void) { if (x) { y(); } return 0; }\n",
        {("function", "add", None, 2, 5), ("struct", "S", None, 6, 6), ("function", "p", None, 8, 8)},
        {("add", "mul", "direct", 4), ("add", "a->f", "method", 4), ("p", "y", "direct", 8)},
    ),
    "cpp": (
        "namespace n {\nclass A : public B {\npublic:\n  A(int x) : B(x), y{1} { init(); }\n  ~A() {}\n  virtual int m() const override { return b.go(1) + std::max(1, 2); }\n  int proto();\n};\ntemplate <typename T> std::vector<T> A::f(T t) { auto p = new Foo(1); return p->run(); }\n}\n",
        {("class", "A", None, 2, 8), ("function", "A", "A::A", 4, 4), ("function", "~A", "A::~A", 5, 5), ("function", "m", "A::m", 6, 6), ("function", "A::f", None, 9, 9)},
        {("A", "init", "direct", 4), ("m", "b.go", "method", 6), ("m", "std::max", "static", 6), ("A::f", "Foo", "constructor", 9), ("A::f", "p->run", "method", 9)},
    ),
    "ruby": (
        "require 'x'\nmodule M\n  class A < B\n    def self.m(a)\n      return 1 if a.nil?\n      a.each do |e|\n        go(e)\n      end\n      while a do\n        b.c\n      end\n    end\n    def one = two(3)\n  end\nend\n",
        {("module", "M", None, 2, 15), ("class", "A", "M::A", 3, 14), ("method", "m", "A::m", 4, 12), ("method", "one", "A::one", 13, 13)},
        {(None, "require", "direct", 1), ("m", "nil?", "method", 5), ("m", "each", "method", 6), ("m", "go", "direct", 7), ("m", "c", "method", 10), ("one", "two", "direct", 13)},
    ),
    "lua": (
        "local function one(a)\n  if a then two(a) end\n  for i = 1, 3 do go(i) end\n  repeat x() until y()\nend\nfunction M:g() print \"x\" end\n",
        {("function", "one", None, 1, 5), ("function", "M:g", None, 6, 6)},
        {("one", "two", "direct", 2), ("one", "go", "direct", 3), ("one", "x", "direct", 4), ("one", "y", "direct", 4), ("M:g", "print", "direct", 6)},
    ),
    "php": (
        "<?php\nfunction one($a) { return two($a); }\nclass K extends L { public function m() { $this->x(1); self::y(); new Foo(2); } }\ninterface I { function q(); }\ntrait T { }\n",
        {("function", "one", None, 2, 2), ("class", "K", None, 3, 3), ("method", "m", "K::m", 3, 3), ("interface", "I", None, 4, 4), ("trait", "T", None, 5, 5)},
        {("one", "two", "direct", 2), ("m", "x", "method", 3), ("m", "y", "static", 3), ("m", "Foo", "constructor", 3)},
    ),
    "zig": ("pub fn main() !void { const x = try foo.bar(1); }\n", {("function", "main", None, 1, 1)}, {("main", "foo.bar", "method", 1)}),
    "sql": ("CREATE TABLE IF NOT EXISTS a.b (x int);\ncreate or replace function f(x int) returns int as $$ begin; select 1; end $$ language sql;\nselect 1;\n", {("type", "b", None, 1, 1), ("function", "f", None, 2, 2)}, set()),
}


@pytest.mark.parametrize("language", sorted(FIXTURES))
def test_fixtures(language):
    text, symbols, calls = FIXTURES[language]
    starts = syntax.line_numbers(text)
    units, found = syntax.parse(text, language)
    assert {(u.kind, u.name, q, syntax.line_of(starts, u.start), syntax.line_of(starts, u.stop - 1)) for u, q in syntax.symbols(units)} == symbols
    assert {(c.caller, c.callee, c.kind, syntax.line_of(starts, c.at)) for c in found} == calls


def test_visibility():
    units, _ = syntax.parse("pub fn a() {}\npub(crate) fn b() {}\nfn c() {}\n", "rust")
    assert [u.visibility for u in units] == ["pub", "pub(crate)", None]


@pytest.mark.parametrize("seed", range(8))
def test_python_equals_the_language_s_own_parser(seed):
    rng = random.Random(seed)

    def block(depth: int) -> list[str]:
        lines = []
        for _ in range(rng.randrange(1, 5)):
            what = rng.randrange(6 if depth < 4 else 3)
            if what == 0:
                lines += [f"x = f{rng.randrange(9)}(1, g({rng.randrange(9)}))"]
            elif what == 1:
                lines += ['"""text', '  def no(): pass', '"""', "", "# note"]
            elif what == 2:
                lines += ["y = [a.b(", "1),", "2]"]
            else:
                head = rng.choice([f"def n{rng.randrange(99)}(a, b={{1: 2}}):", f"class C{rng.randrange(99)}(B):", "if a:", f"async def n{rng.randrange(99)}():"])
                lines += [head] + ["    " + x if x and x not in ('  def no(): pass', '"""', "1),", "2]") else x for x in block(depth + 1)] + ["    pass"]
        return lines

    text = "\n".join(block(0)) + "\n"
    tree = ast.parse(text)
    expected = {(type(n).__name__ == "ClassDef", n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}
    starts = syntax.line_numbers(text)
    units, calls = syntax.parse(text, "python")
    assert {(u.kind == "class", u.name, syntax.line_of(starts, u.start), syntax.line_of(starts, u.stop - 1)) for u in units} == expected
    wanted = sorted((ast.unparse(n.func), n.lineno) for n in ast.walk(tree) if isinstance(n, ast.Call))
    assert sorted((c.callee, syntax.line_of(starts, c.at)) for c in calls) == wanted


@pytest.mark.parametrize("language", sorted(syntax.FAMILIES))
def test_broken_and_long_texts_take_linear_time(language):
    rng = random.Random(3)
    parts = ["{", "}", "(", ")", "[", "]", "fn a", "function b(", "class C ", "def d", "end", "if x ", "=> ", "let q = ", ":", ";", "\n", "new E(", "a.b", "::", "<", ">", '"', "'", "/*", "--[[", "impl ", "struct S", "type ("]
    text = "".join(rng.choice(parts) for _ in range(60_000))
    began = time.perf_counter()
    syntax.parse(text, language)
    for piece in ("f(x).", "class a ", "A() : b(1) ", "a => ", "{([", ")]}"):
        syntax.parse(piece * 20_000, language)
    assert time.perf_counter() - began < 30


def test_chunks_cover_the_text_and_keep_their_limits():
    text = "import a\nimport bbbbbbbbbbbbbbbbbbbb\n\nclass A:\n    def m(self):\n        return 1\n\n" + "def big():\n" + "".join(f"    x{i} = f({i})\n" for i in range(200)) + "\nz = [1, 2, 3, 4, 5, 6, 7, 8]\n"
    pieces = syntax.chunks(text, "python")
    assert [(p[0], p[1], p[2], p[3]) for p in pieces[:2]] == [("class", "A", 1, -1), ("function", "m", 2, 0)]
    big = [(k, p) for k, p in enumerate(pieces) if p[1] == "big"]
    assert len(big) > 5 and all(p[3] == (-1 if k == big[0][0] else big[0][0]) for k, p in big)
    assert all(len(syntax._WORD.findall(text[a:b])) <= 200 for *_, a, b in pieces)
    seen = set()
    for *_, a, b in pieces:
        seen |= set(range(a, b))
    assert all(c.isspace() for k, c in enumerate(text) if k not in seen)
    assert syntax.chunks("", "python") == [] and syntax.chunks("  \n", "text") == []
    assert [p[0] for p in syntax.chunks("word " * 600, "markdown")] == ["text", "text"]


def test_languages_by_path_nulls_and_repeats(spark):
    rows = [(1, None, "a/b.rs", "fn a() { b() }\r\nfn c() {}\r\n"), (2, "python", "x", None), (3, None, None, "x"), (4, "nolang", "y", "fn a() {}"), (5, "python", "e.py", ""), (1, None, "a/b.rs", "fn a() { b() }\r\nfn c() {}\r\n")]
    files = spark.createDataFrame(rows, "id long, language string, path string, content_text string").withColumnRenamed("x", "name")
    assert {(r.file_id, r.name, r.line_start) for r in chunking.declared_symbols(files).collect()} == {(1, "a", 1), (1, "c", 2)}
    assert [(r.caller, r.callee) for r in chunking.calls(files).distinct().collect()] == [("a", "b")]
    units = {(r.file_id, r.ordinal, r.chunk_type) for r in chunking.syntax_units(files).collect()}
    assert (1, 0, "function") in units and (4, 0, "code") in units and not any(u[0] in (2, 5) for u in units)


def test_functions_of_the_symbols_table_are_found(spark, data):
    files = spark.read.parquet(f"{data}/files.parquet")
    found = chunking.declared_symbols(files).selectExpr("file_id", "regexp_extract(name, '[^.:]+$', 0) AS name", "line_start", "line_end").distinct()
    known = files.where("language IS NOT NULL AND language <> 'text'").selectExpr("id AS file_id", "language AS said")
    told = spark.read.parquet(f"{data}/symbols.parquet").where("type IN ('function', 'method')").join(known, "file_id").where("language = said").selectExpr("file_id", "name", "CAST(line_start AS BIGINT) AS line_start", "CAST(line_end AS BIGINT) AS line_end").distinct()
    assert told.count() > 50 and told.join(found, ["file_id", "name", "line_start", "line_end"], "left_anti").count() == 0
