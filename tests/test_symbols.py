import pytest

from tests.conftest import rows
from weftmark.functions.symbols import extract
from weftmark.operators.symbols import extracted, language, symbols_of, variables_of


def found(source, lang):
    return [(s.label, s.signature) for s in extract(source, lang).symbols]


def test_python():
    src = "import os\nX: int = 1\nY = [\n 2]\nz += 1\nclass Foo(Base):\n    v = 1\n    @property\n    def bar(self):\n        return 'é'\n    class In:\n        def deep(self): pass\nasync def top(a,\n  b) -> int:\n    def inner(): pass\n    return 1\n"
    assert found(src, "python") == [
        ("Foo", "class Foo(Base):"), ("Foo.bar", "def bar(self):"), ("In", "class In:"), ("In.deep", "def deep(self):"),
        ("top", "async def top(a,\n  b) -> int:"), ("inner", "def inner():"),
    ]
    got = extract(src, "python")
    assert got.variables == ["X: int = 1", "Y = [\n 2]"] and got.error is None
    assert [s.code for s in got.symbols if s.name == "bar"] == ["@property\n    def bar(self):\n        return 'é'"]


def test_broken_python_falls_back_to_lines():
    got = extract("class A:\n    def m(self):\n        return (\n\ndef f(x):\n    pass\nV = 1\n", "python")
    assert got.error and [s.label for s in got.symbols] == ["A", "A.m", "f"] and got.variables == ["V = 1"]


@pytest.mark.parametrize("source", ["", "   ", "{", "}", "class", "function", "export", "(((", "`${", "/*", "'\n'", "const {", "class A {", "@", "a.", "\x00"])
def test_scripts_never_fail(source):
    extract(source, "typescript")
    extract(source, "python")


def test_typescript():
    src = """import x from 'y';
export const a = 1, b = { c: () => 2 };
const fn = (q: string) => { return q; };
export interface User<T> { id: number }
export enum Color { Red }
type UserID = string
export default class Foo<T> extends Bar<{a: 1}> {
  private count = 0;
  constructor(private a: string) { super(); }
  async load<T>(x: T): Promise<{ok: boolean}> { if (x) { go(x); } return /a}b/.test(x); }
  get value() { return 1 }
  #hidden() {}
}
async function main(o = {b: 1}): Promise<void> { function inner() {} }
app.listen(3000);
setup();
describe('x', () => {});
"""
    assert found(src, "typescript") == [
        ("Foo", "class Foo<T> extends Bar<{a: 1}>"), ("Foo.constructor", "constructor(private a: string)"),
        ("Foo.load", "async load<T>(x: T): Promise<{ok: boolean}>"), ("Foo.value", "get value()"),
        ("main", "async function main(o = {b: 1}): Promise<void>"), ("inner", "function inner()"),
        ("User", "interface User<T>"), ("Color", "enum Color"), ("UserID", "type UserID = string"), ("app", "app.listen(3000);"), ("setup", "setup();"),
    ]
    assert extract(src, "typescript").variables == ["export const a = 1, b = { c: () => 2 };", "const fn = (q: string) => { return q; };"]


def test_rows(spark):
    f = spark.createDataFrame(
        [("a.py", bytearray(b"class A:\n    def x(self): pass\nclass B:\n    def x(self): pass\nV = 1\nW = 2\n")), ("b.txt", bytearray(b"x")), ("c.py", None), ("d.TSX", bytearray(b"function \xff() {}"))],
        "file_path string, content binary",
    )
    got = extracted(f)
    assert rows(symbols_of(got).where("name = 'x'"), "id", "qualified_id") == [("a.py::x", "a.py::A.x"), ("a.py::x", "a.py::B.x")]
    assert rows(variables_of(got)) == [("a.py", ["V = 1", "W = 2"])]
    assert (language("X.Py"), language("a/b.JSX"), language("Makefile"), language("a.d/b")) == ("python", "javascript", None, None)


def test_lines_end_at_cr_and_lf_only():
    for odd in ("\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029"):
        source = f"import os\nx = 'a{odd}b'\n" + ("\x0c\n" if odd == "\x0c" else "") + "def first(a):\n    return a\r\nclass C:\r\n    def m(self):\r\n        pass\n"
        found = {s.label: s for s in extract(source, "python").symbols}
        assert found["first"].signature == "def first(a):" and found["first"].code == "def first(a):\n    return a"
        assert found["C.m"].signature == "def m(self):"
        broken = {s.label: s for s in extract(source + "def (:\n", "python").symbols}
        assert broken["first"].signature == "def first(a):"
