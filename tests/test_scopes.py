import pytest

from sparkloom.operators import extraction, scopes

CASES = {
    "python": ('''class Base: pass
class A(Base, metaclass=Meta):
    """class Hidden:"""
    x: int = 1
    y: "str"
    # class Gone(Base):
    def run(
        self,
        k=(1, 2),
    ):
        def inner(): pass
        return "def fake():"
    class B(pkg.mod.Other[int]):
        z: dict[str, int]
def top(): pass
''', {("class", "Base", 1, ""): ([], []), ("class", "A", 2, ""): (["Base"], [("x", "int"), ("y", '"')]), ("function", "run", 7, "A"): ([], []), ("function", "inner", 11, "A.run"): ([], []), ("class", "B", 13, "A"): (["pkg.mod.Other"], [("z", "dict[str, int]")]), ("function", "top", 15, ""): ([], [])}),
    "rust": ('''/* struct Gone { /* */
struct S<'a> { pub name: &'a str, map: HashMap<String, Vec<u8>>, /* x: u8, */ f: fn(u8) -> u8 }
struct Unit;
trait T: Clone + Send { fn need(&self); fn have(&self) { let s = "struct Fake { a: u8 }"; } }
impl<'a> T for S<'a> { fn need(&self) { let c = '{'; let r = r#"fn "no() {"#; } }
mod inner { pub fn deep() {} } // fn comment() {}
''', {("struct", "S", 2, ""): ([], [("name", "&'a str"), ("map", "HashMap<String, Vec<u8>>"), ("f", "fn(u8) -> u8")]), ("struct", "Unit", 3, ""): ([], []), ("trait", "T", 4, ""): (["Clone", "Send"], []), ("function", "need", 4, "T"): ([], []), ("function", "have", 4, "T"): ([], []), ("impl", "S", 5, ""): (["T"], []), ("function", "need", 5, "S"): ([], []), ("module", "inner", 6, ""): ([], []), ("function", "deep", 6, "inner"): ([], [])}),
    "go": ('''package p
type Reader interface { Read(b []byte) int }
type S struct {
	*pkg.Base
	Inner
	Name string `json:"type Fake struct {"`
	M map[string]int // x int
}
func (s *S) Run() { if x { f("func no() {") } }
''', {("interface", "Reader", 2, ""): ([], []), ("struct", "S", 3, ""): (["pkg.Base", "Inner"], [("Name", 'string "'), ("M", "map[string]int")]), ("function", "Run", 9, ""): ([], [])}),
    "typescript": ('''export abstract class A<T> extends ns.Base<T> implements I, J<K, L> {
  private readonly id: number = 1;
  name?: string
  constructor(x: string) { super(); if (x) { this.name = `class Fake { ${x} }`; } }
  run(a: number): void { function inner() {} }
}
interface I extends P, Q { a: string; b(): void }
// class Gone {}
enum E { X, Y }
''', {("class", "A", 1, ""): (["ns.Base", "I", "J"], [("id", "number"), ("name", "string")]), ("method", "constructor", 4, "A"): ([], []), ("method", "run", 5, "A"): ([], []), ("function", "inner", 5, "A.run"): ([], []), ("interface", "I", 7, ""): (["P", "Q"], [("a", "string")]), ("enum", "E", 9, ""): ([], [])}),
    "java": ('''package x;
public class A<T> extends Base<T> implements Runnable, Comparable<A> {
  private final Map<String, Integer> m = new HashMap<>();
  int[] xs = {1, 2};
  /* class Gone {} */ String s = "class Fake { }";
  public void run() throws E { for (int i = 0; i < 3; i++) { call(); } return; }
  static class Inner { long id; }
}
interface I extends J, K { void f(); }
''', {("class", "A", 2, ""): (["Base", "Runnable", "Comparable"], [("m", "Map<String, Integer>"), ("xs", "int[]"), ("s", "String")]), ("method", "run", 6, "A"): ([], []), ("class", "Inner", 7, "A"): ([], [("id", "long")]), ("interface", "I", 9, ""): (["J", "K"], []), ("method", "f", 9, "I"): ([], [])}),
    "php": ('''<?php
class A extends \\N\\Base implements I, J { public ?string $name = 'class Fake {'; private int $n; public function run() { } } # class Gone {}
trait T { } interface I extends P { }
''', {("class", "A", 2, ""): (["N.Base", "I", "J"], [("name", "?string"), ("n", "int")]), ("function", "run", 2, "A"): ([], []), ("trait", "T", 3, ""): ([], []), ("interface", "I", 3, ""): (["P"], [])}),
    "ruby": ('''module M
  class A < Base::Thing
    include Comparable
    attr_reader :name, :size
    # class Gone
    def self.make; "class Fake"; end
    def ok?
    end
  end
end
''', {("module", "M", 1, ""): ([], []), ("class", "A", 2, "M"): (["Base::Thing", "Comparable"], [("name", ""), ("size", "")]), ("function", "make", 6, "M.A"): ([], []), ("function", "ok?", 7, "M.A"): ([], [])}),
}


@pytest.mark.parametrize("language", CASES)
def test_language(language):
    text, want = CASES[language]
    got = {d[:4]: d[4:] for d in scopes.scan(text, language)}
    assert got == want


@pytest.mark.parametrize("language", CASES)
def test_broken_off_texts(language):
    text = CASES[language][0]
    for k in range(len(text)):
        scopes.scan(text[:k], language)
    assert scopes.scan("", language) == [] and scopes.scan(None, language) == []
    scopes.scan("class x impl y fn type " * 50_000 + "{", language)
    scopes.scan("class A\n" + "f(\n" * 100_000, language)
    assert scopes.scan('"' + "\\n" * 300_000 + "{" * 2000, language) == []


def test_an_open_bracket_hides_nothing():
    assert [d[:3] for d in scopes.scan("x = (1,\n  2\nclass A(B):\n  pass\n", "python")] == [("class", "A", 3)]
    long = "".join(f"int x{i} = 0" + ",\n" for i in range(2000)) + " class Late extends B { }"
    assert [d[:3] for d in scopes.scan("class A { " + long + " }", "java")] == [("class", "A", 1), ("class", "Late", 2001)]


def test_edges_reach_the_graph(spark):
    rows = [("a/base.py", "class Base:\n  x: int\n", "python"), ("a/kid.py", "class Kid(Base):\n  pass\n# class Gone(Base):\n", "python"), ("s.rs", "trait T {}\nstruct S;\nimpl T for S {}\n", "rust"), ("n.py", None, "python"), ("x.txt", "class A", None)]
    files = spark.createDataFrame(rows, "path string, text string, language string")
    edges = {(r.source, r.target) for r in extraction.build_graph(files)[1].where("edge_type = 'Inherits'").collect()}
    assert edges == {("sym:a/kid.py:Kid", "sym:a/base.py:Base"), ("sym:s.rs:S", "sym:s.rs:T")}
    nodes = {r.id for r in extraction.build_graph(files)[0].collect()}
    assert "sym:a/kid.py:Kid" in nodes and not any("Gone" in n for n in nodes)
