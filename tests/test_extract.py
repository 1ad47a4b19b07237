"""What files declare and refer to, where a lexer's state goes over lines and declarations share them."""

import pytest

from loomgraph.scratch import written
from loomgraph.sources import extract

SOURCES = {
    "comment.ts": """/* a block
function ghost() {
  boo()
*/
export function real() {
  go(`text ${x}
  function phantom() {
  }`)
}
const K = 1
class C {
  // } not an end
  run() { return help("}") }
  pattern = (s) => /["'{]/.test(s) || other(s)
}
const arrow = async (a, b) => {
  inner()
}
function multi(
  a: number,
  b: string,
): void {
  tail()
}
main()
""",
    "doc.py": '''"""Module.
class of things
def ghost(y):
"""
import os


class Real(Base, other.Mixin):
    """class inside: x
    def phantom(self):
        boo()
    """

    x = """
def gone():
    lost()
"""

    def run(self): return help(1)

    def go(self,
           a=(1,
              2)):
        self.run()
        def nested():
            deep()
        return [
            call(),
        ]

def last():
    pass
# comment ( {
top()
''',
    "Comment.java": """package a.b;
/* text
 class Ghost {
*/
public class C extends Base<Dep> implements Runnable, Comparable<C> {
    private final Dep dep = make(1), other;
    String text = \"\"\"
        class Phantom {
        \"\"\";
    @Override public void m(Dep d) { d.go(); }
    C(@Nullable Map<String, List<Dep>> map, int n, a.b.Far far, String... rest) {
        new Thing<>(n).run();
        char c = '{';
    }
    abstract <T> T pick(T[] from);
    enum Color { RED, GREEN; int code; }
    interface Inner { void call(Outer.Part p); }
    Runnable r = () -> { lambda(); };
    static { setup(); }
}
""",
    "group.go": """package main

import (
	"os"
)

const (
	A = 1
	B, C = 2, 3
)

var x, y *Dep = nil, nil

type (
	Small struct {
		Base
		*pkg.Far
		name string
		dep  *Dep
		list []Dep
	}
	Shape interface {
		Area() float64
		Named
	}
	ID int
)

type Big struct{ Small }

func (s *Small) Run(ctx context.Context, a, b *Thing, xs ...int) (*Result, error) {
	var v Local
	w := &Made{A: 1, B: call(2)}
	if t, ok := v.(*Cast); ok {
		t.Go()
	}
	f := func(q Quiet) { q.Hush() }
	raw := `func ghost() {
	}`
	return nil, f
}

func one() Out { return build() }
""",
    "raw.rs": """/* mod ghost { */
pub fn real<'a>(x: &'a str) -> String {
    let s = r#"fn phantom() { "#;
    let t = "multi
    fn other() {";
    helper::go(s).then(t)
}
#[derive(Debug)]
pub struct S;
impl<T: Clone> Shape for Holder<T> {
    #[inline]
    fn area(&self) -> f64 { self.calc() }
}
mod inner { pub fn deep() { x() } }
""",
}
LANGUAGES = {"ts": "typescript", "py": "python", "java": "java", "go": "go", "rs": "rust"}


@pytest.fixture(scope="module")
def extracted(spark):
    files = spark.createDataFrame([(p, LANGUAGES[p.split(".")[1]], t) for p, t in SOURCES.items()], "path string, language string, content string")
    rows = written(extract.statements(files), "statements")
    found = written(extract.symbols(rows), "symbols")
    return found.collect(), extract.references(rows, found).collect()


def symbols(extracted, path):
    return {(r.qualified_name, r.kind, r.start_line, r.end_line) for r in extracted[0] if r.path == path}


def refs(extracted, path, kind):
    return {(r.from_symbol, r.name) for r in extracted[1] if r.path == path and r.kind == kind}


def test_script(extracted):
    assert symbols(extracted, "comment.ts") == {
        ("real", "function", 5, 9), ("K", "constant", 10, 10), ("C", "class", 11, 15), ("C.run", "method", 13, 13), ("C.pattern", "method", 14, 14),
        ("arrow", "function", 16, 18), ("multi", "function", 19, 24),
    }
    assert refs(extracted, "comment.ts", "calls") == {("real", "go"), ("run", "help"), ("pattern", "test"), ("pattern", "other"), ("arrow", "inner"), ("multi", "tail"), (None, "main")}


def test_python(extracted):
    assert symbols(extracted, "doc.py") == {("Real", "class", 8, 29), ("Real.run", "method", 19, 19), ("Real.go", "method", 21, 29), ("last", "function", 31, 32)}
    assert refs(extracted, "doc.py", "calls") == {("run", "help"), ("go", "run"), ("go", "deep"), ("go", "call"), (None, "top")}
    assert refs(extracted, "doc.py", "extends") == {("Real", "Base"), ("Real", "other")}


def test_java(extracted):
    assert symbols(extracted, "Comment.java") == {
        ("C", "class", 5, 20), ("C.dep", "variable", 6, 6), ("C.other", "variable", 6, 6), ("C.text", "variable", 7, 9), ("C.m", "method", 10, 10), ("C.C", "method", 11, 14),
        ("C.pick", "method", 15, 15), ("C.Color", "enum", 16, 16), ("Color.code", "variable", 16, 16), ("C.Inner", "interface", 17, 17), ("Inner.call", "method", 17, 17), ("C.r", "variable", 18, 18),
    }
    assert refs(extracted, "Comment.java", "calls") == {("m", "go"), ("C", "Thing"), ("C", "run")}
    assert refs(extracted, "Comment.java", "extends") == {("C", "Base")}
    assert refs(extracted, "Comment.java", "implements") == {("C", "Runnable"), ("C", "Comparable")}
    assert refs(extracted, "Comment.java", "references") == {("C", "Dep"), ("C", "String"), ("m", "Dep"), ("C", "Map"), ("C", "Far"), ("pick", "T"), ("call", "Part"), ("C", "Runnable")}


def test_go(extracted):
    assert symbols(extracted, "group.go") == {
        ("A", "constant", 8, 8), ("B", "constant", 9, 9), ("C", "constant", 9, 9), ("x", "variable", 12, 12), ("y", "variable", 12, 12), ("Small", "struct", 15, 21), ("Shape", "interface", 22, 25),
        ("ID", "type", 26, 26), ("Big", "struct", 29, 29), ("Small.Run", "method", 31, 41), ("one", "function", 43, 43),
    }
    assert refs(extracted, "group.go", "calls") == {("Run", "call"), ("Run", "Go"), ("Run", "Hush"), ("one", "build")}
    assert refs(extracted, "group.go", "extends") == {("Small", "Base"), ("Small", "Far"), ("Shape", "Named"), ("Big", "Small")}
    assert refs(extracted, "group.go", "references") == {("Small", "string"), ("Small", "Dep"), ("Run", "Context"), ("Run", "Thing"), ("Run", "Local"), ("Run", "Made"), ("Run", "Cast"), ("Run", "Quiet"), ("one", "Out")}


def test_rust(extracted):
    assert symbols(extracted, "raw.rs") == {
        ("real", "function", 2, 7), ("S", "struct", 8, 9), ("Holder", "impl", 10, 13), ("Holder.area", "method", 11, 12), ("inner", "module", 14, 14), ("deep", "function", 14, 14),
    }
    assert refs(extracted, "raw.rs", "calls") == {("real", "helper"), ("area", "self"), ("deep", "x")} or refs(extracted, "raw.rs", "calls") == {("real", "helper"), ("deep", "x")}
    assert refs(extracted, "raw.rs", "implements") == {("Holder", "Shape")}
