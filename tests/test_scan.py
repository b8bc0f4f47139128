"""Spans, symbols, calls and imports against those worked out by hand, and the scanner's own rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.sources import chunks, extract, golang, scan

GO = '''// Package shelf keeps boxes.
package shelf

import (
	"fmt"
	str "strings"
	. "math" // dot
	_ "embed"
)

import `os`

// Shelf holds { boxes.
// And nothing else.
type Shelf struct {
	boxes map[string]*Box // } no end
	pick  func(int) (string, error)
}

type (
	// Height is in rows.
	Height int
	Shelves = []Shelf
)

/* Take finds a box. */
func (s *Shelf) Take(label string, opts ...func(*Box)) (*Box, error) {
	if b, ok := s.boxes[label]; ok && fits(b) {
		return b, nil
	}
	for _, x := range sorted(s.boxes) {
		go move(Box{Label: "a{b"}, func(y int) bool { return deep(y) })
	}
	switch t := kindOf(label).(type) {
	case string:
		store.Put(
			[]Thing{{1}, {2}},
			map[string]Foo{"a": Foo{}},
		)
	}
	a := b.Open(x).
		Shut(y)
	if x == (Mark{}) { note() }
	if x == Mark { other() }
	gen[int](3)
	for i := range [...]Row{} { use(i) }
	return nil, fmt.Errorf("no %s (", label)
}

func Keys[K comparable, V any](m map[K]V) []K { return list(m) }

var handlers = map[string]func(){
	"a": func() { begin() },
}
'''


def test_go_by_hand():
    go = golang.read(GO)
    assert go.imports == [("fmt", "", 5), ("strings", "str", 6), ("math", ".", 7), ("embed", "_", 8), ("os", "", 11)]
    assert [(n, k, line) for n, k, _, line, _ in go.symbols] == [("Shelf", "type", 15), ("Height", "type", 22), ("Shelves", "type", 23), ("Take", "method", 27), ("Keys", "function", 50)]
    assert go.symbols[0][4] == "Shelf holds { boxes.\nAnd nothing else." and go.symbols[1][4] == "Height is in rows." and go.symbols[3][4] == "Take finds a box."
    assert go.symbols[3][2] == "func (s *Shelf) Take(label string, opts ...func(*Box)) (*Box, error)"
    want = {("fits", 28), ("sorted", 31), ("move", 32), ("Box", 32), ("deep", 32), ("kindOf", 34), ("Put", 36), ("Thing", 37), ("Foo", 38), ("Open", 41), ("Shut", 41), ("Mark", 43), ("note", 43), ("other", 44), ("Row", 46), ("use", 46), ("Errorf", 47), ("list", 50), ("begin", 53)}
    assert set(go.calls) == want


def test_line_patterns_would_be_wrong_where_the_grammar_is_right():
    text = 'package p\n\n/*\nfunc Ghost() {\n*/\nvar s = `\nfunc Fake() {\n`\n\nfunc (r R[T]) Real() {\n\t// call()\n\tx := "call2()"\n\tcall3(x)\n}\n'
    assert [s[:2] for s in extract.symbols("go", text)] == [("Real", "method")]
    assert [r[0] for r in extract.references("go", text)] == ["call3"]
    assert extract.imports("go", 'package p\nimport (\n\ta "x/y" // "no"\n\n\t"z"\n)\nvar q = "x"\n') == [("x/y", "a", 3, 'a "x/y" // "no"'), ("z", "", 5, '"z"')]


@pytest.mark.parametrize("broken", ["", "package", "package p\nfunc {", "package p\nfunc f( {\n", "package p\nx := 1\n", 'package p\nvar a = "open\n', "package p\nimport 3\n", "package p\nfunc f() { if x { }\n"])
def test_go_that_cannot_be_read(broken):
    assert golang.read(broken) is None
    extract.symbols("go", broken), extract.references("go", broken), extract.imports("go", broken)


SPANS = {
    "go": (GO, [(1, 2), (4, 9), (11, 11), (13, 18), (20, 24), (26, 48), (50, 50), (52, 54)]),
    "js": (
        "import { a } from './a';\nimport b from 'b'\n// class Ghost {\nconst re = /[}]{/g, t = `x ${f(`}`)} {`\n\nexport default class A extends B {\n  m() { return '}' }\n}\n@Mark({a: 1})\nclass C\n{\n}\n"
        "const f = async (x) => {\n  return x\n}\nexport const g = 1,\n  h = 2\nif (x) { y() } else { z() }\nfoo\n  .bar()\n  .baz()\n",
        [(1, 1), (2, 2), (4, 4), (6, 8), (9, 12), (13, 15), (16, 17), (18, 18), (19, 21)],
    ),
    "java": ('package a.b;\nimport java.util.*;\n/** class Ghost { */\n@Mark(x = "}")\npublic class Foo<T> {\n  char c = \'}\'; String s = """\n    } {\n  """;\n  void m() {}\n}\ninterface I { int f(); }\n', [(1, 1), (2, 2), (4, 10), (11, 11)]),
    "rs": (
        "use std::fmt;\n/* nested /* } */ { */\n#[derive(Debug)]\npub struct S<'a> { x: &'a str, c: char }\nimpl<'a> S<'a> {\n    fn f(&self) -> char { '}' }\n    fn g() { let r = r#\"} \" {\"#; }\n}\nmacro_rules! m { ($x:expr) => { $x }; }\nfn main() { println!(\"{}\", 'x'); }\nconst A: [i32; 2] = [1, 2];\n",
        [(1, 1), (3, 4), (5, 8), (9, 9), (10, 10), (11, 11)],
    ),
    "rb": ('require "x"\nclass A\n  def m(x)\n    return 1 if x\n    y = if x then 2 else 3 end\n    while x do\n      z\n    end\n    [1].each do |q|\n      q\n    end\n  end\nend\ndef top; 1; end\nFOO = 3\n', [(1, 1), (2, 13), (14, 14), (15, 15)]),
    "py": ('import a\n@dec\ndef f():\n    x = """\ndef g():\n"""\nclass A:\n    pass\nif x:\n    pass\nelse:\n    pass\ny = (1,\n2)\n', [(1, 1), (2, 6), (7, 8), (9, 12), (13, 14)]),
    "css": ("@import url(a.css);\n/* } */\na > b,\nc {\n  d: '}';\n}\n@media x {\n  e { f: g }\n}\n", [(1, 1), (3, 6), (7, 9)]),
}


@pytest.mark.parametrize("language", sorted(SPANS))
def test_spans_by_hand(language):
    text, want = SPANS[language]
    assert scan.spans(language, text) == want


@pytest.mark.parametrize("language", sorted(SPANS))
def test_chunks_are_whole_items_with_what_stands_before_them(language):
    text, want = SPANS[language]
    most = len(text.encode()) - 5
    got = chunks.chunks(language, text.encode(), most)
    assert len(got) > 1 and all(len(d) <= most for _, _, d in got) and b"".join(d for _, _, d in got) == text.encode()
    assert {b for _, b, _ in got} <= {b for _, b in want} | {text.count("\n")}


@pytest.mark.parametrize("language,text", [("js", "`a ${ b"), ("js", "f(]"), ("java", "/* open"), ("rs", 'r#" open'), ("go", "}"), ("c", '"open\n'), ("kt", "/* /* */")])
def test_what_does_not_close_is_unreadable(language, text):
    with pytest.raises(scan.Unreadable):
        scan.lex(language, text)
    assert chunks.spans(language, text.encode()) == []


def test_symbols_and_imports_of_other_languages():
    js = "class A extends B {\n  m(x) { return f(x) }\n  static async g() {}\n}\nfunction* h() {}\nconst s = 'class X {'\nif (a) {\n}\nconst k = x => x\n"
    assert [s[:2] for s in extract.symbols("js", js)] == [("A", "class"), ("m", "method"), ("g", "method"), ("h", "function"), ("k", "function")]
    assert [i[:3] for i in extract.imports("ts", 'import type { A } from "x";\nexport * from "./y"\nconst z = await import("./z")\nimport D, {\n  E,\n} from "m"\n')] == [("x", "A", 1), ("./y", "*", 2), ("./z", "", 3), ("m", "D, { E,", 4)]
    assert [i[:2] for i in extract.imports("rs", "pub use a::{b,\n c};\nextern crate z;\n// use no;\n")] == [("a::{b, c}", "")]
    assert [i[:2] for i in extract.imports("kt", "import a.b.C as D\n")] == [("a.b.C", "D")]
    assert [i[0] for i in extract.imports("css", "@import url(foo.css);\n@import 'b.css' screen;\n/* @import 'no' */")] == ["foo.css", "b.css"]
    assert [s[:2] for s in extract.symbols("rb", "module A::B\n def ok?; end\n # def no\nend\nx = 'def no'\n")] == [("A::B", "module"), ("ok?", "method")]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(scan.RULES)), st.lists(st.sampled_from(["{", "}", "(", ")", '"', "'", "`", "//", "/*", "*/", "\n", "\\", "func f", "class A", "${", "x", " ", "#", "=>", "r#", '"""', "end", "def m", "=", ";", "é", "package p\n"]), max_size=25))
def test_any_text_gives_tokens_that_are_in_it_or_is_unreadable(language, parts):
    text = "".join(parts)
    try:
        tokens = scan.lex(language, text)
        assert all(text[t.at : t.at + len(t.text)] == t.text and t.line == 1 + text.count("\n", 0, t.at) for t in tokens)
        found = scan.spans(language, text)
        assert all(1 <= a <= b <= text.count("\n") + 1 for a, b in found) and sorted(found) == found
    except scan.Unreadable:
        pass
    for t in scan.loose(language, text):
        assert text[t.at : t.at + len(t.text)] == t.text
    extract.symbols(language, text), extract.references(language, text), extract.imports(language, text)
