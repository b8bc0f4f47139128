"""Symbols, references, imports and cards of source files.

Python and Go are read by their grammars; of other languages declarations, calls and imports are
found among the tokens, so what strings and comments hold is none.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import is_config_path
from ..functions.fixed import CARD_WEIGHTS
from . import golang, scan

#: What a declaration's keyword makes of the name after it, by language.
KINDS = {
    "go": {"func": "function", "type": "type"},
    "rb": {"class": "class", "module": "module", "def": "method"},
    "js": {"class": "class", "interface": "interface", "function": "function"},
    "java": {"class": "class", "interface": "interface", "record": "class"},
    "rs": {"fn": "function", "struct": "type", "enum": "type", "trait": "type"},
    "php": {"class": "class", "function": "function"},
    "swift": {"class": "type", "struct": "type", "enum": "type", "protocol": "type", "func": "function"},
    "kt": {"class": "type", "interface": "type", "object": "type", "fun": "function"},
    "py": {"class": "class", "def": "function"},
}
KINDS |= {k: KINDS["js"] for k in ("jsx", "ts", "tsx")} | {"cs": KINDS["java"], "scala": KINDS["kt"] | {"def": "function", "trait": "type"}}
#: Languages whose methods have no keyword: a name, parameters and a body.
_BARE = {"js", "jsx", "ts", "tsx", "java", "cs"}
_NOT_NAMES = {"if", "for", "while", "switch", "return", "catch", "else", "new", "do", "with", "function", "super", "throw", "await", "typeof", "async", "fn", "fun", "import", "require", "require_once", "include", "include_once", "url", "sizeof"}
_CALL = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", re.ASCII)
#: Names that say nothing about what is called.
COMMON = set("append array assert bool boolean cap copy delete dict error format int len list log make object open panic print printf println set str string super tuple def class func function".split()) | _NOT_NAMES


def symbols(language: str, text: str) -> list[tuple[str, str, str, int, str]]:
    """(name, kind, signature, line, docstring)."""
    if language == "py" and (found := _python_symbols(text)) is not None:
        return found
    if language == "go" and (go := golang.read(text)):
        return go.symbols
    if language not in KINDS:
        return []
    lines, out, seen = text.split("\n"), [], set()
    for name, kind, line in _declared(language, scan.code(language, text)):
        if (name, line) in seen:
            continue
        seen.add((name, line))
        above, j = [], line - 2
        while j >= 0 and re.match(r"\s*(//|#|\*|/\*)", lines[j]):
            above.insert(0, lines[j].strip(" \t/*#"))
            j -= 1
        out.append((name, kind, lines[line - 1].strip().rstrip("{ "), line, " ".join(filter(None, above))))
    return out


def _declared(language: str, code: list[scan.Token]) -> Iterator[tuple[str, str, int]]:
    """(name, kind, line) of what tokens declare."""
    kinds, end = KINDS[language], scan.Token("end", "", 0, 0)
    at = lambda k: code[k] if 0 <= k < len(code) else end
    for k, t in enumerate(code):
        if t.kind != "word" or at(k - 1).text in (".", "::", "import"):
            continue
        if t.text in kinds and at(k + 1).text not in kinds:
            kind, j = kinds[t.text], k + 1
            if language == "go" and at(j).text == "(":  # a receiver
                kind, j = "method", _closing(code, j) + 1
            j += at(j).text == "*"
            while at(j + 1).text in (".", "::") and at(j + 2).kind == "word" and t.text not in ("class", "module"):
                j += 2
            if at(j).kind == "word" and at(j).text not in ("extends", "implements"):
                last = j
                while at(last + 1).text == "::" and at(last + 2).kind == "word":
                    last += 2
                name = "".join(x.text for x in code[j : last + 1])
                if language == "rb" and at(last + 1).text in ("?", "!", "=") and at(last + 1).at == at(last).at + len(at(last).text) and kind == "method":
                    name += at(last + 1).text
                yield name, kind, t.line
        elif language in _BARE and t.text in ("const", "let", "var") and at(k + 1).kind == "word":
            j = k + 2
            while j < len(code) and at(j).text not in ("=", ";") and at(j).line == t.line:
                j += 1
            if at(j).text == "=":
                j += 1 + (at(j + 1).text == "async")
                end_of = _closing(code, j) if at(j).text == "(" else j
                if at(j).text == "function" or at(end_of + 1).text in ("=>", ":") and (at(j).text == "(" or at(j).kind == "word"):
                    yield at(k + 1).text, "function", t.line
        elif language in _BARE and at(k + 1).text == "(" and t.text not in _NOT_NAMES:
            before, after = at(k - 1), at(_closing(code, k + 1) + 1)
            typed = before.kind == "word" and before.text not in _NOT_NAMES or before.text in (">", "]", "?")
            if language in ("java", "cs"):
                if typed and after.text in ("{", "throws", "where", "=>", "", ":"):
                    yield t.text, "method", t.line
            elif (before.text in ("{", "}", ";", "", "*") or before.line < t.line or before.text in ("static", "async", "get", "set", "public", "private", "protected")) and (after.text == "{" or after.text == ":"):
                yield t.text, "method", t.line


def _closing(code: list[scan.Token], k: int) -> int:
    """Where the bracket at k is closed; the last token, if nowhere."""
    depth = 0
    for j in range(k, len(code)):
        depth += (code[j].kind == "open") - (code[j].kind == "close")
        if depth <= 0:
            return j
    return len(code)


def _python_symbols(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines, out = text.split("\n"), []

    def walk(node, scope: tuple[str, ...], in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                head = lines[n.lineno - 1].strip().rstrip(":")
                out.append((n.name, kind, f"{'.'.join(scope)}: {head}" if scope else head, n.lineno, (ast.get_docstring(n) or "").split("\n")[0]))
                walk(n, (*scope, n.name), is_class)
            elif not isinstance(n, ast.expr):
                walk(n, scope, in_class)

    walk(tree, (), False)
    return sorted(out, key=lambda s: s[3])


def references(language: str, text: str) -> list[tuple[str, int, str]]:
    """(name, line, context), each name once a line, without the line's own definition and common names."""
    own, lines = {(s[3], s[0]) for s in symbols(language, text)}, text.split("\n")
    if language == "go" and (go := golang.read(text)):
        called = go.calls
    elif language in scan.RULES:
        code = scan.code(language, text)
        called = [(a.text, a.line) for a, b in zip(code, code[1:]) if a.kind == "word" and b.text == "("]
    else:
        called = [(name, k) for k, line in enumerate(lines, 1) for name in _CALL.findall(line)]
    found = dict.fromkeys((name, k) for name, k in called if (k, name) not in own and name.lower() not in COMMON)
    return [(name, k, lines[k - 1].strip()[:200]) for name, k in sorted(found, key=lambda x: x[1])]


def imports(language: str, text: str) -> list[tuple[str, str, int, str]]:
    """(import path, alias, line, context)."""
    lines = text.split("\n")
    if language == "py":
        found = _python_imports(text)
    elif language in ("html", "vue", "svelte", "astro"):
        found = _tags(text)
    elif language == "go" and (go := golang.read(text)):
        found = go.imports
    elif language in _STATEMENTS:
        found = _STATEMENTS[language](scan.code(language, text), text)
    else:
        found = []
    return [(path, alias, k, lines[k - 1].strip() if k <= len(lines) else "") for path, alias, k in found]


def _python_imports(text: str) -> Iterator[tuple[str, str, int]]:
    for k, line in enumerate(text.split("\n"), 1):
        words = line.replace("\t", " ").split("#")[0].strip()
        if words.startswith("from ") and " import " in words:
            module, _, names = words[5:].partition(" import ")
            if module.strip() and re.fullmatch(r"\.*[\w.]*", module.strip()):
                yield module.strip(), names.strip(" ()\\"), k
        elif words.startswith("import "):
            for part in words[7:].split(","):
                name, _, alias = part.strip().partition(" as ")
                if re.fullmatch(r"[\w.]+", name):
                    yield name, alias.strip(), k


class _Tags(HTMLParser):
    """Addresses that a page loads, by tag and attribute."""

    LOADS = {"script": "src", "img": "src", "source": "src", "iframe": "src", "link": "href"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, int]] = []

    def handle_starttag(self, tag: str, attributes) -> None:
        value = dict(attributes).get(self.LOADS.get(tag))
        if value:
            self.found.append((value, "", self.getpos()[0]))


def _tags(text: str) -> list[tuple[str, str, int]]:
    p = _Tags()
    try:
        p.feed(text)
        p.close()
    except AssertionError:  # of the parser, on declarations that are none
        pass
    return p.found


def _bare(t: scan.Token) -> str:
    return t.text.strip("\"'`")


def _js_imports(code: list[scan.Token], text: str) -> Iterator[tuple[str, str, int]]:
    """import … from "x"; import "x"; import("x"); export … from "x"; require("x")."""
    for k, t in enumerate(code):
        before = code[k - 1].text if k else ""
        if t.text in ("import", "export") and before != ".":
            for j in range(k + 1, min(len(code), k + 200)):
                if code[j].kind == "string" and (code[j - 1].text == "from" or j == k + 1 and t.text == "import"):
                    clause = text[code[k + 1].at : code[j - 1].at] if j > k + 1 else ""
                    yield _bare(code[j]), " ".join(clause.split()).removeprefix("type ").strip(" {}"), t.line
                    break
                if code[j].text in (";", "=", "(") or code[j].kind == "string":
                    break
        if t.text in ("require", "import") and before != "." and k + 2 < len(code) and code[k + 1].text == "(" and code[k + 2].kind == "string":
            j = k - 1
            while j > 0 and code[j].line == t.line and code[j].text not in ("const", "let", "var"):
                j -= 1
            bound = text[code[j + 1].at : code[k - 1].at] if before == "=" and code[j].text in ("const", "let", "var") else ""
            yield _bare(code[k + 2]), bound.strip(" {}"), t.line


def _statements(*words: str, to: str = ";", skip: tuple[str, ...] = (), strings: tuple[str, ...] = ()):
    """Statements that begin with one of the words, up to `to`, where the language has it, or the end of the line; after those of `strings` a
    string is loaded."""

    def read(code: list[scan.Token], text: str) -> Iterator[tuple[str, str, int]]:
        for k, t in enumerate(code):
            fresh = k == 0 or code[k - 1].line < t.line or code[k - 1].text in (";", "{", "}", "pub", "php", "@testable")
            if t.kind != "word" or not fresh and t.text not in strings:
                continue
            if t.text in strings:
                j = k + 1 + (k + 1 < len(code) and code[k + 1].text == "(")
                if j < len(code) and code[j].kind == "string":
                    yield _bare(code[j]), "", t.line
            elif t.text in words:
                j = k + 1
                while j < len(code) and code[j].text in skip:
                    j += 1
                end = next((i for i in range(j, min(len(code), j + 500)) if code[i].text == to), j) if to else j
                while end < len(code) and end <= j + 500 and code[end].text != ";" and code[end].line == t.line:
                    end += 1
                if end > j:
                    path = " ".join(text[code[j].at : code[end - 1].at + len(code[end - 1].text)].split())
                    alias = ""
                    if " = " in path:
                        alias, _, path = path.partition(" = ")
                    if " as " in path and "{" not in path and t.text == "import":
                        path, _, alias = path.partition(" as ")
                    yield path, alias, t.line

    return read


def _css_imports(code: list[scan.Token], text: str) -> Iterator[tuple[str, str, int]]:
    for k, t in enumerate(code):
        if t.text in ("import", "use", "forward") and k and code[k - 1].text == "@":
            for x in code[k + 1 : k + 5]:
                if x.kind == "string":
                    yield _bare(x), "", t.line
                    break
                if x.text not in ("url", "("):
                    if code[k + 1].text == "url":
                        yield re.split(r"[)\s]", text[x.at :], maxsplit=1)[0], "", t.line
                    break


_STATEMENTS = {
    "go": lambda code, text: ((_bare(t), code[k - 1].text if k and code[k - 1].line == t.line and code[k - 1].text not in ("import", "(") else "", t.line) for k, t in enumerate(code) if t.kind == "string" and _in_go_imports(code, k)),
    "rb": _statements(strings=("require", "require_relative", "load")),
    "java": _statements("import", skip=("static",)),
    "cs": _statements("using", skip=("static",)),
    "rs": _statements("use"),
    "swift": _statements("import", to="", skip=("class", "struct", "func", "enum", "protocol", "var", "let", "typealias")),
    "kt": _statements("import", to=""),
    "php": _statements("use", skip=("function", "const"), strings=("require", "require_once", "include", "include_once")),
    "css": _css_imports,
}
_STATEMENTS |= {k: _js_imports for k in ("js", "jsx", "ts", "tsx")} | {"scala": _STATEMENTS["kt"]} | {k: _css_imports for k in ("scss", "less", "sass")}


def _in_go_imports(code: list[scan.Token], k: int) -> bool:
    """For Go that can't be read as a whole: whether a string is in an import."""
    while k >= 0 and code[k].text != "import":
        k -= 1
        if k >= 0 and (code[k].kind == "close" or code[k].text in ("func", "var", "const", "type")):
            return False
    return k >= 0


def candidates(language: str, path: str, target: str) -> list[str]:
    """The paths that an import may mean, best first."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""

    def fold(p: str) -> str:
        parts: list[str] = []
        for x in p.split("/"):
            if x == ".." and parts:
                parts.pop()
            elif x not in ("", ".", ".."):
                parts.append(x)
        return "/".join(parts)

    if language == "py":
        dots = len(target) - len(target.lstrip("."))
        base = target.lstrip(".").replace(".", "/")
        if dots:
            up = folder.split("/") if folder else []
            base = "/".join(filter(None, [*up[: len(up) - dots + 1], base]))
        return [f"{base}.py", f"{base}/__init__.py"] if base else []
    if language in ("js", "jsx", "ts", "tsx", "vue", "svelte"):
        base = fold(f"{folder}/{target}" if target.startswith(".") else target.lstrip("/@"))
        return [base] + [base + x for x in (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js")]
    if language == "rb":
        return [fold(f"{folder}/{target}") + ".rb", f"{target}.rb", f"lib/{target}.rb"]
    if language in ("java", "kt", "scala", "cs"):
        return [target.replace(".", "/") + f".{language}"]
    if language == "rs":
        base = re.split(r"::\{|::\*|\s", target)[0].removeprefix("crate::").removeprefix("self::").replace("::", "/")
        return [f"src/{base}.rs", f"{base}.rs", f"{base}/mod.rs", f"{base.rsplit('/', 1)[0]}.rs"]
    return [fold(f"{folder}/{target}"), target]


def _rows(files: DataFrame, schema: str, of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, language, *r) for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3))) for r in of(language or "", path, content or "")]
            kinds = {"int": pa.int32(), "array<string>": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(schema.split(", ")[i].split()[1], pa.string())) for i in range(len(names))], names)

    return files.select("path", "language", "content").mapInArrow(run, schema)


def symbol_table(files: DataFrame) -> DataFrame:
    t = _rows(files, "path string, language string, name string, kind string, signature string, line int, docstring string", lambda l, p, c: symbols(l, c))
    return t.dropDuplicates(["path", "name", "kind", "line"])


def reference_table(files: DataFrame) -> DataFrame:
    return _rows(files, "path string, language string, name string, line int, context string", lambda l, p, c: references(l, c)).dropDuplicates(["path", "name", "line"])


def import_table(files: DataFrame) -> DataFrame:
    """With candidates, for graph.resolve_imports."""
    t = _rows(files, "path string, language string, import_path string, alias string, line int, context string, candidates array<string>", lambda l, p, c: [(*i, candidates(l, p, i[0])) for i in imports(l, c)])
    return t.dropDuplicates(["path", "import_path", "line"])


def cards(files: DataFrame, symbols_: DataFrame, references_: DataFrame, imports_: DataFrame) -> DataFrame:
    """X11: kind, name, path, language, line, summary, weight; a projection of the other tables."""
    test = F.lower("name").startswith("test") | F.col("path").rlike(r"(^|/)tests?/|(^|/)test_|_test\.")
    s = symbols_.select(F.when(test, "test").otherwise("symbol").alias("kind"), "name", "path", "language", "line", F.concat_ws(" ", "signature", "docstring").alias("summary"))
    r = references_.select(F.lit("usage").alias("kind"), "name", "path", "language", "line", F.col("context").alias("summary"))
    i = imports_.select(F.lit("import").alias("kind"), F.col("import_path").alias("name"), "path", "language", "line", F.col("context").alias("summary"))
    c = files.filter(is_config_path(F.col("path"))).select(F.lit("config").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "language", F.lit(1).alias("line"), F.col("content").alias("summary"))
    weight = F.create_map(*[F.lit(x) for kv in CARD_WEIGHTS.items() for x in kv])
    u = s.unionByName(r).unionByName(i).unionByName(c).withColumn("summary", F.substring(F.regexp_replace("summary", r"\s+", " "), 1, 512))
    return u.dropDuplicates(["kind", "name", "path", "line"]).withColumn("weight", F.try_element_at(weight, F.col("kind")))
