"""Symbols, references and imports of Go, read by its grammar.

Declarations are read in order; bodies are read for primary expressions, of which calls and composite literals
count.  A brace after a name is a literal only where the grammar allows it: not at the top of the header of an if, for or switch.
"""

from __future__ import annotations

import ast

from .scan import _GO_KEYWORDS, Token, Unreadable, ends_line, lex

_HEADERS = {"if", "for", "switch", "select"}


class Go:
    """One file.  symbols: (name, kind, signature, line, doc); calls: (name, line); imports: (path, alias, line)."""

    def __init__(self, text: str):
        self.text, every = text, lex("go", text)
        self.tokens = [t for t in every if t.kind not in ("comment", "newline")]
        self.comments = {t.line + t.text.count("\n"): t for k, t in enumerate(every) if t.kind == "comment" and (k == 0 or every[k - 1].kind == "newline")}
        self.at = 0
        self.symbols: list[tuple[str, str, str, int, str]] = []
        self.calls: list[tuple[str, int]] = []
        self.imports: list[tuple[str, str, int]] = []
        if self.peek() != "package" or not self.name(1):
            raise Unreadable("no package clause")
        self.at = 2
        while self.at < len(self.tokens):
            self.declaration()

    # tokens

    def token(self, ahead: int = 0) -> Token:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else Token("end", "", len(self.text), self.tokens[-1].line + 1)

    def peek(self, ahead: int = 0) -> str:
        return self.token(ahead).text

    def name(self, ahead: int = 0) -> bool:
        t = self.token(ahead)
        return t.kind == "word" and t.text not in _GO_KEYWORDS

    def over(self) -> bool:
        """Whether the statement ended before this token."""
        if self.at >= len(self.tokens) or not self.at:
            return True
        before, t = self.tokens[self.at - 1], self.tokens[self.at]
        return before.text == ";" or t.line > before.line + before.text.count("\n") and ends_line("go", before, t)

    def skip(self) -> None:
        """Past the bracket that this token opens, or past this token."""
        depth = 0
        while True:
            t = self.token()
            depth += (t.kind == "open") - (t.kind == "close")
            self.at += 1
            if depth <= 0 or t.kind == "end":
                return

    def until_over(self) -> None:
        self.skip()
        while not self.over():
            self.skip()

    def span(self, start: Token) -> str:
        """Source from `start` up to what was read last, white space folded."""
        last = self.tokens[self.at - 1]
        return " ".join(self.text[start.at : last.at + len(last.text)].split())[:240]

    def doc(self, line: int) -> str:
        """The comments that end on the line above."""
        found: list[str] = []
        while line - 1 in self.comments:
            t = self.comments[line - 1]
            lines = [t.text[2:]] if t.text.startswith("//") else t.text[2:-2].split("\n")
            found[:0] = [x.strip(" \t*") for x in lines]
            line = t.line
        return "\n".join(found).strip("\n")

    # declarations

    def declaration(self) -> None:
        t = self.token()
        if t.text == ";":
            self.at += 1
        elif t.text == "func":
            self.function(t)
        elif t.text in ("import", "type", "var", "const"):
            self.group(t)
        else:
            raise Unreadable(f"line {t.line}: {t.text} begins no declaration")

    def group(self, t: Token) -> None:
        """One specification, or several in parentheses."""
        one = {"import": self.import_, "type": self.type_, "var": self.values, "const": self.values}[t.text]
        self.at += 1
        if self.peek() != "(":
            return one(self.doc(t.line))
        self.at += 1
        while self.peek() != ")":
            if self.token().kind == "end":
                raise Unreadable("a group that doesn't end")
            if self.peek() == ";":
                self.at += 1
            else:
                one("" if one == self.import_ else self.doc(self.token().line) or self.doc(t.line))
        self.at += 1

    def import_(self, doc: str) -> None:
        t = self.token()
        alias = self.peek() if t.kind == "word" or t.text == "." else ""
        self.at += bool(alias)
        path = self.token()
        if path.kind != "string":
            raise Unreadable(f"line {t.line}: an import without a path")
        self.at += 1
        try:
            value = path.text[1:-1] if path.text[0] == "`" else ast.literal_eval(path.text)
        except (SyntaxError, ValueError):
            value = path.text.strip('"`')
        self.imports.append((value, alias, t.line))

    def type_(self, doc: str) -> None:
        t = self.token()
        if not self.name():
            raise Unreadable(f"line {t.line}: a type without a name")
        self.until_over()
        self.symbols.append((t.text, "type", self.span(t), t.line, doc))

    def values(self, doc: str) -> None:
        self.at += 1
        while not self.over() and self.peek() != ")":
            self.step(False)

    def function(self, t: Token) -> None:
        self.at += 1
        kind = "method" if self.peek() == "(" else "function"
        if kind == "method":
            self.skip()
        name = self.token()
        if not self.name():
            raise Unreadable(f"line {t.line}: a function without a name")
        self.at += 1
        self.signature()
        self.symbols.append((name.text, kind, self.span(t), t.line, self.doc(t.line)))
        if self.peek() == "{" and not self.over():
            self.body()

    def signature(self) -> None:
        """Type parameters, parameters and results, up to a body or whatever follows."""
        if self.peek() == "[":
            self.skip()
        if self.peek() == "(":
            self.skip()
        if self.over():
            return
        if self.peek() == "(":
            self.skip()
        else:
            self.type()

    def type(self) -> None:
        """Past a type, if there is one."""
        while True:
            t = self.token()
            if t.text in ("*", "<-", "chan"):
                self.at += 1
            elif t.text == "[":
                self.skip()
            elif t.text == "map":
                self.at += 1
                self.skip()
            elif t.text in ("struct", "interface"):
                self.at += 1
                return self.skip()
            elif t.text == "func":
                self.at += 1
                return self.signature()
            elif t.text == "(":
                return self.skip()
            elif self.name():
                self.at += 1
                while self.peek() == "." and self.name(1):
                    self.at += 2
                if self.peek() == "[" and not self.over():
                    self.skip()
                return
            else:
                return

    # statements and expressions

    def body(self) -> None:
        """A block, in braces."""
        self.at += 1
        header = False
        while self.peek() != "}":
            t = self.token()
            if t.kind == "end":
                raise Unreadable("a block that doesn't end")
            if t.text in _HEADERS:
                header, self.at = True, self.at + 1
            elif t.text == "{":  # a block: literals are read with their types
                header = False
                self.body()
            elif t.text == "type":
                self.at += 1
                if self.peek() == "(":
                    self.skip()
                else:
                    self.until_over()
            else:
                self.step(header)
        self.at += 1

    def inside(self) -> None:
        """What is in brackets, or in the braces of a literal."""
        self.at += 1
        while self.token().kind != "close":
            if self.token().kind == "end":
                raise Unreadable("a bracket that doesn't end")
            if self.peek() == "{":  # an element whose type is left out
                self.inside()
            else:
                self.step(False)
        self.at += 1

    def step(self, header: bool) -> None:
        """A primary expression, if this token begins one; else past it."""
        t = self.token()
        if t.kind in ("string", "number") or self.name() or t.text in ("(", "[", "func", "struct", "map", "interface", "chan"):
            self.primary(header)
        elif t.kind == "open":
            self.inside()
        else:
            self.at += 1

    def primary(self, header: bool) -> None:
        t = self.token()
        called = literal = None  # the name that a call, or a literal, at this place has
        typed = False  # a literal may follow in a header, too
        if self.name():
            called = literal = t.text
            self.at += 1
        elif t.text == "(":
            self.inside()
        elif t.text == "[":
            self.inside()
            begin = self.at
            self.type()
            literal, typed = self.element(begin), True
        elif t.text == "func":
            self.at += 1
            self.signature()
            if self.peek() == "{":
                self.body()
        elif t.text in ("struct", "map", "interface", "chan"):
            self.type()
            typed = t.text in ("struct", "map")
        else:
            self.at += 1
        while not self.over():
            n = self.peek()
            if n == "." and self.token(1).kind == "word":
                called = literal = self.peek(1)
                self.at += 2
            elif n == "." and self.peek(1) == "(":
                self.at += 1
                self.inside()
                called = literal = None
            elif n == "[":
                self.inside()
                called = literal = None
                typed = False
                if self.peek() == "{" and not header:  # of a generic type; an index can't be followed by a block but in a header
                    return self.inside()
            elif n == "(":
                if called:
                    self.calls.append((called, t.line))
                self.inside()
                called = literal = None
            elif n == "{" and (typed or literal and not header):
                if literal:
                    self.calls.append((literal, t.line))
                self.inside()
                called = literal = None
                typed = False
            else:
                return

    def element(self, begin: int) -> str | None:
        """The name of an element type that was read from `begin` on; none of maps, functions and the like."""
        own = self.tokens[begin : self.at]
        if any(t.text in ("map", "func", "struct", "interface", "chan") for t in own) or not own or own[-1].kind == "close":
            return None
        return own[-1].text


def read(text: str) -> Go | None:
    """None where the text can't be read as Go."""
    try:
        return Go(text)
    except (Unreadable, RecursionError, IndexError):
        return None
