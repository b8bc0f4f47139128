"""Tokens and top-level spans of source code in one pass, by a pushdown scanner.

Strings, comments, templates and brackets nest as the language has them, so a brace in a string or a
`class` in a comment begins nothing.  A text whose brackets, strings or comments don't close is unreadable; callers
then fall back to lines.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, comment, open, close, op, newline
    text: str
    at: int
    line: int  # from 1


class Unreadable(ValueError):
    pass


#: Language: (line comments, block comments, nested or not, kinds of strings, how statements end).
_BRACES = (("//",), ("/*", "*/"), False)
RULES = {
    "go": (*_BRACES, ("raw`", '"', "'"), "line"),
    "js": (*_BRACES, ("template", '"', "'", "regex"), "line"),
    "java": (*_BRACES, ('"""', '"', "'"), "semicolon"),
    "cs": (*_BRACES, ('"""', 'verbatim@"', '"', "'"), "semicolon"),
    "c": (*_BRACES, ('"', "'"), "semicolon"),
    "rs": (("//",), ("/*", "*/"), True, ("rust raw", "long\"", "rust char"), "semicolon"),
    "kt": (("//",), ("/*", "*/"), True, ('"""', '"', "'"), "line"),
    "php": (("//", "#"), ("/*", "*/"), False, ('long"', "long'"), "semicolon"),
    "css": ((), ("/*", "*/"), False, ('"', "'"), "semicolon"),
    "rb": (("#",), None, False, ('long"', "long'"), "end"),
    "py": (("#",), None, False, ("py",), "indent"),
}
RULES |= {k: RULES["js"] for k in ("jsx", "ts", "tsx")} | {k: RULES["kt"] for k in ("scala", "swift")} | {k: RULES["c"] for k in ("cpp", "h")} | {k: RULES["css"] for k in ("scss", "less")}
_STRINGS = {
    '"': r'"(?:\\.|[^"\\\n])*+"',
    "'": r"'(?:\\.|[^'\\\n])*+'",
    'long"': r'"(?:\\(?s:.)|[^"\\])*+"',
    "long'": r"'(?:\\(?s:.)|[^'\\])*+'",
    "raw`": r"`[^`]*+`",
    '"""': r'"""(?s:\\.|.)*?"""',
    'verbatim@"': r'\$?@\$?"(?:""|[^"])*+"',
    "rust raw": r'b?r(?P<hashes>#*)"(?s:.*?)"(?P=hashes)',
    "rust char": r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|'[A-Za-z_]\w*",
    "py": r"""(?i:[rbfu]{0,2})(?:\"{3}(?s:\\.|.)*?\"{3}|'{3}(?s:\\.|.)*?'{3}|"(?:\\(?s:.)|[^"\\\n])*+"|'(?:\\(?s:.)|[^'\\\n])*+')""",
}
_OPS = r"<<=|>>=|\.\.\.|&\^=|===|!==|\*\*=|&&=|\|\|=|\?\?=|>>>|=>|->|:=|::|\+\+|--|&&|\|\||\?\?|\?\.|<<|<-|[-+*/%&|^=!<>]=|[^\s\w]"
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*")
_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


@functools.cache
def _pattern(language: str) -> re.Pattern:
    lines, block, _, strings, _ = RULES[language]
    parts = [r"(?P<newline>\n)", r"(?P<space>[^\S\n]+)"]
    comments = [re.escape(c) + (r"(?!\[)" if c == "#" and language == "php" else "") + r"[^\n]*" for c in lines]
    if language == "rb":
        comments.append(r"(?m:^)=begin\b(?s:.*?)(?m:^)=end\b[^\n]*")
    if comments:
        parts.append(f"(?P<comment>{'|'.join(comments)})")
    if block:
        parts.append(f"(?P<block>{re.escape(block[0])})")
    if "template" in strings:
        parts.append("(?P<template>`)")
    own = [_STRINGS[s] for s in strings if s in _STRINGS]
    parts.append(f"(?P<string>{'|'.join(own)})")
    word = r"[^\W\d][\w$]*|[$@]+[^\W\d][\w$]*[!?]?" if language in ("js", "php", "rb") or RULES[language] is RULES["js"] else r"[^\W\d]\w*"
    word = r"-?-?[^\W\d][\w-]*" if RULES[language] is RULES["css"] else word
    parts += [f"(?P<word>{word})", r"(?P<number>\d(?:[eEpP][+-]\d|\.\d|\w)*)", r"(?P<open>[(\[{])", r"(?P<close>[)\]}])", f"(?P<op>{_OPS})"]
    return re.compile("|".join(parts))


def loose(language: str, text: str) -> list[Token]:
    """Tokens of a text that lex() can't read: line by line, without heed to brackets, past what is no token."""
    pattern, out, base = _pattern(language), [], 0
    for number, line in enumerate(text.split("\n"), 1):
        at = 0
        while at < len(line):
            m = pattern.match(line, at)
            kind = m.lastgroup if m else "op"
            end = max(at + 1, m.end() if m else 0)
            if kind in ("block", "template"):
                closed = line.find("*/" if kind == "block" else "`", end)
                kind, end = ("comment", closed + 2) if kind == "block" else ("string", closed + 1)
                end = end if closed >= 0 else len(line)
            if m and kind not in ("space", "comment"):
                out.append(Token("string" if kind == "hashes" else kind, line[at:end], base + at, number))
            at = end
        base += len(line) + 1
    return out


def code(language: str, text: str) -> list[Token]:
    """The tokens that are neither comments nor line breaks, as far as they can be told."""
    try:
        return [t for t in lex(language, text) if t.kind not in ("comment", "newline")]
    except Unreadable:
        return loose(language, text)


def lex(language: str, text: str) -> list[Token]:
    """All tokens but white space; newlines are tokens, too."""
    pattern, (_, block, nested, strings, _) = _pattern(language), RULES[language]
    out: list[Token] = []
    open_: list[str] = []
    at, line, size, last = 0, 1, len(text), None

    def add(kind: str, end: int) -> None:
        nonlocal at, line, last
        out.append(Token(kind, text[at:end], at, line))
        line += text.count("\n", at, end)
        at = end
        if kind not in ("comment", "newline"):
            last = out[-1]

    def template() -> None:
        """From a backtick, or the brace that ends a part of code, to the next backtick or `${`."""
        end = at + 1
        while True:
            m = re.compile(r"(?:\\(?s:.)|[^`\\$]|\$(?!\{))*+(`|\$\{)").match(text, end)
            if not m:
                raise Unreadable(f"line {line}: a template that doesn't end")
            if m[1] == "${":
                open_.append("${")
            add("string", m.end())
            return

    while at < size:
        m = pattern.match(text, at)
        if not m:
            raise Unreadable(f"line {line}: {text[at:at + 10]!r}")
        kind = m.lastgroup if m.lastgroup != "hashes" else "string"
        if kind == "space":
            at = m.end()
        elif kind == "block":
            end = _block_end(text, at, block, nested)
            if end < 0:
                raise Unreadable(f"line {line}: a comment that doesn't end")
            add("comment", end)
        elif kind == "template":
            template()
        elif kind == "op" and m[0][0] == "/" and "regex" in strings and (last is None or last.kind in ("open", "op") or last.text in _BEFORE_OPERAND) and (r := _REGEX.match(text, at)):
            add("string", r.end())
        elif kind == "op" and (m[0] in "\"'" or m[0] == "`" and "raw`" in strings):
            raise Unreadable(f"line {line}: a string that doesn't end")
        elif kind == "open":
            open_.append(m[0])
            add("open", m.end())
        elif kind == "close":
            if m[0] == "}" and open_ and open_[-1] == "${":
                open_.pop()
                template()
                continue
            if not open_ or open_.pop() != _PAIRS[m[0]]:
                raise Unreadable(f"line {line}: {m[0]} closes nothing")
            add("close", m.end())
        else:
            add("word" if kind == "string" and language == "rs" and m[0][0] == "'" and m[0][-1] != "'" else kind, m.end())
    if open_:
        raise Unreadable(f"{open_[-1]} isn't closed")
    return out


def _block_end(text: str, at: int, block: tuple[str, str], nested: bool) -> int:
    if not nested:
        end = text.find(block[1], at + 2)
        return end + 2 if end >= 0 else -1
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return -1


#: Fixed words: of a language's grammar.
_GO_ENDS = {"break", "continue", "fallthrough", "return"}
_GO_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_OPENS_ITEM = set("export default import const let var async function class interface type enum namespace module abstract declare public private protected internal open data sealed override fun func struct protocol extension object trait case val".split())
_GOES_ON = set("else catch finally extends implements instanceof in of as where with from is".split())
_RUBY_OPENS = {"def", "class", "module", "do", "begin", "case", "if", "unless", "while", "until", "for"}


def ends_line(language: str, before: Token, after: Token | None) -> bool:
    """Whether a statement ends at the line break between these."""
    if language == "go":
        return before.kind in ("string", "number", "close") or before.text in ("++", "--") or before.kind == "word" and (before.text not in _GO_KEYWORDS or before.text in _GO_ENDS)
    if before.kind == "op" and before.text not in ("++", "--", ";") or before.kind == "open" or before.kind == "word" and before.text in _GOES_ON | _OPENS_ITEM:
        return False
    if after is None:
        return True
    return not (after.kind == "close" or after.text in _GOES_ON or after.kind == "op" and after.text not in ("@", "++", "--", "#", "!", ";", "~") or after.text == "{")


def spans(language: str, text: str) -> list[tuple[int, int]]:
    """(first line, last line) of each top-level item that isn't a comment; Go's items begin with the comment right above them."""
    how = RULES[language][4]
    tokens = lex(language, text)
    if how == "indent":
        return _indented(tokens)
    code = [t for t in tokens if t.kind not in ("comment", "newline")]
    out: list[tuple[int, int]] = []
    last_line = lambda t: t.line + t.text.count("\n")
    depth, first, words = 0, None, 0
    for k, t in enumerate(code):
        after = code[k + 1] if k + 1 < len(code) else None
        breaks = after is None or after.line > last_line(t)
        if first is None:
            if t.text == ";" or t.kind == "close" and depth <= 0:
                continue
            first = t
        if t.kind == "open":
            depth += 1
        elif t.kind == "close":
            depth -= 1
        elif how == "end" and t.kind == "word" and (k == 0 or code[k - 1].text != "."):
            starts = k == 0 or code[k - 1].line < t.line or code[k - 1].text in (";", "=", "(")
            if t.text in ("def", "class", "module", "begin", "case") and not (k and code[k - 1].text in ("<<", ":")):
                words += 1
            elif t.text == "do" and not (words and _loops(code, k)) or t.text in ("if", "unless", "while", "until", "for") and starts:
                words += 1
            elif t.text == "end":
                words -= 1
        if depth or words:
            continue
        if how == "semicolon":
            over = t.text == ";" or t.text == "}" and not (after and (after.text in (";", ",", ")", "]", ".", "=", "else", "catch", "finally")))
        elif how == "end":
            over = breaks and not (t.kind == "op" and t.text not in ("?", "!"))
        else:
            over = t.text == ";" or breaks and (after is None or ends_line(language, t, after)) and not _only_marks(code, first, k)
        if over or after is None:
            out.append((first.line, last_line(t)))
            first = None
    if words:
        raise Unreadable("a block without end")
    return _with_comments(tokens, out) if language == "go" else out


def _loops(code: list[Token], k: int) -> bool:
    """Ruby: whether this `do` belongs to a while, until or for at the start of its line."""
    j = k
    while j and code[j - 1].line == code[k].line:
        j -= 1
    return code[j].text in ("while", "until", "for")


def _only_marks(code: list[Token], first: Token, k: int) -> bool:
    """Whether what there is of an item are decorators or annotations only, so that it goes on."""
    j = next(i for i in range(k, -1, -1) if code[i] is first)
    if code[j].text != "@" and not code[j].text.startswith("@"):
        return False
    depth = 0
    for i in range(j, k + 1):
        t = code[i]
        depth += (t.kind == "open") - (t.kind == "close")
        if not depth and t.kind == "word" and i > j and code[i - 1].text not in ("@", ".") and not t.text.startswith("@"):
            return False
    return True


def _with_comments(tokens: list[Token], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Items with the comments that end on the line above."""
    alone: dict[int, int] = {}  # last line of a comment that has its lines for itself: its first
    for k, t in enumerate(tokens):
        if t.kind == "comment" and (k == 0 or tokens[k - 1].kind == "newline"):
            alone[t.line + t.text.count("\n")] = t.line
    out = []
    for a, b in found:
        while a - 1 in alone:
            a = alone[a - 1]
        out.append((a, b))
    return out


def _indented(tokens: list[Token]) -> list[tuple[int, int]]:
    """Python: an item is what begins in the first column, to the last line before the next; decorators belong to what they decorate."""
    out: list[list[int]] = []
    depth, fresh, begin = 0, True, 0
    marked = False
    for k, t in enumerate(tokens):
        if t.kind == "newline":
            fresh, begin = fresh or not depth, t.at + 1
            continue
        if t.kind == "comment":
            continue
        if fresh and not depth and t.at == begin and not (out and (marked or t.text in ("else", "elif", "except", "finally"))):
            out.append([t.line, t.line])
            marked = t.text == "@"
        elif fresh and t.at == begin and t.text in ("def", "class", "async"):
            marked = False
        fresh = False
        depth += (t.kind == "open") - (t.kind == "close")
        if out:
            out[-1][1] = t.line + t.text.count("\n")
    return [(a, b) for a, b in out]
