"""Pre-tokens of byte-level BPE: the matches of public_tokenizers.PATTERN.

The pattern is compiled for Python's re with its Unicode classes spelled out
(letters and numbers as the regex module has them, white space by the Unicode
property, which leaves out \\x1c-\\x1f).  re is quick only while a class stays
in the basic plane, so a text with characters beyond it goes to the regex module.
"""

from __future__ import annotations

import functools
import re


def ranges(chars: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in chars:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


@functools.cache
def patterns():
    import public_tokenizers
    import regex

    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    of = lambda p: "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges([ord(c) for c in regex.findall(p, plane)]))
    letter, number, space = of(r"\p{L}"), of(r"\p{N}"), of(r"\p{White_Space}")
    quick = public_tokenizers.PATTERN
    quick = quick.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    quick = quick.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
    exact = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+")
    return re.compile(quick).findall, regex.compile(exact).findall, re.compile("[\U00010000-\U0010ffff]").search


def pretokens(text: str) -> list[str]:
    """Together they are the whole text."""
    quick, exact, beyond = patterns()
    return exact(text) if beyond(text) else quick(text)


class Cache(dict):
    """Word -> whatever `make` gives for a list of new words.

    Beyond `most` words, which bounds memory, the half that came last goes: common words come early.  Words of over LONG
    characters are kept until the next new ones come."""

    LONG = 64

    def __init__(self, make, most: int):
        self.make, self.most, self.long = make, most, []

    def ready(self, words) -> None:
        wanted = set(words)
        new = {w for w in wanted if w not in self}
        if new:
            for w in self.long:
                if w not in wanted:
                    self.pop(w, None)
            self.long = [w for w in wanted if len(w) > self.LONG]
            if len(self) + len(new) > self.most:
                for w in list(self)[self.most // 2 :]:
                    if w not in wanted:
                        del self[w]
            self.update(self.make(list(new)))

    def of(self, words: list) -> list:
        try:
            return list(map(self.__getitem__, words))
        except KeyError:
            self.ready(words)
            return list(map(self.__getitem__, words))
