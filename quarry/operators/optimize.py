"""Shortening drafts by compression (V11, X16, E05): Metropolis-Hastings over identifier swaps, on the driver or in parallel chains."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

_NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*")
_OPEN, _CLOSE = b"([{", b")]}"


@dataclass
class Settings:
    steps: int = 200
    temperature: float = 1.0
    cooling: float = 0.99
    seed: int = 1
    level: int = 9


def spans(draft: bytes, keep: frozenset[bytes] = frozenset()) -> list[tuple[int, int]]:
    """Where identifiers stand that may be swapped."""
    return [m.span() for m in _NAME.finditer(draft) if m[0] not in keep]


def prior(draft: bytes) -> float:
    """10 for each closing bracket without an opening one, 5 for each left over."""
    depth = penalty = 0
    for c in draft:
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            penalty += 10 * (depth <= 0)
            depth -= 1
    return float(penalty + 5 * abs(depth))


def python_compiles(draft: bytes) -> bool:
    """E05 for Python; other languages need checkers of their own."""
    try:
        compile(draft, "draft", "exec")
        return True
    except (SyntaxError, ValueError):
        return False


def mutate(draft: bytes, vocabulary: list[bytes], r: random.Random, keep: frozenset[bytes]) -> bytes:
    """One identifier, everywhere it stands, gives way to a word of the vocabulary or to another identifier of the draft."""
    found = spans(draft, keep)
    if not found:
        return draft
    a, b = r.choice(found)
    old = draft[a:b]
    new = r.choice(vocabulary) if vocabulary and r.random() < 0.7 else draft[slice(*r.choice(found))]
    return re.sub(rb"(?<![A-Za-z0-9_])" + re.escape(old) + rb"(?![A-Za-z0-9_])", lambda _: new, draft)


def optimise(draft: bytes, dictionary: bytes = b"", vocabulary: Iterable[str] = (), settings: Settings | None = None, check: Callable[[bytes], bool] = python_compiles, keep: Iterable[str] = ()) -> bytes:
    """The draft of least energy that was met: compressed size given the dictionary, and prior; drafts that fail the check never count."""
    import keyword

    s = settings or Settings()
    r, words, kept = random.Random(s.seed), [w.encode() for w in vocabulary if _NAME.fullmatch(w.encode())], frozenset(k.encode() for k in [*keyword.kwlist, *keep])

    def energy(x: bytes) -> float:
        c = zlib.compressobj(s.level, zdict=dictionary[-32768:]) if dictionary else zlib.compressobj(s.level)
        return len(c.compress(x) + c.flush()) + prior(x)

    now, cost, heat = draft, energy(draft), s.temperature
    best, least = now, cost
    for _ in range(s.steps):
        trial = mutate(now, words, r, kept)
        if trial != now and check(trial):
            e = energy(trial)
            if e <= cost or r.random() < math.exp((cost - e) / max(heat, 1e-9)):
                now, cost = trial, e
                if e < least:
                    best, least = trial, e
        heat *= s.cooling
    return best


def chains(drafts: DataFrame, dictionary: bytes = b"", vocabulary: Iterable[str] = (), settings: Settings | None = None) -> DataFrame:
    """drafts: id, seed, draft string -> id, seed, draft: a chain for each row."""
    s, words = settings or Settings(), list(vocabulary)

    def run(batches):
        for b in batches:
            made = [optimise(d.encode(), dictionary, words, Settings(s.steps, s.temperature, s.cooling, int(k), s.level)).decode() for k, d in zip(b["seed"], b["draft"])]
            yield pd.DataFrame({"id": b["id"], "seed": b["seed"], "draft": made})

    return drafts.select("id", "seed", "draft").mapInPandas(run, "id long, seed long, draft string")
