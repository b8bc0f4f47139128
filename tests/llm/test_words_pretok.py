import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.pretok import Cache, pretokens
from quarry.llm.words import LONG, LOWER, NOT_ALNUM, Words, minimizers, sliding

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n9.,ß😀", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_the_patterns(texts):
    w = Words(pa.array(texts, pa.string()))
    for d, t in enumerate(texts):
        assert [x.decode() for x in w.words_of(d)] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    w = Words(pa.array(texts, pa.string()), NOT_ALNUM, LOWER)
    for d, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert [x.decode() for x in w.words_of(d)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_equal_words_have_equal_hashes_wherever_they_are():
    w = Words(pa.array(["one two one", "xx two", None, "onetwo"]))
    h = w.hash.tolist()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 4


def test_word_hashes_of_all_sizes():
    """Words of 1 to 40 bytes and about LONG, by place and by another slice; no two alike, under either seed."""
    own = ["x" * n for n in [*range(1, 40), LONG - 1, LONG, LONG + 1, 3 * LONG]] + ["y" + "x" * n for n in range(40)]
    a, b = Words(pa.array([" ".join(own)])), Words(pa.array([f"zz {x}" for x in own]))
    assert len(set(a.hash.tolist())) == len(set(a.second.tolist())) == len(own) and not set(a.hash.tolist()) & set(a.second.tolist())
    assert a.hash.tolist() == b.hash[1::2].tolist() and a.second.tolist() == b.second[1::2].tolist()
    x, y = "a", "b"
    for _ in range(12):
        x, y = x + y, y + x
    w = Words(pa.array([x[:256], y[:256], x, y]))
    assert len(set(w.hash.tolist())) == 4


def test_sliding_and_minimizers():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 50, 200).astype(np.uint64)
    for width in (1, 2, 5, 7, 8):
        assert sliding(np.minimum, x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
    valid = rng.random(200) > 0.1
    for width in (3, 6):
        want = {j for i in range(200 - width + 1) if valid[i : i + width].all() for j in range(i, i + width) if x[j] == x[i : i + width].min()}
        assert set(minimizers(x, valid, width).tolist()) == want


def test_pretokens_are_those_of_the_pattern():
    import public_tokenizers
    import tiktoken

    from quarry.llm.op3_bpe import RANKS, load_ranks

    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    rnd = random.Random(0)
    for _ in range(300):
        t = "".join(rnd.choice("ab'sdl A1²½ \n\t 　\x1c\x85é𝔘😀٣") for _ in range(rnd.randrange(30)))
        parts = pretokens(t)
        assert "".join(parts) == t
        assert sum((one.encode_ordinary(p) for p in parts), []) == one.encode_ordinary(t)


def test_cache_is_bounded_and_right_after_dropping():
    c = Cache(lambda ws: ((w, w.upper()) for w in ws), 10)
    for k in range(100):
        words = [f"w{k}", "common", f"w{k + 1}"]
        assert c.of(words) == [w.upper() for w in words]
        assert len(c) <= 13
