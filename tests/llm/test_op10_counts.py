import random

from quarry.llm import op10_counts as C


def greedy(vocabulary, word):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), None)
        if size is None:
            return -1
        at, n = at + size, n + 1
    return n


def test_automaton_by_greedy_search():
    r = random.Random(1)
    for _ in range(400):
        v = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 12))}
        a = C.Automaton(v)
        for _ in range(40):
            w = bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 14)))
            assert a.count(w) == greedy(v, w)


def test_long_word_and_empty_vocabulary():
    a = C.Automaton({b"ab", b"a", b"b", b"ababab"})
    assert a.count(b"ab" * 300_000) == 100_000
    assert C.Automaton([]).count(b"x") == -1 and C.Automaton([]).count(b"") == 0


def test_table(spark, docs):
    import public_tokenizers

    v = set(C.load_ranks(public_tokenizers.path(C.VOCABULARY)))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Hello wörld, hello\nagain"), (4, "Hello wörld, hello\nagain"), (None, "x" * 50_000), (5, "  odd space")]
    got = C.counts(docs(rows)).collect()
    want = [(i, len((t or "").encode().split()), sum(greedy(v, b" " + w) if len(w) < 1000 else C.Automaton(v).count(b" " + w) for w in (t or "").encode().split())) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert C.counts(docs([])).count() == 0
