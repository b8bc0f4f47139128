from quarry.operators import optimize as O

DRAFT = b"def alpha(first_value, second_value):\n    return first_value + second_value * other_number\n"


def test_never_longer_and_always_compiles():
    got = O.optimise(DRAFT, vocabulary=["x", "value"], settings=O.Settings(steps=150, seed=3))
    assert O.python_compiles(got)
    import zlib

    assert len(zlib.compress(got, 9)) <= len(zlib.compress(DRAFT, 9))


def test_parts():
    assert O.prior(b"(a[b])") == 0 and O.prior(b")(") == 10 and O.prior(b"((") == 10
    assert [DRAFT[a:b] for a, b in O.spans(b"if x: y", frozenset([b"if"]))] == [DRAFT[3:4], DRAFT[6:7]]
    assert not O.python_compiles(b"def (")
    assert O.optimise(b"", settings=O.Settings(steps=3)) == b""


def test_chains(spark):
    d = spark.createDataFrame([(1, k, DRAFT.decode()) for k in range(3)], "id long, seed long, draft string")
    got = O.chains(d, vocabulary=["x"], settings=O.Settings(steps=30)).collect()
    assert len(got) == 3 and all(O.python_compiles(r.draft.encode()) for r in got)
