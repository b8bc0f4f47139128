import collections
import hashlib
import math
import random
import re

from quarry.llm import op6_secrets as S

KINDS = [k[0] for k in [*S.RULES, *S.CLASSES]]
BASE = [
    (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0-9a-f]+", 0, 24),
]


def brute(text):
    t, base, own = text or "", [], []
    for k, (p, g, least) in enumerate(BASE):
        base += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[g]) >= least]
    for k, (_, p, width, bits) in enumerate(S.CLASSES, len(BASE)):
        for m in re.finditer(p, t):
            run, now = m[0], None
            if any(re.search(a, run) for a in S.ALLOW):
                continue
            for i in range(len(run) - width + 1):
                c = collections.Counter(run[i : i + width])
                if math.log2(width) - sum(x * math.log2(x) for x in c.values()) / width >= bits:
                    if now and i <= now[1]:
                        now[1] = i + width
                    else:
                        own += [(m.start() + now[0], k, m.start() + now[1])] if now else []
                        now = [i, i + width]
            own += [(m.start() + now[0], k, m.start() + now[1])] if now else []
    return sorted(base), sorted(base + [e for e in own if not any(b[0] <= e[0] and e[2] <= b[2] for b in base)])


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def rows():
    r = random.Random(4)
    parts = ["token", "=", ":", " ", '"', "abcdefg", "AKIA", "ABCDEFGHIJKLMNOP", "Z9", "0a1b2c3d4e5f", "é", "😀", "pAsswd", "secret", "'", "/x+Y7", "qW3rT5yU8iO0pA2sD4", "example", "\n"]
    out = [(100 + k, "".join(r.choice(parts) for _ in range(r.randrange(1, 16)))) for k in range(150)]
    blob = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(4000))
    return out + [(None, None), (1, ""), (2, "password=token : abcdefgh"), (3, "éà token=\"abcdef\" x AKIA" + "A9" * 10 + " API_KEY = zzzzzzz"), (4, blob), (5, blob), (5, blob), (6, "Ab3+" * 12 + " " + "cafe" * 8 + " apikey:'0123456789abcdef'")]


def test_spans_by_brute_force(spark, docs):
    data = rows()
    want = []
    for i, t in data:
        base, spans = brute(t)
        want.append((i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
    got = S.digest(S.scan(docs(data))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any("entropy_base64" in w[5] for w in want) and any("entropy_hex" in w[5] or "hex" in w[5] for w in want)


def test_redaction(spark, docs):
    data = rows()
    got = S.redact(docs(data))
    want = []
    for i, t in data:
        at, out = 0, ""
        spans = brute(t)[1]
        for a, _, b in spans:
            if a >= at:
                out += (t or "")[at:a] + S.MASK
            at = max(at, b)
        want.append((i, out + t[at:] if spans else t))
    assert got.columns == docs(data).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.filter("text is not null and n_chars <> length(text)").count() == 0


def test_main_path_has_no_python(spark, docs):
    plan = S.digest(S.scan(docs([(1, "x")])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark, docs):
    assert S.digest(S.scan(docs([]))).count() == 0


def test_many_matches_and_long_texts(spark, docs):
    """Tens of thousands of matches in one text, and one match of a megabyte."""
    r = random.Random(3)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    many = " ".join(f"é token={key(8)} {'0a1b2c3d' * 3}" for _ in range(15_000))
    rows = [(1, many), (2, "password: " + "Ab1" * 350_000), (3, "x" * 2_000_000), (4, None)]
    got = {x.doc_id: x for x in S.digest(S.scan(docs(rows))).collect()}
    assert (got[1].n_assign, got[1].n_hex) == (15_000, 15_000) and got[2].n_assign == 1 and got[3].spans == ""
    base, spans = brute(many)
    assert got[1].spans == ",".join(f"{([k[0] for k in S.RULES] + [k[0] for k in S.CLASSES])[k]}:{a}:{b}" for a, k, b in spans)
    masked = {x.doc_id: x.text for x in S.stage(spark, docs(rows), "").collect()}
    assert masked[1].count(S.MASK) == 30_000 and "token" not in masked[1] and masked[2] == S.MASK and masked[3] == "x" * 2_000_000 and masked[4] is None


def test_stage_leaves_own_columns(spark, docs):
    d = docs([(1, "password = hunter22 and more"), (2, "clean")])
    out = S.stage(spark, d, "")
    assert out.columns == d.columns and all(x.base == x.spans == 7 for x in out.collect())


def test_no_pattern_recurses():
    """Java's matcher recurses once for each repetition of a group, so none may repeat without bound."""
    for p in [*(x[1] for x in [*S.RULES, *S.CLASSES]), *S.ALLOW]:
        assert not re.search(r"\)([*+]|\{\d+,\})", p.replace(r"\)", "")), p


def test_a_million_path_segments(spark, docs):
    path = "a/" * 1_000_000
    key = "Zk9" + "qW3rT5yU8iO0pA2sD4fG6hJ1"
    rows = [(1, path + "end"), (2, path + key), (3, "/" * 1_000_000), (4, "see -/_/b-c/" * 3 + "d_9 and /usr/local/share/doc")]
    got = {x.doc_id: x.spans for x in S.digest(S.scan(docs(rows))).collect()}
    assert got[1] == got[3] == got[4] == ""
    spans = brute("a/" * 50 + key)[1]
    assert got[2] == written([(a + len(path) - 100, k, b + len(path) - 100) for a, k, b in spans]) != ""
    masked = {x.doc_id: x.text for x in S.stage(spark, docs(rows), "").collect()}
    assert masked[1] == rows[0][1] and masked[2].endswith(S.MASK) and masked[3] == rows[2][1] and masked[4] == rows[3][1]
