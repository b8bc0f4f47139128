"""Quality by hierarchical empirical Bayes.

Evidence of a document: the log-odds that a logistic regression over its text's
make-up gives.  Evidence of its site: the rate of good documents among its
neighbours of one host (`source`) and one path (`source`, `lang`).  A host's rate
is a beta posterior whose prior is the global rate, a path's one whose prior is
its host's posterior, so sparse sites shrink to what stands above them; how
strongly is estimated from the spread of rates between sites (method of moments).
A document's own share is taken out of its site's counts.  Then

    log-odds = document's - global prior's + path posterior's

which is Bayes' rule if text and site are independent given quality.

The regression is fitted on at most FIT_ROWS labelled documents (the first by a
hash of doc_id); all else, that is every count and rate, is over all documents.
Site tables are joined by broadcast up to BROADCAST_SITES rows (counted), by
shuffle beyond.

Cases: a text null or without words brings no evidence, so its site decides;
source or lang null is a site of its own; labels null are no labels, of several
for one doc_id the least counts; without labels of both kinds the document's
evidence is nought and all documents are kept; repeated rows each count and are
each judged; further columns are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, sheltered, table, text_slices, written
from .words import SPACE, Words

FIT_ROWS, RIDGE, BROADCAST_SITES, THRESHOLD = 20_000, 1.0, 100_000, 0.5

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"*%&$#", "bang": b"!?", "bar": b"|<>{}[]", "stop": b".,;:", "line": b"\n", "space": b" \t", "quote": b"\"'()-_/=+"}
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _chars in enumerate(_KINDS.values()):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = len(_KINDS) + 1
_SITE = ["site_host", "site_path", "site_n", "site_k", "site_hn", "site_hk"]
FEATURES = [*_KINDS, "letter_bytes", "other_script", "size", "word_length", "word_spread", "marked", "twice", "repeats"]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a row of FEATURES by text, words by text)."""
    w = Words(texts, SPACE)
    n, many = len(w.counts), len(_KINDS) + 2
    sizes = np.diff(w.text_off)
    place = np.repeat(np.arange(n, dtype=np.int32) * many, sizes)
    place += _CLASS[w.data]
    share = np.bincount(place, minlength=n * many).reshape(n, many) / np.maximum(sizes, 1)[:, None]
    words = np.maximum(w.counts, 1)
    span = (w.ends - w.starts).astype(float)
    total, square = (np.bincount(w.doc, x, n) / words for x in (span, span * span))
    last = w.data[w.ends - 1]
    marked = np.bincount(w.doc, np.isin(_CLASS[last], (2, 3)), n) / words
    return np.column_stack([share, np.log1p(words), total, np.sqrt(np.maximum(square - total * total, 0)), marked, _again(w, 1) / words, _again(w, 8) / words]), w.counts


def _again(w: Words, step: int) -> np.ndarray:
    """By text, words that also stand `step` words on."""
    same = np.zeros(len(w.hash), bool)
    if len(w.hash) > step:
        same[:-step] = (w.hash[:-step] == w.hash[step:]) & (w.doc[:-step] == w.doc[step:])
    return np.bincount(w.doc, same, len(w.counts))


class Regression:
    """Ridge logistic regression on standardised features, by Newton's steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])
        self.w = np.zeros(z.shape[1])
        pull = np.full(z.shape[1], RIDGE)
        pull[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ self.w))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * self.w)
            self.w += step
            if np.abs(step).max() < 1e-7:
                break
        self.prior = float(y.mean())

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[1:], -30, 30)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Regression | None:
    """None where labels of both kinds are wanting."""
    sample = _labels(labels).orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    some = pick(docs, "doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))  # at most FIT_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            x, n = features(b.column(0))
            take = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(x[take]), pa.list_(pa.float64())), b.column(1).take(pa.array(take)), b.column(2).take(pa.array(take))], ["x", "good", "doc_id"])

    got = some.select("text", "good", "doc_id").mapInArrow(run, f"x array<double>, good double, doc_id {docs.schema['doc_id'].dataType.simpleString()}").orderBy("doc_id").limit(2 * rows).toPandas()
    if got["good"].nunique() < 2:
        return None
    return Regression(np.array(got["x"].tolist()), got["good"].to_numpy())


def _labels(labels: DataFrame) -> DataFrame:
    return pick(labels, "doc_id", "quality").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").cast("double").alias("good")).filter("good is not null and l_id is not null")


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def scored(docs: DataFrame, model: Regression | None) -> DataFrame:
    """docs with doc_odds: null where the text brings no evidence.  What docs has under this name is replaced."""
    kept = docs.drop("doc_odds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            x, n = features(b.column(b.schema.get_field_index("text")))
            odds = model.log_odds(x) if model else np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(odds, mask=n == 0)], [*b.schema.names, "doc_odds"])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "doc_odds double"]))


def _strength(sites: DataFrame, prior: Column) -> float:
    """Pseudo-counts of the beta prior: from the spread of rates about `prior` beyond what binomial noise makes; one row comes back."""
    r = sites.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - prior, 2)).alias("spread"), F.sum(prior * (1 - prior)).alias("noise"), F.sum(F.col("n") * prior * (1 - prior)).alias("all"), F.count("*").alias("sites")
    ).head()
    if not r["n"] or not r["all"]:
        return 1.0
    between = max((r["spread"] - r["noise"]) / r["n"], 0.0)
    within = r["all"] / r["n"]
    return float(min(max(within / between - 1, 1.0), 1e4)) if between > 0 else 1e4


class Sites:
    """Counts by path and host, the global rate and the strengths of both priors."""

    def __init__(self, table: DataFrame, rate: float, host_strength: float, path_strength: float, small: bool):
        self.table, self.rate, self.host_strength, self.path_strength, self.small = table, rate, host_strength, path_strength, small


def sites(evidence: DataFrame, prior: float) -> Sites:
    """evidence: host, path, e (0 to 1).  Grouped twice: by path, then paths by host."""
    paths = written(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("k")), "paths")
    hosts = paths.groupBy(F.col("host").alias("h_host")).agg(F.sum("n").alias("h_n"), F.sum("k").alias("h_k"))
    total = hosts.agg(F.sum("h_n").alias("n"), F.sum("h_k").alias("k")).head()
    rate = float(min(max((total["k"] + prior) / (total["n"] + 1), 1e-6), 1 - 1e-6)) if total["n"] else prior
    m_host = _strength(hosts.select(F.col("h_n").alias("n"), F.col("h_k").alias("k")), F.lit(rate))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    host_rate = (F.col("h_k") + m_host * rate) / (F.col("h_n") + m_host)
    m_path = _strength(both.select("n", "k", host_rate.alias("r")), F.col("r"))
    names = {"host": "site_host", "path": "site_path", "n": "site_n", "k": "site_k", "h_n": "site_hn", "h_k": "site_hk"}
    both = written(both.select(*[F.col(a).alias(b) for a, b in names.items()]), "sites")
    return Sites(both, rate, m_host, m_path, both.count() <= BROADCAST_SITES)


class Evidence:
    """What is known of all documents: the model, its prior, the sites, and `rows`: doc_id, source, lang, digest, doc_odds, good (null without a label)."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        self.model = fit(docs, labels)
        self.prior = self.model.prior if self.model else 1 - 1e-6
        narrow = scored(pick(docs, "doc_id", "source", "lang", "text"), self.model).withColumn("digest", _digest()).drop("text")
        labelled = _labels(labels) if self.model else _labels(labels).limit(0)
        self.rows = written(narrow.join(labelled, F.col("doc_id") == F.col("l_id"), "left").drop("l_id"), "odds")
        share = F.coalesce("good", self.chance())
        self.sites = sites(self.rows.select(F.col("source").alias("host"), F.col("lang").alias("path"), share.alias("e")), self.prior)

    def chance(self) -> Column:
        """That a document is good, by its text alone."""
        base = float(np.log(self.prior / (1 - self.prior)))
        return 1 / (1 + F.exp(-F.coalesce("doc_odds", F.lit(base))))

    def judge(self, rows: DataFrame, mine: Column) -> DataFrame:
        """rows (source, lang, doc_odds, ...) with host_rate, path_rate, score and keep; mine: what a row's site counted for it."""
        s = self.sites
        right = F.broadcast(s.table) if s.small else s.table
        joined = rows.withColumn("own_share", mine).join(right, F.col("source").eqNullSafe(F.col("site_host")) & F.col("lang").eqNullSafe(F.col("site_path")), "left")
        less = lambda c: F.greatest(F.col(c) - F.col("own_share"), F.lit(0.0))
        host = (less("site_hk") + s.host_strength * s.rate) / (F.col("site_hn") - 1 + s.host_strength)
        path = (less("site_k") + s.path_strength * F.col("host_rate")) / (F.col("site_n") - 1 + s.path_strength)
        base = float(np.log(self.prior / (1 - self.prior)))
        odds = F.coalesce(F.col("doc_odds") - base, F.lit(0.0)) + _odds(F.col("path_rate"))
        out = joined.withColumn("host_rate", host).withColumn("path_rate", path).withColumn("score", 1 / (1 + F.exp(-odds)))
        return out.withColumn("keep", F.col("score") >= THRESHOLD if self.model else F.lit(True)).drop("own_share", *_SITE)


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def judgements(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, lang, digest (of the text), doc_odds, host_rate, path_rate, score and keep of every document; texts are read once and aren't shuffled."""
    known = Evidence(docs, labels)
    return known.judge(known.rows, F.coalesce("good", known.chance())).drop("good")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents to keep, with their columns.

    Texts aren't shuffled for the labels' sake: each is judged as if it had none, and only labelled documents
    for which that makes a difference are looked up.  What docs has under the names of judgements() is replaced."""
    known = Evidence(docs, labels)
    plain = known.judge(scored(docs, known.model), known.chance())
    labelled = known.rows.filter("good is not null")
    right = known.judge(labelled, F.col("good")).withColumnRenamed("keep", "right")
    both = known.judge(right.drop("host_rate", "path_rate", "score"), known.chance()).filter("keep <> right")
    other = written(both.select(F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest"), F.col("source").alias("other_source"), F.col("lang").alias("other_lang"), "right").distinct(), "other")
    same = (F.col("doc_id") == F.col("other_id")) & (_digest() == F.col("other_digest")) & F.col("source").eqNullSafe(F.col("other_source")) & F.col("lang").eqNullSafe(F.col("other_lang"))
    return plain.join(other, same, "left").filter(F.coalesce("right", "keep"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with their columns as they were."""
    return sheltered(docs, lambda d: kept(d, table(spark, sf_dir, "labels")))


def query(spark, sf_dir) -> DataFrame:
    out = judgements(pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "doc_odds", "host_rate", "path_rate", "score", "keep")


QUERIES = {"op2_hierarchical_quality": query}
