"""Search over symbols, references, imports and cards; exact identifiers; types a text depends on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .retrieval import top_k

#: Kind of row: (column, points where it holds a token); the first column that does counts, and the first column scores `exact` if it is the token.
SYMBOL_POINTS = [("name", 6), ("path", 3), ("signature", 2), ("docstring", 1)]
REFERENCE_POINTS = [("name", 6), ("path", 3), ("context", 2)]
IMPORT_POINTS = [("import_path", 6), ("alias", 5), ("path", 3), ("target_path", 3), ("context", 1)]
EXACT = 10


def points(row_columns: list[tuple[str, int]], token: Column, exact: int = EXACT) -> Column:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    first = row_columns[0][0]
    out = F.when(low(first) == token, exact)
    for c, p in row_columns:
        out = out.when(F.contains(low(c), token), p)
    return out.otherwise(0)


def search(rows: DataFrame, queries: DataFrame, columns: list[tuple[str, int]], limit: int = 20) -> DataFrame:
    """By query the `limit` best rows; points of all its tokens add up; ties by path and line.

    A row can hold a token only if it holds each three characters of it (two of a shorter one), so rows and tokens
    meet by the rarest such piece of the token, and containment is tested after."""
    q = queries.select("query_id", F.slice(text.identifier_tokens(F.col("text")), 1, 16).alias("tokens"))
    asked = q.select("query_id", F.explode("tokens").alias("token")).distinct()
    pieces = lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
    cut = asked.select("query_id", "token", F.explode(F.array_distinct(pieces(F.col("token")))).alias("piece"))
    low = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c, _ in columns])
    grams = lambda n: F.flatten(F.transform(low, lambda x: F.when(F.length(x) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n))))))
    own = rows.withColumn("row_no", F.monotonically_increasing_id())
    held = rows.select(F.explode(F.array_distinct(F.concat(grams(2), grams(3)))).alias("piece"))
    df = held.join(cut.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("df"))
    keyed = cut.join(df, "piece").groupBy("query_id", "token").agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"))  # a token without a piece is in no row
    met = own.withColumn("piece", F.explode(F.array_distinct(F.concat(grams(2), grams(3))))).join(keyed, "piece")
    hit = met.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.col("token")) for c, _ in columns]))
    one = F.first(F.struct(*rows.columns)).alias("r")
    scored = hit.withColumn("score", points(columns, F.col("token"))).groupBy("query_id", "row_no").agg(F.sum("score").alias("score"), one)
    return top_k(scored.select("query_id", "r.*", F.col("score").cast("int").alias("score")), limit, F.desc("score"), F.asc("path"), F.asc("line"), F.asc(columns[0][0]))


#: What a token in a column counts for.
SYMBOL_FIELDS = {"name": 8.0, "kind": 1.0, "signature": 4.0, "path": 1.0, "docstring": 2.0}


def field_hits(rows: DataFrame, queries: DataFrame, weights: dict[str, float], limit: int = 20, ties: tuple[str, ...] = ("path", "line")) -> DataFrame:
    """By query the `limit` best rows by the weighted number of its tokens in each column."""
    weighed = lambda w: lambda t: F.struct(t.alias("token"), F.lit(float(w)).alias("w"))
    bag = F.concat(*[F.transform(text.tokens(F.col(c)), weighed(w)) for c, w in weights.items()])
    asked = queries.select("query_id", F.explode(text.primary_tokens(F.col("text"))).alias("token"))
    held = rows.select(*ties, F.explode(bag).alias("x")).select(*ties, "x.token", "x.w").groupBy(*ties, "token").agg(F.sum("w").alias("w"))
    return top_k(held.join(asked, "token").groupBy("query_id", *ties).agg(F.sum("w").alias("score")), limit, F.desc("score"), *[F.asc(c) for c in ties])


def prefix_query(tokens: Column) -> Column:
    """The tokens as a search for what begins with any of them."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit("*"))), " OR ")


def prefix_hits(rows: DataFrame, queries: DataFrame, most: int = 24) -> DataFrame:
    """P06.  rows: id, text; queries: query_id, text: query_id, id, tokens (of the row that begin with one of the query's), by the beginnings of tokens up to `most` characters."""
    begins = lambda t: F.transform(F.sequence(F.lit(2), F.least(F.length(t), F.lit(most))), lambda n: F.substring(t, F.lit(1), n))
    held = rows.select("id", F.explode(text.primary_tokens(F.col("text"))).alias("token")).select("id", "token", F.explode(begins(F.col("token"))).alias("begin"))
    asked = queries.select("query_id", F.explode(text.primary_tokens(F.col("text"))).alias("begin"))
    return held.join(asked, "begin").groupBy("query_id", "id").agg(F.count_distinct("token").alias("tokens"))


def search_cards(cards: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Weight + .08 for each query token among the card's own, + .05 for symbols and tests."""
    q = queries.select("query_id", F.explode(text.identifier_tokens(F.col("text"))).alias("token"))
    c = cards.withColumn("tokens", F.array_distinct(text.identifier_bag(F.concat_ws(" ", "name", "path", "summary"))))
    hits = c.select("kind", "name", "path", "line", F.explode("tokens").alias("token")).join(q, "token").groupBy("query_id", "kind", "name", "path", "line").agg(F.count("*").alias("hits"))
    weight = F.create_map(*[F.lit(x) for kv in fixed.CARD_WEIGHTS.items() for x in kv])
    score = F.try_element_at(weight, F.col("kind")) + 0.08 * F.col("hits") + F.when(F.col("kind").isin("symbol", "test"), 0.05).otherwise(0.0)
    return top_k(hits.withColumn("score", F.round(score, 6)), limit, F.desc("score"), F.asc("path"), F.asc("line"), F.asc("name"), F.asc("kind"))


def exact_identifiers(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """for import-like queries, the candidates' share of the query's identifiers, rarer ones more, scaled to the best."""
    w = Window.partitionBy("query_id")
    q = queries.filter(text.has_import_context(F.col("text"))).select("query_id", text.drop_low_signal(text.identifier_tokens(F.col("text"))).alias("names"))
    held = candidates.select("query_id", "id", text.identifier_bag(F.col("text")).alias("bag")).join(q, "query_id").select("query_id", "id", F.array_intersect("names", "bag").alias("held"))
    c = held.withColumn("n", F.count("*").over(w)).select("query_id", "id", "n", F.explode("held").alias("token"))  # of a text only what the query names is moved
    j = c.withColumn("df", F.count("*").over(Window.partitionBy("query_id", "token")))
    raw = j.groupBy("query_id", "id").agg(F.sum(F.log(1 + (F.col("n") + 1) / (F.col("df") + 1))).alias("raw"))
    return raw.withColumn("boost", fixed.EXACT_SCALE * F.col("raw") / F.max("raw").over(w)).drop("raw")


def mentioned_types(texts: DataFrame) -> DataFrame:
    """Id, name of PascalCase words over two letters that aren't common acronyms."""
    common = ["API", "CSS", "CSV", "HTML", "HTTP", "HTTPS", "JSON", "SQL", "TODO", "URL", "UUID", "XML", "True", "False", "None"]
    t = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9]{2,})"), F.lit(1)))).alias("name"))
    return t.filter(~F.col("name").isin(common))


def dependent_types(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Id, path, name, depth: types that a text names, and the types that their own signatures name."""
    types = symbols.filter(F.col("kind").isin("class", "type", "interface"))
    first = mentioned_types(texts).join(types.select("name", "path", "signature"), "name")
    named = first.select("id", "path", "name", F.lit(1).alias("depth"))
    again = mentioned_types(first.select("id", F.col("signature").alias("text"))).join(types.select("name", "path"), "name").select("id", "path", "name", F.lit(2).alias("depth"))
    return named.unionAll(again).groupBy("id", "path", "name").agg(F.min("depth").alias("depth"))
