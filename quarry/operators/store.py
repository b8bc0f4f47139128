"""Tables of the corpus memory: merges, diffs, counts, ignore rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def language_counts(df: DataFrame) -> DataFrame:
    """A02, ordered by count, then language."""
    return df.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Key, status: new, changed, deleted or same."""
    a = old.select(F.col(key).alias("old_key"), F.col(stamp).alias("old_stamp"))
    b = new.select(F.col(key).alias("new_key"), F.col(stamp).alias("new_stamp"))
    status = F.when(F.col("old_key").isNull(), "new").when(F.col("new_key").isNull(), "deleted").when(~F.col("old_stamp").eqNullSafe(F.col("new_stamp")), "changed").otherwise("same")
    return a.join(b, F.col("old_key") == F.col("new_key"), "full_outer").select(F.coalesce("old_key", "new_key").alias(key), status.alias("status"))


def replace_by_path(old: DataFrame, new: DataFrame, key: str = "path", keep_vanished: bool = False) -> DataFrame:
    """Rows of new, and with keep_vanished those of old whose path new lacks."""
    if not keep_vanished:
        return new
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def without(df: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """The rows whose path isn't among those that go; rows without a path stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def newest_stamp(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """A04."""
    return df.groupBy(key).agg(F.max(stamp).alias(stamp))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, n."""
    return reduce(DataFrame.unionAll, [t.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, t in tables.items()])


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """With each of these columns; those that were not there are null, of the type that is named."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in df.columns})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str = "content_hash") -> DataFrame:
    """New rows win; `changed` says whether the hash differs from before."""
    tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    before = F.max(F.when(F.col("_new") == 0, F.col(stamp))).over(Window.partitionBy(*keys))
    return tagged.withColumn("_nth", F.row_number().over(w)).withColumn("changed", (F.col("_new") == 1) & ~before.eqNullSafe(F.col(stamp))).filter("_nth = 1").drop("_new", "_nth")


def glob_pattern(glob: str) -> str:
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob)
    return f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """name/ is a directory anywhere; a bare name any part; a path a prefix; * and ? make a glob of the whole path or its last part."""
    out = F.lit(False)
    parts = F.split(path, "/")
    for p in patterns:
        p = p.strip().removeprefix("./").removeprefix("/")
        if not p or p.startswith("#"):
            continue
        if p.endswith("/"):
            out = out | F.contains(F.concat(F.lit("/"), path), F.lit(f"/{p}"))
        elif "*" in p or "?" in p:
            out = out | (path if "/" in p else F.element_at(parts, -1)).rlike(glob_pattern(p))
        elif "/" in p:
            out = out | (path == p) | path.startswith(p + "/")
        else:
            out = out | F.array_contains(parts, p)
    return out


def skipped(path: Column, size: Column, directories: list[str], names: list[str], most: int) -> Column:
    """By directory, file name or size."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in directories])) | F.element_at(parts, -1).isin(names) | (size > most)
