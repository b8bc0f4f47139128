"""Crawling directories, and the tables an index is made of."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, store
from . import chunks, extract, shared

SKIP_DIRECTORIES = [".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "target"]
SKIP_FILES = ["package-lock.json", "yarn.lock", "go.sum"]
MAX_FILE_BYTES = 1 << 20
#: Up to so many named files are opened one by one; of more, those found under the root are taken.
NAMED = 10_000


@dataclass
class Options:
    languages: str = "all"
    ignore: list[str] = field(default_factory=list)
    max_file_bytes: int = MAX_FILE_BYTES
    max_chunk_bytes: int = chunks.MAX_BYTES
    skip_directories: list[str] = field(default_factory=lambda: list(SKIP_DIRECTORIES))
    skip_files: list[str] = field(default_factory=lambda: list(SKIP_FILES))
    #: Cards take as much room as what they are made of; QUARRY_CARDS=0 leaves them out where nothing else is said.
    cards: bool = field(default_factory=lambda: os.environ.get("QUARRY_CARDS", "1") != "0")


def is_text(content) -> F.Column:
    """Of the first 8,192 bytes none is NUL and under 30 % are control bytes."""
    sample = F.hex(F.substring(content, 1, 8192))
    pairs = F.regexp_replace(sample, "(..)", "$1 ")
    control = F.regexp_count(pairs, F.lit(r"0[1-8] |0[EF] |1[0-9A-F] "))
    return ~pairs.rlike(r"(^| )00 ") & (control * 100 < 30 * F.greatest(F.least(F.octet_length(content), F.lit(8192)), F.lit(1)))


def _found(spark: SparkSession, root: str, o: Options, only: list[str] | None = None) -> DataFrame:
    """path (relative), language, content (bytes), size, mtime of the files that names and sizes let through.  Files that are named are the only ones opened."""
    home = root.split("://", 1)[-1].rstrip("/") + "/"
    many = only is not None and len(only) > NAMED
    if only is None or many:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    else:
        there = [p for p in only if shared.there(spark, f"{root.rstrip('/')}/{p}")]
        open_ = [f"{root.rstrip('/')}/{re.sub(r'[][{}*?,^]', '?', p)}" for p in there]  # which may match others, too
        files = spark.read.format("binaryFile").load(open_) if open_ else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    rel = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), home, -1)
    f = files.filter(F.col("length") <= o.max_file_bytes).select(rel.alias("path"), "content", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    f = f.filter(~store.skipped(F.col("path"), F.col("size"), o.skip_directories, o.skip_files, o.max_file_bytes))
    if many:
        f = f.join(spark.createDataFrame([(p,) for p in only], "path string").distinct(), "path", "left_semi")
    elif only is not None:
        f = f.filter(F.col("path").isin(there))
    if o.ignore:
        f = f.filter(~store.ignored(F.col("path"), o.ignore))
    f = f.withColumn("language", text.path_language(F.col("path")))
    wanted = text.language_filter(o.languages)
    return f.filter(F.col("language").isin(sorted(wanted)) if wanted else F.col("language") != "")


def listed(spark: SparkSession, root: str, options: Options | None = None) -> DataFrame:
    """S01 without contents: path, language, size, mtime.  Whether a file is text shows only when it is read."""
    return _found(spark, root, options or Options()).drop("content")


def crawl(spark: SparkSession, root: str, options: Options | None = None, only: list[str] | None = None) -> DataFrame:
    """Path (relative), language, content, size, mtime.  Sizes and names are judged before contents are read.

    only: paths to read, nothing else is opened; those that aren't there are left out."""
    f = _found(spark, root, options or Options(), only)
    return f.filter(is_text(F.col("content"))).withColumn("content", F.decode("content", "UTF-8"))


def context_load(files: DataFrame, most: int = 2 << 20) -> DataFrame:
    """Path, content, taken: files by path until `most` bytes are reached; of the last one only what fits counts as taken.  Paths are unique.

    Files without bytes are left out, so the running sum never sees more than `most` rows, of paths and sizes only; contents are joined to the few
    that are taken."""
    sized = files.select("path", F.octet_length("content").alias("size")).filter("size > 0").orderBy("path").limit(most)
    before = F.sum("size").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    fits = sized.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most)
    taken = fits.select("path", F.least(F.col("size"), most - F.col("before")).cast("bigint").alias("taken"))
    return files.select("path", "content").join(taken, "path").select("path", "content", "taken")


def vocabulary(loaded: DataFrame) -> DataFrame:
    """The distinct words of 4 to 19 bytes."""
    return loaded.select(F.explode(F.regexp_extract_all("content", F.lit("(?<![A-Za-z0-9_])([A-Za-z0-9_]{4,19})(?![A-Za-z0-9_])"), F.lit(1))).alias("word")).distinct()


def forbidden_lines(files: DataFrame, patterns: list[tuple[str, str]], most: int = 2 << 20) -> DataFrame:
    """Path, line, label, found: lines of texts of at most `most` bytes, without NUL bytes, that match a pattern; label, pattern of each."""
    some = files.filter((F.octet_length("content") <= most) & ~F.contains(F.substring("content", 1, 2048), F.lit("\0")))
    lines = some.select("path", F.posexplode(F.split("content", "\n")).alias("at", "found"))
    labels = F.array_compact(F.array(*[F.when(F.col("found").rlike(p), F.lit(name)) for name, p in patterns]))
    return lines.select("path", (F.col("at") + 1).alias("line"), F.explode(labels).alias("label"), F.trim("found").alias("found"))


def ignore_patterns(lines: str) -> list[str]:
    return [x.strip() for x in lines.splitlines() if x.strip() and not x.strip().startswith("#")]


def changed_files(root: str, since: str | None = None) -> list[str]:
    """On the driver."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True, timeout=60).stdout.splitlines()
    found = run("diff", "--name-only", since or "HEAD") + ([] if since else run("ls-files", "--others", "--exclude-standard"))
    return list(dict.fromkeys(found))


def recent_files(root: str, commits: int = 50, most: int = 20) -> list[tuple[str, float]]:
    """0.05 for the latest file, less by rank, not under 0.005."""
    out = subprocess.run(["git", "-C", root, "log", f"-{commits}", "--name-only", "--pretty=format:"], capture_output=True, text=True, timeout=60).stdout
    return [(p, max(0.05 / (k + 1), 0.005)) for k, p in enumerate(list(dict.fromkeys(filter(None, out.splitlines())))[:most])]


@dataclass
class Index:
    """The tables of a corpus memory."""

    files: DataFrame
    knowledge: DataFrame
    symbols: DataFrame
    references: DataFrame
    imports: DataFrame
    cards: DataFrame
    home: str | None = None  # H14: the folder that it was opened from

    TABLES = ("files", "knowledge", "symbols", "references", "imports", "cards")

    def save(self, path: str) -> None:
        for t in self.TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in cls.TABLES], home=path)

    def stats(self) -> DataFrame:
        """A01."""
        return store.row_counts({t: getattr(self, t) for t in self.TABLES})


def build(files: DataFrame, options: Options | None = None) -> Index:
    """Every table of these files; imports are resolved once, against all of them."""
    o = options or Options()
    knowledge = chunks.chunk(files, o.max_chunk_bytes).join(files.select("path", F.col("mtime").alias("source_mtime")), "path")
    s, r = extract.symbol_table(files), extract.reference_table(files)
    i = resolved(extract.import_table(files), files)
    cards = extract.cards(files, s, r, i)
    return Index(files.select("path", "language", "size", "mtime"), knowledge, s, r, i, cards if o.cards else cards.limit(0))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with target_path, among these files; the candidates stay, to be resolved again when files come and go."""
    raw = imports.drop("target_path")
    edges = raw.select("path", "line", "import_path", "candidates")
    numbered = edges.select(F.concat_ws("\0", "path", "import_path").alias("edge"), "path", "line", "candidates")
    targets = graph.resolve_imports(numbered, files.select("path"), "edge").select("edge", "line", "target_path").distinct()
    keyed = raw.withColumn("edge", F.concat_ws("\0", "path", "import_path"))
    return keyed.join(targets, ["edge", "line"], "left").drop("edge").withColumn("target_path", F.coalesce("target_path", F.lit("")))


def refresh(old: Index, files: DataFrame, options: Options | None = None) -> Index:
    """Only new and changed files are read again; vanished ones go.  All imports, those of files that stay too, are resolved against all current files.

    Nothing is done where not one indexed path is left, as when the folder isn't there."""
    if not old.files.join(files.select("path"), "path", "left_semi").limit(1).count() and old.files.limit(1).count():
        return old
    diff = store.snapshot_diff(old.files, files.select("path", "mtime"), "path", "mtime")
    stale = diff.filter("status in ('new', 'changed')").select("path")
    gone = diff.filter("status <> 'same'").select("path")
    fresh = build(files.join(stale, "path", "left_semi"), options)
    merged = [getattr(old, t).join(gone, "path", "left_anti").unionByName(getattr(fresh, t), allowMissingColumns=True) for t in Index.TABLES]
    named = dict(zip(Index.TABLES, merged))
    named["imports"] = resolved(named["imports"], named["files"])
    return Index(**named)
