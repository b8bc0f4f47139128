"""Column builders over code: plans, gates, focus, priors, completion scores, benchmark features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text

_EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def first_list(*lists: Column) -> Column:
    """The first that isn't empty."""
    out = lists[-1]
    for x in reversed(lists[:-1]):
        out = F.when(F.size(x) > 0, x).otherwise(out)
    return out


def merged(*lists: Column) -> Column:
    """Order kept, first occurrences."""
    return F.array_distinct(F.concat(*lists))


def code_tokens(prompt: Column) -> Column:
    """identifier tokens that carry meaning."""
    return F.filter(text.identifier_tokens(prompt), text.meaningful)


def plan(prompt: Column) -> Column:
    """struct fts (at most 32), ranking (48), structured (24 as a text).  Prose is widened by synonyms, code is not."""
    primary, parts, code = text.primary_tokens(prompt), text.identifier_tokens(prompt), code_tokens(prompt)
    prose = (F.size(code) == 0) | ~text.looks_like_code(prompt)
    ranking = F.when(prose, text.expand_synonyms(merged(primary, parts))).otherwise(first_list(merged(code, text.drop_low_signal(parts)), primary, parts))
    fts = F.when(prose, text.expand_synonyms(primary)).otherwise(first_list(merged(text.drop_low_signal(primary), code), primary))
    return F.struct(F.slice(fts, 1, 32).alias("fts"), F.slice(ranking, 1, 48).alias("ranking"), F.array_join(F.slice(ranking, 1, 24), " ").alias("structured"))


def detected_language(prompt: Column) -> Column:
    """The first word that names a language; '' without."""
    named = sorted({*fixed.LANGUAGE_ALIASES.values(), *" ".join(fixed.LANGUAGE_GROUPS.values()).split()} - {"c", "r", "m"})
    words = F.transform(F.filter(F.split(F.lower(prompt), r"[^a-z0-9+#]+"), lambda w: w != ""), text.language)
    return F.coalesce(F.get(F.filter(words, lambda w: w.isin(named)), F.lit(0)), F.lit(""))


def without_language(tokens: Column, language: Column) -> Column:
    """Words that only name the detected language go, unless nothing else is left."""
    kept = F.filter(tokens, lambda t: text.language(t) != language)
    return F.when((language != "") & (F.size(kept) > 0), kept).otherwise(tokens)


def import_lines(prompt: Column) -> Column:
    """P12."""
    return F.size(F.filter(text.lines_of(prompt), lambda x: reduce(lambda a, s: a | x.startswith(s), fixed.IMPORT_STARTS, F.lit(False))))


def allows_structural_rerank(prompt: Column) -> Column:
    """One line that isn't code."""
    return ~text.looks_like_code(prompt) & (F.size(text.lines_of(prompt)) <= 1)


def suffix_match(a: Column, b: Column) -> Column:
    """One path is the other's tail, at a segment."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def extra_tokens(tokens: Column, primary: Column) -> Column:
    """Distinct tokens that aren't primary ones."""
    return F.array_except(tokens, primary)


def widens(tokens: Column, primary: Column) -> Column:
    """Whether a query path brings a token of meaning that the primary ones lack."""
    return F.exists(extra_tokens(tokens, primary), text.meaningful)


def resolvable(language: Column, target: Column) -> Column:
    """Whether an import may name a file of the corpus: relative ones do, else it's a question of the language's marks."""
    t, l = F.trim(target), text.language(language)
    slash = F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\"))
    named = F.when(l == "py", True).when(l.isin(fixed.SLASH_IMPORTS), slash).when(l == "go", F.contains(t, F.lit("/"))).when(l.isin(fixed.DOT_IMPORTS), F.contains(t, F.lit(".")))
    named = named.when(l == "rs", F.contains(t, F.lit("::")) | t.rlike("^(crate|self|super)")).otherwise(slash | F.contains(t, F.lit(".")))
    return F.when(t == "", False).otherwise(t.rlike("^(\\.|/|@/)") | named)


def local_import(target: Column) -> Column:
    """Begins with a dot, or has a path's or package's separator."""
    t = F.trim(target)
    return (t != "") & t.rlike(r"^\.|/|\\|\.")


def has_references(language: Column) -> Column:
    """P18."""
    return text.language(language).isin(fixed.WITH_REFERENCES)


def has_imports(language: Column) -> Column:
    """P18."""
    return text.language(language).isin(fixed.WITH_IMPORTS)


def is_config_path(path: Column) -> Column:
    """P19."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return low.rlike(r"/configs?/|(config|settings)[^/]*$|\.(toml|yaml|yml|json|env)$")


def profile_routes(profile: str, prompt: Column, language: Column) -> tuple[Column, Column]:
    """Whether the rank profile's language-symbol part, and its cards part, may act on this query."""
    name = profile.strip().lower().replace("_", "-")
    intent = text.query_intent(prompt)
    symbols = F.lit(name in ("language-symbol", "language-symbol-cards")) & ~((language == "java") & (intent == "declaration"))
    return symbols, F.lit(name == "language-symbol-cards") & language.isin("java", "py") & intent.isin("call", "import")


def last_lines(code: Column, n: int = 3) -> Column:
    """H16."""
    lines = F.split(F.regexp_replace(code, r"\n$", ""), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def completion_query(imports: Column, code: Column) -> Column:
    """Imports, then the last lines."""
    return F.trim(F.concat(F.coalesce(imports, F.lit("")), F.lit("\n"), last_lines(code)), F.lit(" \n\t"))


def candidate_text(language: Column, path: Column, identifier: Column, snippet: Column) -> Column:
    """A snippet under comments that name its path and identifier."""
    mark = F.when(language == "python", "#").otherwise("//")
    return F.concat(mark, F.lit(" Path: "), path, F.lit("\n"), mark, F.lit(" Identifier: "), identifier, F.lit("\n"), F.regexp_replace(snippet, r"\s+$", ""), F.lit("\n"))


def path_number(path: Column) -> Column:
    """The number that ends a file's stem, null without."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")
    return F.nullif(F.regexp_extract(stem, r"([0-9]+)$", 1), F.lit("")).cast("bigint")


def safe_parts(path: Column) -> Column:
    """A path's parts without roots, drives and steps up, odd characters as underscores."""
    kept = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: ~p.isin("", ".", "..", "\\") & ~p.endswith(":"))
    clean = F.transform(kept, lambda p: F.regexp_replace(F.regexp_replace(p, "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""))
    return F.filter(clean, lambda p: p != "")


def focus(content: Column, first_line: Column, center: Column, radius: int) -> Column:
    """struct text, start_line, end_line of the lines about `center`, within the chunk."""
    lines = F.split(content, "\n")
    at = F.least(F.greatest(center - first_line + 1, F.lit(1)), F.size(lines))
    low = F.greatest(at - radius, F.lit(1))
    high = F.least(at + radius, F.size(lines))
    return F.struct(F.array_join(F.slice(lines, low, high - low + 1), "\n").alias("text"), (first_line + low - 1).alias("start_line"), (first_line + high - 1).alias("end_line"))


def bracket_prior(content: Column) -> Column:
    """10 for each closing bracket without an opening one before, 5 for each left over."""
    marks = F.split(F.regexp_replace(content, r"[^\[\](){}]", ""), "")
    step = lambda s, c: F.struct((s["n"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("n"), (s["p"] + F.when(c.isin(")", "]", "}") & (s["n"] <= 0), 10.0).otherwise(0.0)).alias("p"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("p")), step, lambda s: s["p"] + 5.0 * F.abs(s["n"]))


def shell_quoted(arg: Column) -> Column:
    """F26."""
    return F.when(arg.rlike(r"^[A-Za-z0-9_./:@%+=,-]+$"), arg).otherwise(F.concat(F.lit("'"), F.regexp_replace(arg, "'", "'\\\\''"), F.lit("'")))


def first_completion_line(said: Column) -> Column:
    """the first line that is neither empty nor a fence."""
    return F.coalesce(F.get(F.filter(F.split(said, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("```")), F.lit(0)), F.lit(""))


def imported_names(context: Column) -> Column:
    """Names that an import line brings in, with their aliases."""
    listed = F.coalesce(F.nullif(F.regexp_extract(context, r"^\s*from\s+\S+\s+import\s+(.+)", 1), F.lit("")), F.nullif(F.regexp_extract(context, r"^\s*(?:import|export)\s+(.+?)\s+from\s", 1), F.lit("")), F.regexp_extract(context, r"^\s*(?:const|let|var)\s+(.+?)\s*=\s*require", 1))
    return F.array_distinct(F.filter(F.regexp_extract_all(listed, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda n: ~n.isin("as", "type", "default")))


def features(query: Column, candidate: Column) -> Column:
    """coverages of the query by a candidate: all, its last line, calls, assignment targets, imports, declarations; and densities."""
    lines = text.lines_of(query)
    last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
    own = text.identifier_tokens(candidate)
    names = lambda pattern, of: F.transform(F.regexp_extract_all(of, F.lit(pattern), F.lit(1)), F.lower)
    calls, targets = names(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", query), names(r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=[^=]", query)
    declared = names(r"(?m)^\s*(?:class|def|func|function|type)\s+([A-Za-z_][A-Za-z0-9_]*)", candidate)
    imports = F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(r"^(from|import)\s")), imported_names))
    low = F.transform(imports, F.lower)
    return F.struct(
        text.coverage(text.identifier_tokens(query), own).alias("all"), text.coverage(text.identifier_tokens(last), own).alias("last_line"), text.coverage(calls, own).alias("calls"), text.coverage(targets, own).alias("targets"),
        text.coverage(low, own).alias("imports"), text.coverage(text.identifier_tokens(query), declared).alias("declarations"), (F.size(declared) / F.greatest(F.size(text.lines_of(candidate)), F.lit(1))).alias("declaration_density"),
        (F.size(own) / F.greatest(F.size(text.identifier_tokens(candidate, False)), F.lit(1))).alias("variety"),
    )
