"""Symbols, imports, calls and routes of source files, by patterns for each language.

A registry maps a language to its patterns; a file whose language has none gives no rows, and one that can't be parsed is skipped. Lines are taken apart
in the JVM; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_array, strip_code_noise

#: Fixed values: (kind, pattern with the name in group 1) of each language; the first that matches a line counts.
SYMBOLS = {
    "python": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")),
    "javascript": (
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
        ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\()"),
    ),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^type\s+(\w+)")),
    "java": (("class", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(")),
    "php": (("class", r"^\s*(?:(?:abstract|final)\s+)?(?:class|interface|trait)\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)")),
}
SYMBOLS["typescript"] = SYMBOLS["javascript"]
#: What a line imports, in group 1.
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "javascript": r"(?:from\s+|require\()\s*['\"]([^'\"]+)['\"]", "typescript": r"(?:from\s+|require\()\s*['\"]([^'\"]+)['\"]", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./\-]+)\"\s*$",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "php": r"^\s*use\s+([\w\\]+)",
}
#: Words before '(' that call nothing.
NOT_CALLS = "if for while switch catch return function def class elif and or not in with except lambda await new throw func print super typeof sizeof assert".split()
#: Fixed values: (framework, languages, pattern with method and path) of route declarations.
_JS = ("javascript", "typescript")
ROUTES = (
    ("fastify", _JS, r"\bfastify\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)['\"`]"), ("nestjs", _JS, r"@(Get|Post|Put|Patch|Delete)\(\s*['\"]?([^'\")]*)['\"]?\s*\)"),
    ("express", _JS, r"\b(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)['\"`]"), ("fastapi", ("python",), r"@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("falcon", ("python",), r"\.(add_route)\(\s*['\"]([^'\"]+)['\"]"), ("django", ("python",), r"\b(re_path|path)\(\s*r?['\"]([^'\"]*)['\"]"), ("laravel", ("php",), r"Route::(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("go", ("go",), r"\.(GET|POST|PUT|PATCH|DELETE|HandleFunc|Handle)\(\s*\"([^\"]+)\""),
)


def _lines(files: DataFrame, keys: list[str], total: str | None = None) -> DataFrame:
    """Lines with their numbers and, as `total`, how many their file has."""
    arrays = files.where("text is not null").select(*keys, "language", line_array("text").alias("_l"))
    extra = [F.size("_l").alias(total)] if total else []
    return arrays.select(*keys, "language", *extra, F.posexplode("_l").alias("_p", "line")).withColumn("line_no", F.col("_p") + 1).drop("_p")


def symbols(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, language, name, kind, start_line, end_line (the line before the next symbol, or the last line), visibility, signature."""
    hit: Column | None = None
    for lang, patterns in SYMBOLS.items():
        one: Column | None = None
        for kind, p in patterns:
            s = F.struct(F.regexp_extract("line", p, 1).alias("name"), F.lit(kind).alias("kind"))
            ok = F.col("line").rlike(p)
            one = F.when(ok, s) if one is None else one.when(ok, s)
        hit = F.when(F.col("language") == lang, one) if hit is None else hit.when(F.col("language") == lang, one)
    # Few lines define anything: a cheap test by the words that all patterns need comes first.
    lines = _lines(files.where(F.col("language").isin(*SYMBOLS)), keys, "_total").where(F.col("line").rlike(r"\b(?:class|def|func|function|interface|type|enum|trait|record|const|public|private|protected|static|final|abstract)\b"))
    found = lines.withColumn("_s", hit).where("_s is not null and _s.name <> ''")
    nxt = F.lead("line_no").over(Window.partitionBy(*keys).orderBy("line_no"))
    private = F.col("name").rlike(r"^_|^#") | F.col("line").rlike(r"\b(private|protected)\b")
    return found.select(*keys, "language", "_s.name", "_s.kind", F.col("line_no").alias("start_line"), F.coalesce(nxt - 1, F.col("_total")).alias("end_line"), "line").select(
        *keys, "language", "name", "kind", "start_line", "end_line", F.when(private, "private").otherwise("public").alias("visibility"), F.regexp_replace(F.trim("line"), r"\s*[{:]\s*$", "").alias("signature")
    )


def imports(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, module: what each file imports, in order."""
    out: Column | None = None
    for lang, p in IMPORTS.items():
        m = F.regexp_extract("line", p, 1)
        m = F.when(m != "", m).otherwise(F.regexp_extract("line", p, 2)) if lang == "python" else m
        out = F.when(F.col("language") == lang, m) if out is None else out.when(F.col("language") == lang, m)
    found = _lines(files, keys).withColumn("module", out).where("module <> ''")
    return found.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")).alias("ordinal"), "module")


def calls(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, callee: every name before '(' outside strings and comments, definitions left out."""
    clean = _lines(files, keys).where(F.col("language").isin(*SYMBOLS)).withColumn("line", strip_code_noise("line")).where(~F.col("line").rlike(r"^\s*(?:async\s+)?(?:def|class|func|function)\b"))
    names = F.filter(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)\s*\("), 1)), lambda n: ~n.isin(*NOT_CALLS))
    return clean.select(*keys, "line_no", F.explode(names).alias("callee"))


def routes(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, framework, method, path of route declarations; a method that isn't named is ANY."""
    hit: Column | None = None
    for framework, languages, p in ROUTES:
        path, m = F.regexp_extract("line", p, 2), F.upper(F.regexp_extract("line", p, 1))
        s = F.struct(F.lit(framework).alias("framework"), F.when(m.isin("GET", "POST", "PUT", "PATCH", "DELETE"), m).otherwise("ANY").alias("method"), path.alias("path"))
        ok = F.col("language").isin(*languages) & F.col("line").rlike(p)
        hit = F.when(ok, s) if hit is None else hit.when(ok, s)
    return _lines(files, keys).withColumn("_r", hit).where("_r is not null").select(*keys, "line_no", "_r.*")


def enclosing(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """symbols with `owner`: the innermost class whose lines hold the symbol's first line, '' if none. A class's own lines must be known (start_line, end_line)."""
    c = symbols.where("kind = 'class'").select(*keys, F.col("name").alias("_o"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    s = symbols.withColumn("_id", F.struct("name", "start_line"))
    inside = s.join(c, keys).where((F.col("_a") < F.col("start_line")) & (F.col("start_line") <= F.col("_b")))
    best = inside.groupBy(*keys, "_id").agg(F.max_by("_o", F.struct("_a", -F.col("_b"))).alias("owner"))
    return s.join(best, [*keys, "_id"], "left").withColumn("owner", F.coalesce("owner", F.lit(""))).drop("_id")


def resolve_calls(found_calls: DataFrame, syms: DataFrame, file: str, links: DataFrame | None = None) -> DataFrame:
    """edges (caller_file, callee_file, callee_symbol, call_kind, n_sites). A call means, in this order: the symbol of its own file; that of the one file it imports that has the name
    (links: file, target, where given); the one symbol of that name anywhere. A name that is left with several files, or none, is external (callee_file '')."""
    sites = found_calls.groupBy(F.col(file).alias("caller_file"), F.col("callee").alias("callee_symbol")).agg(F.count("*").alias("n_sites"))
    defs = syms.select(F.col(file).alias("_f"), F.col("name").alias("callee_symbol")).distinct()
    own = defs.select(F.col("_f").alias("caller_file"), "callee_symbol", F.lit(True).alias("_own"))
    one = defs.groupBy("callee_symbol").agg(F.count("*").alias("_n"), F.min("_f").alias("_any"))
    j = sites.join(own, ["caller_file", "callee_symbol"], "left").join(one, "callee_symbol", "left")
    if links is None:
        j = j.withColumn("_imp", F.lit(None).cast("string"))
    else:
        via = sites.select("caller_file", "callee_symbol").join(links.select(F.col(file).alias("caller_file"), F.col("target").alias("_f")), "caller_file").join(defs, ["_f", "callee_symbol"])
        j = j.join(via.groupBy("caller_file", "callee_symbol").agg(F.when(F.count("*") == 1, F.min("_f")).alias("_imp")), ["caller_file", "callee_symbol"], "left")
    target = F.when(F.col("_own"), F.col("caller_file")).when(F.col("_imp").isNotNull(), F.col("_imp")).when(F.col("_n") == 1, F.col("_any")).otherwise("")
    return j.select("caller_file", target.alias("callee_file"), "callee_symbol", F.when(target == "", "external").otherwise("local").alias("call_kind"), "n_sites")


def resolve_imports(found: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """(file, target): imported modules whose path ends a file's path without its ending. Several fits: the shortest path, then the first. No self-imports."""
    stem = F.regexp_replace(F.col(file), r"\.\w+$", "")
    parts = F.split(stem, "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    by_key = files.select(F.col(file).alias("target"), F.explode(keys).alias("_k"))
    best = by_key.groupBy("_k").agg(F.min_by("target", F.struct(F.char_length("target"), "target")).alias("target"))
    wanted = found.select(file, F.regexp_replace(F.regexp_replace(F.regexp_replace("module", r"^\.+/?", ""), r"\\", "/"), r"\.", "/").alias("_k"))
    return wanted.where("_k <> ''").join(best, "_k").where(F.col("target") != F.col(file)).select(file, "target").distinct()
