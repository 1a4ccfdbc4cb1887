"""Column functions over file and route paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file ending.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "php": "php", "vue": "vue",
    "rb": "ruby", "rs": "rust", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sh": "shell", "sql": "sql", "html": "html", "css": "css", "ini": "ini",
}
#: Kinds of source by path, the first that matches.
KINDS = (
    ("generated", r"(^|/)(__generated__|generated|gen|dist|build)/|\.min\.|_pb2?\."),
    ("vendor", r"(^|/)(vendor|third_party|node_modules|bower_components|external)/"),
    ("test", r"(^|/)(tests?|spec|__tests__)/|(^|/)test_|[._](test|spec)\."),
    ("example", r"(^|/)(examples?|samples?|demo)/"),
    ("docs", r"(^|/)docs?/|\.(md|mdx|rst)$"),
    ("ops", r"(^|/)(deploy|ops|infra|helm|\.github)/|(^|/)dockerfile"),
    ("tooling", r"(^|/)(scripts?|tools?|bin)/"),
    ("config", r"(^|/)config/|\.(json|ya?ml|toml|ini|env)$"),
)
#: Kinds that support the product rather than being it, and those least to be trusted.
SUPPORTING = ("test", "example", "docs", "tooling", "ops")
LOW_TRUST = ("generated", "vendor", "test")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: str | Column) -> Column:
    """'' where the ending says nothing."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def source_kind(path: str | Column) -> Column:
    out = None
    for kind, pattern in KINDS:
        hit = F.lower(_c(path)).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("core")


def is_test(path: str | Column) -> Column:
    return F.lower(_c(path)).rlike(dict(KINDS)["test"])


def trust_score(kind: str | Column) -> Column:
    k = _c(kind)
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.when(k.isin(*SUPPORTING), 0.2).when(k.isin("generated", "vendor"), 0.35).otherwise(0.0) - F.when(k.isin(*LOW_TRUST), 0.35).otherwise(0.0))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression: it may match a path, its last name, or any directory of it."""
    body = "".join(".*" if p == "*" else "." if p == "?" else re.escape(p) for p in re.split(r"([*?])", pattern.strip("/")) if p)
    return f"(^|/){body}(/|$)"


def matches_any(path: str | Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return _c(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def normal_route(path: str | Column) -> Column:
    """A route with one '/' between its parts, none at the end, and every parameter as {}."""
    x = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(_c(path), F.lit(""))), r"[?#].*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>/]*>|:[A-Za-z_]\w*|\{[^}/]*\}|\[[^\]/]*\]", "{}"), r"/{2,}", "/")
    return F.when(x == "/", x).otherwise(F.regexp_replace(x, r"/$", ""))


def route_family(path: str | Column) -> Column:
    """The first part of a route that is neither a version, 'api' nor a parameter; 'root' if none."""
    parts = F.filter(F.split(normal_route(path), "/"), lambda p: (p != "") & ~p.rlike(r"^(v\d+|api|\{\})$"))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("root"))
