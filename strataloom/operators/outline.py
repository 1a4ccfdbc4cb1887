"""Shaping what is known about files, pages and routes into plans: entry points, neighbours, owners, tiers, orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Roles of files by the first part of their path that says one.
ROLES = (("test", "test"), ("route", "route"), ("route", "controller"), ("model", "model"), ("model", "schema"), ("service", "service"), ("worker", "worker"), ("worker", "task"), ("config", "config"), ("util", "util"), ("util", "helper"), ("script", "script"))
#: What answers say that have nothing to say.
ABSTAINS = r"(?i)\b(i (?:don't|do not) know|(?:couldn't|could not|can't|cannot) (?:find|determine|answer)|not enough (?:evidence|information)|no (?:relevant )?(?:evidence|information) (?:was )?found|insufficient (?:evidence|context))\b"
#: Kinds of operational files by the end of their path.
ARTIFACTS = (
    ("setup", r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|package\.json|go\.mod|composer\.json|setup\.(py|cfg)|makefile)$"), ("deploy", r"(^|/)(dockerfile[^/]*|docker-compose[^/]*|helm/.*|deploy/.*|k8s/.*)$"),
    ("ci", r"(^|/)(\.github/.*|\.gitlab-ci\.yml|jenkinsfile)$"), ("test", r"(^|/)(pytest\.ini|tox\.ini|jest\.config\.[jt]s|conftest\.py)$"), ("ops", r"(^|/)(ops/.*|infra/.*|terraform/.*)$"),
)


def first_rule(c: Column, rules: tuple, otherwise: str, test) -> Column:
    """The name of the first (name, rule) that `test` finds to hold."""
    out = None
    for name, rule in rules:
        out = F.when(test(c, rule), name) if out is None else out.when(test(c, rule), name)
    return out.otherwise(otherwise)


def role_of(path: Column) -> Column:
    return first_rule(F.lower(path), ROLES, "module", lambda c, part: F.contains(c, F.lit(part)))


def artifact_kind(path: Column) -> Column:
    """'' for a file that is none."""
    return first_rule(F.lower(path), ARTIFACTS, "", lambda c, p: c.rlike(p))


def truncate_lines(text: Column, most: int, marker: str = "\n[truncated]") -> Column:
    """A text over `most` characters cut at the last line break before, with a mark; without a break it is cut there."""
    head = F.substring(text, 1, most)
    at = F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))
    kept = F.when(at > 0, F.substring(head, F.lit(1), at - 1)).otherwise(head)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(kept, F.lit(marker)))


def semantic_id(files: Column, most: int = 20) -> Column:
    """12 digits of the SHA-1 of the first `most` files in order; the same for the same files however they are listed."""
    return F.substring(F.sha1(F.array_join(F.slice(F.array_sort(F.array_distinct(files)), 1, most), "|").cast("binary")), 1, 12)


def entry_points(nodes: DataFrame, edges: DataFrame, declared: DataFrame, foundational: DataFrame, is_test: Column) -> DataFrame:
    """(node, why): declared nodes, and nodes nothing points to that are neither foundational nor tests."""
    pointed = edges.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    roots = nodes.where(~is_test).join(pointed, "node", "left_anti").join(foundational.select("node"), "node", "left_anti").join(declared.select("node"), "node", "left_anti")
    return declared.select("node").distinct().withColumn("why", F.lit("declared")).unionByName(roots.select("node").distinct().withColumn("why", F.lit("root")))


def capped_callees(edges: DataFrame, most: int = 12) -> DataFrame:
    """(src, n, callees): of each node how many it points to and the first `most` of them; only so many names of a node are gathered."""
    e = edges.select("src", "dst").distinct()
    ranked = e.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= most)
    some = ranked.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    return e.groupBy("src").agg(F.count("*").alias("n")).join(some, "src")


def two_hops(edges: DataFrame) -> DataFrame:
    """(node, n_near, n_far): distinct nodes one step and exactly two steps away. Pairs are as many as there are ways, combined before the shuffle that
    makes them distinct."""
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    near = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_near"))
    two = e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst").distinct()
    far = two.join(e, ["src", "dst"], "left_anti").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_far"))
    return near.join(far, "node", "left").fillna(0, ["n_far"])


def tier_by_majority(rows: DataFrame, group: str, kind: str, supporting: list[str]) -> DataFrame:
    """(group, n_product, n_supporting, tier): 'supporting' where more of a group's rows support the product than are it."""
    s = F.count_if(F.col(kind).isin(supporting))
    return rows.groupBy(group).agg((F.count("*") - s).alias("n_product"), s.alias("n_supporting")).withColumn("tier", F.when(F.col("n_supporting") > F.col("n_product"), "supporting").otherwise("product"))


def reuse_ratio(plans: DataFrame, key: str, files: str, present: DataFrame, file: str, least: float = 0.9) -> DataFrame:
    """(key, n_files, n_present, reusable): a plan may be used again if `least` of its files are still there."""
    each = plans.select(key, F.explode(files).alias(file)).distinct()
    have = each.join(present.select(file).distinct().withColumn("_h", F.lit(1)), file, "left")
    return have.groupBy(key).agg(F.count("*").alias("n_files"), F.count("_h").alias("n_present")).withColumn("reusable", F.col("n_present") >= F.col("n_files") * least)


def corpus_health(rows: DataFrame, part: str, key: str, text: str, expected: DataFrame) -> DataFrame:
    """(part, n_records, n_keys, filled, health) against `expected` (part, n): 'missing', 'unknown', 'count differs', 'repeated keys', 'empty texts' or 'healthy'."""
    g = rows.groupBy(part).agg(F.count("*").alias("n_records"), F.countDistinct(key).alias("n_keys"), F.round(F.avg((F.trim(F.coalesce(text, F.lit(""))) != "").cast("double")), 6).alias("filled"))
    j = g.join(expected.select(part, F.col("n").alias("_e")), part, "full_outer")
    health = F.when(F.col("n_records").isNull(), "missing").when(F.col("_e").isNull(), "unknown").when(F.col("n_records") != F.col("_e"), "count differs").when(F.col("n_keys") < F.col("n_records"), "repeated keys").when(F.col("filled") < 1, "empty texts")
    return j.select(part, F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"), F.coalesce("filled", F.lit(0.0)).alias("filled"), health.otherwise("healthy").alias("health"))


def merge_plans(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new plans (slug, semantic_id, files, confidence) in one: a new plan meets the old one of its slug, else the first of its semantic id; files are united, the lower confidence counts, the old
    slug stays. Old plans that none meets stay as they are."""
    o = old.select(F.col("slug").alias("o_slug"), F.col("semantic_id").alias("o_id"), F.col("files").alias("o_files"), F.col("confidence").alias("o_confidence"))
    by_slug = new.join(o.select(F.col("o_slug").alias("slug"), F.col("o_slug").alias("met")), "slug", "left")
    first = o.groupBy(F.col("o_id").alias("semantic_id")).agg(F.min("o_slug").alias("_by_id"))
    met = by_slug.join(first, "semantic_id", "left").withColumn("met", F.coalesce("met", "_by_id")).drop("_by_id")
    one = met.groupBy(F.coalesce("met", "slug").alias("k")).agg(F.min(F.struct("slug", "semantic_id", "files", "confidence")).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))).alias("n_files"), F.min("confidence").alias("n_conf"))
    j = one.join(o, one["k"] == o["o_slug"], "full_outer")
    files = F.array_sort(F.array_union(F.coalesce("o_files", F.array().cast("array<string>")), F.coalesce("n_files", F.array().cast("array<string>"))))
    return j.select(F.coalesce("o_slug", "k").alias("slug"), F.coalesce("n.semantic_id", "o_id").alias("semantic_id"), files.alias("files"), F.least("o_confidence", "n_conf").alias("confidence"))


def nearest_directory(files: DataFrame, owned: DataFrame, file: str, owner: str) -> DataFrame:
    """(file, owner, depth): for files without an owner that of the deepest directory in which somebody owns a file; of several the one who owns most there, then the first. Directories are looked up by
    equality; files with no owned file above them are left out."""
    def dirs(df: DataFrame, keep: list[str]) -> DataFrame:
        parts = F.split(file, "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
        return df.where(F.contains(F.col(file), F.lit("/"))).select(*keep, F.explode(up).alias("d")).select(*keep, "d.depth", "d.dir")

    votes = dirs(owned, [owner]).groupBy("dir", owner).count()
    best = votes.groupBy("dir").agg(F.min_by(owner, F.struct(-F.col("count"), owner)).alias(owner))
    lone = files.join(owned.select(file).distinct(), file, "left_anti")
    return dirs(lone, [file]).join(best, "dir").groupBy(file).agg(F.max(F.struct("depth", owner)).alias("b")).select(file, f"b.{owner}", "b.depth")


def missing_links(pairs: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """Wanted links (src, dst) between known, different pages (slug) that aren't there yet (src, dst)."""
    known = pages.select("slug").distinct()
    ok = pairs.where("src <> dst").distinct().join(known.withColumnRenamed("slug", "src"), "src", "left_semi").join(known.withColumnRenamed("slug", "dst"), "dst", "left_semi")
    return ok.join(links.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def flatten_json(rows: DataFrame, key: str, text: str, levels: int = 3) -> DataFrame:
    """(key, name, value): the leaves of a JSON object under their dotted names, down to `levels` objects; a deeper object is a leaf."""
    kind = "map<string,string>"
    out, cur = [], rows.select(key, F.explode(F.from_json(text, kind)).alias("name", "value"))
    for _ in range(levels - 1):
        is_object = F.coalesce(F.ltrim("value").startswith("{"), F.lit(False))
        out.append(cur.where(~is_object))
        cur = cur.where(is_object).select(key, F.col("name").alias("_n"), F.explode(F.from_json("value", kind)).alias("m", "value")).select(key, F.concat_ws(".", "_n", "m").alias("name"), "value")
    return reduce(DataFrame.unionByName, [*out, cur])


def merge_settings(layers: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """Of each setting the value of the last layer that has it."""
    return layers.groupBy(name).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def route_claims(pages: DataFrame, page: str, text: str, known: DataFrame) -> DataFrame:
    """(page, method, path): routes that a page names and nobody serves; known: method, path in normal form (see functions.paths.normal_route)."""
    from ..functions.paths import normal_route

    found = F.explode(F.regexp_extract_all(text, F.lit(r"\b((?:GET|POST|PUT|PATCH|DELETE)\s+/[\w\-/{}:.]*)"), 1)).alias("r")
    named = pages.select(F.col(page).alias("page"), found).select("page", F.regexp_extract("r", r"^(\w+)", 1).alias("method"), normal_route(F.regexp_extract("r", r"\s(/\S*)$", 1)).alias("path")).distinct()
    return named.join(known.select("method", "path").distinct(), ["method", "path"], "left_anti").select("page", "method", "path")


def flow_score(n_entries: Column, n_files: Column, n_effects: Column, n_external: Column, n_endpoints: Column) -> Column:
    return n_entries * 2.0 + n_files * 1.5 + n_effects * 2.0 + n_external * 1.0 + n_endpoints * 3.0


def follow_exports(names: DataFrame, exports: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, name, at_file, at_name): where an imported name is defined, through re-exports of any length and renamings. names: file, name, from_file, from_name; exports: file, name, from_file, from_name; definitions: file,
    name. Where a file defines a name itself, that counts. Cycles and dead ends give at_file ''. Each round looks up only names that aren't settled, until no one moves."""
    defs = definitions.select(F.col("file").alias("at_file"), F.col("name").alias("at_name")).distinct()
    hops = cut(exports.select(F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.col("from_file").alias("_f"), F.col("from_name").alias("_n")).dropDuplicates(["at_file", "at_name"]))
    cur = cut(names.select("file", "name", F.col("from_file").alias("at_file"), F.col("from_name").alias("at_name")).withColumn("seen", F.array(F.concat_ws("\0", "at_file", "at_name"))))
    done = []
    while True:
        done.append(cur.join(defs, ["at_file", "at_name"], "left_semi").select("file", "name", "at_file", "at_name"))
        nxt = cur.join(defs, ["at_file", "at_name"], "left_anti").join(hops, ["at_file", "at_name"]).select("file", "name", F.col("_f").alias("at_file"), F.col("_n").alias("at_name"), "seen")
        step = F.concat_ws("\0", "at_file", "at_name")
        cur = cut(nxt.where(~F.array_contains("seen", step)).withColumn("seen", F.array_append("seen", step)))
        if cur.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    lost = names.select("file", "name").join(found, ["file", "name"], "left_anti").withColumns({"at_file": F.lit(""), "at_name": F.col("name")})
    return found.unionByName(lost)


def resolve_members(sites: DataFrame, methods: DataFrame, ancestors: DataFrame, bindings: DataFrame) -> DataFrame:
    """(site, owner, method): calls receiver.method resolved. sites: site, file, cls (the class around it, '' if none), receiver, method; methods: cls, method; ancestors: cls, ancestor, distance (a class and all above it,
    itself at 0); bindings: file, receiver, cls (what an imported or local name stands for). self, cls and this mean the class around; super the classes above it. The nearest class that has the method counts, '' if none
    has."""
    own = F.col("receiver").isin("self", "cls", "this")
    bound = sites.join(bindings.withColumnRenamed("cls", "_bound"), ["file", "receiver"], "left")
    start = bound.withColumn("_from", F.when(own | (F.col("receiver") == "super"), F.col("cls")).otherwise(F.col("_bound")))
    up = start.join(ancestors.select(F.col("cls").alias("_from"), "ancestor", "distance"), "_from").where((F.col("receiver") != "super") | (F.col("distance") > 0))
    hit = up.join(methods.select(F.col("cls").alias("ancestor"), "method"), ["ancestor", "method"]).groupBy("site").agg(F.min(F.struct("distance", "ancestor")).alias("b"))
    return sites.select("site", "method").join(hit.select("site", F.col("b.ancestor").alias("owner")), "site", "left").select("site", F.coalesce("owner", F.lit("")).alias("owner"), "method")
