"""URL filter: stated host/path rules first, then a path-template tree per host judged by labelled purity.

DataFrame functions only. Level by level, a path segment becomes ``*`` where it
looks like an id (digits, perhaps with an extension) or where its parent has a
wide fan-out and the segment a small share of it; literal siblings whose
labelled rates do not differ significantly from their pooled rate are merged;
a template is rejected when its bad rate, shrunk to its host's and that to the
global one, reaches the threshold. All statistics are aggregates over (host,
prefix, segment) with map-side combine, so a host with a third of all pages is
no hot task. The levels go on until no path has a segment left; paths under a
node of few urls, and templates that are alone, are finished in one expression,
so a deep path does not cost a round per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

#: A parent with more distinct segments than this is wide ...
WIDE = 20
#: ... and a segment of it with less than 1 / NARROW of its urls is variable.
NARROW = 50
#: Square of the normal quantile within which a sibling's rate counts as the pooled one.
SAME_RATE = 3.84
#: Pseudo-counts of the shrinkage, and the bad rate from which a template is rejected.
STRENGTH = 20.0
REJECT = 0.5

#: The rules of the contract.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A segment that looks like an id.
ID_LIKE = r"^[0-9]+(\.[a-z0-9]+)?$"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without one."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null: none); the first of the alphabet among equally long ones."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(sorted(rules, key=lambda r: r[1], reverse=True), key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def templates(urls: DataFrame, store: Store) -> DataFrame:
    """(host, path, n, bad, labelled, template) for distinct (host, path) with counts, before merging."""
    rows = urls.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    rows, done, level = store.save(rows, "level0"), None, 0
    while True:
        # under a node of few urls no segment can be rare, so its paths are finished at once
        few = rows.groupBy("host", "template").agg(F.sum("n").alias("total")).filter(F.col("total") <= NARROW).select("host", "template", F.lit(True).alias("few"))
        rest = F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0)))
        tail = F.array_join(F.transform(rest, lambda s: F.when(s.rlike(ID_LIKE), "/*").otherwise(F.concat(F.lit("/"), s))), "")
        split = rows.join(few, ["host", "template"], "left").withColumn("few", F.coalesce("few", F.lit(False)) | (F.size("segments") <= level))
        split = store.save(split, f"split{level}")
        ended = split.filter("few").withColumn("template", F.concat("template", tail)).drop("segments", "few")
        done = ended if done is None else done.unionAll(ended)
        store.drop(rows)
        rows = split.filter("NOT few").drop("few")
        if rows.isEmpty():
            return store.save(done, "templates")
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        nodes = rows.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"))
        wide = (nodes.groupBy("host", "template").agg(F.sum("n").alias("total"), F.count("*").alias("children"))
                .filter(F.col("children") > WIDE).select("host", "template", "total"))
        rare = (nodes.join(wide, ["host", "template"]).filter(F.col("n") * NARROW < F.col("total"))
                .select("host", "template", "segment", F.lit(True).alias("rare")))
        shown = (F.when(F.coalesce("rare", F.lit(False)) | F.col("segment").rlike(ID_LIKE), "/*")
                 .otherwise(F.concat(F.lit("/"), "segment")))
        rows = (rows.join(rare, ["host", "template", "segment"], "left")
                .withColumn("template", F.concat("template", shown)).drop("segment", "rare"))
        level += 1
        rows = store.save(rows, f"level{level}")


def merged(stats: DataFrame, store: Store) -> DataFrame:
    """(host, template, merged) from (host, template, bad, labelled): similar siblings share a wildcard."""
    # templates of one host merge only with those of as many segments; one alone merges with itself on every level
    size = F.size(F.split("template", "/"))
    alone = stats.groupBy("host", size.alias("size")).agg(F.count("*").alias("k")).filter("k = 1").select("host", "size", F.lit(True).alias("alone"))
    rows = store.save(stats.withColumn("size", size).join(alone, ["host", "size"], "left").withColumn("alone", F.coalesce("alone", F.lit(False))), "merge0")
    done = rows.filter("alone").withColumn("merged", F.regexp_replace("template", "/[^/]+", "/*")).select("host", "template", "merged")
    rows = rows.filter("NOT alone").drop("alone").withColumn("merged", F.col("template"))
    depth = rows.agg(F.max("size")).first()[0] or 0
    for level in range(1, depth):
        parts = F.split("merged", "/")
        at = F.get(parts, F.lit(level))
        shape = F.array_join(F.transform(parts, lambda p, i: F.when(i == level, "*").otherwise(p)), "/")
        rows = rows.withColumn("shape", F.when(at.isNotNull() & (at != "*"), shape).otherwise(F.col("merged")))
        rows = store.save(rows, f"merge{level}")
        own = rows.groupBy("host", "shape", "merged").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("k"))
        pooled = own.groupBy("host", "shape").agg(F.sum("b").alias("pb"), F.sum("k").alias("pk"))
        b, k, pb, pk = (F.col(c).cast("double") for c in ("b", "k", "pb", "pk"))
        gap = b * pk - k * pb
        alike = (own.join(pooled, ["host", "shape"]).filter(gap * gap <= F.lit(SAME_RATE) * k * pb * (pk - pb))
                 .select("host", "merged", F.col("shape").alias("to")))
        rows = (rows.join(alike, ["host", "merged"], "left")
                .withColumn("merged", F.coalesce("to", "merged")).drop("to", "shape"))
        if level < depth - 1:
            # what has no further segment is set aside
            done = done.unionAll(rows.filter(F.col("size") <= level + 1).select("host", "template", "merged"))
            rows = rows.filter(F.col("size") > level + 1)
    return done.unionAll(rows.select("host", "template", "merged"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_rate.

    ``pages`` needs page_id and url; ``labels`` (page_id, bad) marks some pages
    as bad (1) or good (0), null counting as no label; several labels of a page
    all count. A null url or one without ``://`` has the empty host, path and
    template. Without any label the global bad rate is 0 and nothing but a rule
    blocks. Rows that repeat a page_id are each judged; an empty table gives no
    rows; other columns are not read.
    """
    store = Store(pages.sparkSession, "urls")
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = (labels.filter("bad IS NOT NULL").groupBy("page_id")
             .agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("labelled")))
    counted = (urls.join(marks, "page_id", "left").groupBy("host", "path")
               .agg(F.count("*").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"),
                    F.sum(F.coalesce("labelled", F.lit(0))).alias("labelled")))
    paths = templates(counted, store)
    stats = store.save(paths.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")), "stats")
    tree = store.save(merged(stats, store), "merged")
    pure = stats.join(tree, ["host", "template"]).groupBy("host", "merged").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("k"))
    hosts = stats.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("labelled").alias("hk"))
    total = stats.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("k")).first()
    prior = (total["b"] / total["k"]) if total["k"] else 0.0
    rate = ((F.col("b") + STRENGTH * (F.col("hb") + STRENGTH * F.lit(prior)) / (F.col("hk") + STRENGTH))
            / (F.col("k") + STRENGTH))
    judged = pure.join(hosts, "host").select("host", "merged", rate.alias("bad_rate"))
    # the rate goes to the few templates first, then to their paths
    rated = tree.join(judged, ["host", "merged"])
    of_path = (paths.select("host", "path", "template").join(rated, ["host", "template"])
               .select("host", "path", F.col("merged").alias("template"), "bad_rate"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate") >= REJECT, "block").otherwise("allow")
    return urls.join(of_path, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template",
        F.round("bad_rate", 6).alias("bad_rate"))
