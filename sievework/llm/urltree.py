"""URL filter: a tree of path templates for each host, judged by the labels of its pages.

1. A path is a list of segments. Level after level, a segment becomes ``*`` if it looks generated
   (digits, long hex, or a word with digits, apart from a file ending) or if its place holds
   more than ``max_children`` different segments and it is rare itself, with fewer than
   ``few_pages`` pages and fewer than ``few_labels`` labels: the rare children of such a node are
   one wildcard branch, the others keep their names. Paths are followed to their end.
2. Sibling branches are merged if they are statistically alike. If the labels of a place are spread
   over its siblings as chance would spread them (Pearson's statistic at most ``alike`` deviations
   above its mean), all are one branch. Else a sibling is distinct if its own share, on the arcsine
   scale, is more than ``alike`` standard deviations from that of all the others of the place
   together; what is not distinct is one branch, however its single labels fell. Distinct siblings
   come by rising share, and one joins the branch before it unless the two differ by more than that;
   a sibling is always tested with its own labels, never with those of others like it. A sibling
   without labels merges with none and has the share of its host.
3. The bad share of a merged template is smoothed towards that of its host, which is smoothed
   towards that of all labelled pages. A template is rejected if its good share, the purity, is
   below ``purity``.

A hand-written rule list comes before the tree: the longest rule that fits decides.

Pages are reduced to the distinct shapes of their paths before the tree is built; the one join
with pages is by host and shape and can be split where one of them has many rows. A null url, or one
without ``://``, has an empty host and path and one template of its own. Labels of pages that do not exist are ignored; several labels of a
page all count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import LOWER, UPPER, written


@dataclass(frozen=True)
class TreeSpec:
    max_children: int = 50
    few_pages: int = 20
    few_labels: int = 10
    alike: float = 2.0
    weight: float = 5.0
    purity: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits, else nulls.

    ``rules`` holds (allow or block, rule). A rule fits its host and all subdomains if the path
    starts with the rule's.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _generalised(segment: Column) -> Column:
    """``*`` for a segment that looks generated; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    made = stem.rlike(r"^[0-9]+$|^[0-9A-Fa-f]{8,}$|^[0-9A-Fa-f-]{32,}$|[0-9]{3,}")
    return F.when(made, F.concat(F.lit("*"), ending)).otherwise(segment)


def with_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` with n labels and b bad ones; ``labels`` has page_id and bad (boolean)."""
    counts = labels.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
    return pages.join(counts, "page_id", "left").fillna(0, ["n", "b"])


def shape_of(path: Column) -> Column:
    """The segments of a path, each after a slash, generated ones as wildcards."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _generalised)
    return F.array_join(F.transform(parts, lambda s: F.concat(F.lit("/"), s)), "")


def templates(shapes: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """host, shape, n, b, template; ``shapes`` has host, shape, pages and the labels n and b, one row for a shape.

    Level after level the places with more than ``max_children`` pages are looked at, until no path
    goes on; below smaller places nothing can be rare among many, so their paths are taken as they are.
    """
    ways = shapes.withColumn("template", F.lit("")).withColumn("rest", F.col("shape"))
    done: DataFrame | None = None
    while True:
        pages = ways.filter("rest <> ''").groupBy("host", "template").agg(F.sum("pages").alias("__all"))
        large = pages.filter(F.col("__all") > spec.max_children).select("host", "template", F.lit(True).alias("__large"))
        marked = written(ways.join(large, ["host", "template"], "left"), "ways")
        more = (F.col("rest") != "") & F.col("__large").isNotNull()
        closed = marked.filter(~more).select("host", "shape", "n", "b", F.concat("template", "rest").alias("template"))
        done = closed if done is None else done.unionAll(closed)
        ways = marked.filter(more).drop("__large").withColumn("__s", F.regexp_extract("rest", r"(?s)^/[^/]*", 0))
        if ways.isEmpty():
            return done
        counts = ways.groupBy("host", "template", "__s").agg(F.sum("pages").alias("rows"), F.sum("n").alias("labels"))
        wide = counts.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > spec.max_children)
        rare = counts.filter((F.col("rows") < spec.few_pages) & (F.col("labels") < spec.few_labels))
        rare = rare.join(wide, ["host", "template"], "left_semi").select("host", "template", "__s", F.lit(True).alias("__r"))
        step = F.when(F.col("__r"), F.lit("/*")).otherwise(F.col("__s"))
        ways = ways.join(rare, ["host", "template", "__s"], "left").select(
            "host", "shape", "pages", "n", "b", F.concat("template", step).alias("template"),
            F.substr("rest", F.char_length("__s") + 1).alias("rest"),
        )


def judge(rows: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """host, template, branch, purity, verdict for every template; ``rows`` has host, template, n and b."""
    zero = F.lit(0).cast("long")
    leaf = written(rows.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "templates")
    n, b = leaf.agg(F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("b"), zero)).first()
    w = spec.weight
    hosts = leaf.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    hosts = hosts.withColumn("p1", (F.col("hb") + w * (b + 0.5) / (n + 1.0)) / (F.col("hn") + w))
    parent = F.regexp_replace("template", r"/[^/]*$", "")
    node = leaf.withColumn("parent", parent).join(hosts.select("host", "p1"), "host")
    equal = node.filter("n > 0").groupBy("host", "parent", "n", "b").agg(F.first("p1").alias("p1"), F.count(F.lit(1)).alias("k"))
    branches = written(alike_branches(equal, spec), "branches")
    merged = branches.groupBy("host", "parent", "branch").agg(F.sum(F.col("k") * F.col("n")).alias("mn"), F.sum(F.col("k") * F.col("b")).alias("mb"))
    branches = branches.drop("k").join(merged, ["host", "parent", "branch"])
    node = node.join(branches, ["host", "parent", "n", "b"], "left").fillna(0, ["mn", "mb"])
    purity = 1 - (F.col("mb") + w * F.col("p1")) / (F.col("mn") + w)
    return node.select(
        "host", "template", F.concat_ws("#", "parent", F.col("branch").cast("string")).alias("branch"), purity.alias("purity"),
        F.when(purity < spec.purity, "block").otherwise("allow").alias("tree_verdict"),
    )


def _angle(n: Column, b: Column, p1: Column, w: float) -> Column:
    """On the scale 2 asin(sqrt(p)) the standard deviation of a share of n labels is 1 / sqrt(n)."""
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), (b + w * p1) / (n + w))))


def distinct_siblings(equal: DataFrame, spec: TreeSpec) -> DataFrame:
    """``equal`` with ``distinct``: whether a sibling differs from the others of an uneven place."""
    w = spec.weight
    n, b, k = F.col("n"), F.col("b"), F.col("k")
    place = equal.groupBy("host", "parent").agg(F.sum(k * n).alias("pn"), F.sum(k * b).alias("pb"), F.sum(k).alias("pk"))
    rows = equal.join(place, ["host", "parent"])
    p = F.col("pb") / F.col("pn")
    spread = rows.groupBy("host", "parent").agg(F.sum(F.try_divide(k * (b - n * p) * (b - n * p), n * p * (1 - p))).alias("spread"))
    free = F.col("pk") - 1
    uneven = F.coalesce(F.col("spread"), F.lit(0.0)) > free + spec.alike * F.sqrt(2 * free)
    others = (F.col("pn") - n, F.col("pb") - b)
    apart = F.abs(_angle(n, b, F.col("p1"), w) - _angle(*others, F.col("p1"), w))
    own = apart > spec.alike * F.sqrt(1 / (n + w) + 1 / (others[0] + w))
    return rows.join(spread, ["host", "parent"]).select(*equal.columns, (uneven & own).alias("distinct"))


def alike_branches(equal: DataFrame, spec: TreeSpec) -> DataFrame:
    """host, parent, n, b, k, branch; ``equal`` has k siblings of n labels, b of them bad, and p1."""
    w, alike = spec.weight, spec.alike
    marked = written(distinct_siblings(equal, spec), "siblings")

    def angle(n: int, b: int, p1: float) -> float:
        return 2 * math.asin(math.sqrt(min(1.0, (b + w * p1) / (n + w))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, branch, mn, mb = None, 0, 0, 0
        for batch in batches:
            found = []
            for host, parent, n, b, k, p1 in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, parent) != place:
                    place, branch, mn, mb = (host, parent), 1, n * k, b * k
                elif abs(angle(n, b, p1) - angle(mn, mb, p1)) <= alike * math.sqrt(1 / (n + w) + 1 / (mn + w)):
                    mn, mb = mn + n * k, mb + b * k
                else:
                    branch, mn, mb = branch + 1, n * k, b * k
                found.append(branch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.int64())], [*batch.schema.names[:5], "branch"])

    share = (F.col("b") + w * F.col("p1")) / (F.col("n") + w)
    rows = marked.filter("distinct").select("host", "parent", "n", "b", "k", "p1", share.alias("share"))
    rows = rows.repartition("host", "parent").sortWithinPartitions("host", "parent", "share", "n", "b")
    found = rows.drop("share").mapInArrow(run, "host string, parent string, n long, b long, k long, branch long")
    rest = marked.filter("not distinct").select("host", "parent", "n", "b", "k", F.lit(0).cast("long").alias("branch"))
    return found.unionAll(rest)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], spec: TreeSpec = TreeSpec()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", shape_of(F.col("path")))
    rows = written(with_labels(rows, labels), "paths")
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    found = written(templates(shapes, spec), "shapes")
    judged = found.drop("n", "b").join(judge(found, spec), ["host", "template"])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.drop("n", "b").join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("tree_verdict")).alias("verdict"), "template", "purity"
    )
