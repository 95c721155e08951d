"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a line of documents in a random but repeatable order, cut into blocks of about
``block_words`` words. A source gives an exact quota of blocks, counted over as many passes through
its line as its target needs. The quotas stand at the root of a binary tree over the output shards.
A node with half of the blocks to hand to its left child draws how many of each source go there
from the multivariate hypergeometric distribution, so that every shard is a random sample of the
whole mix and the quotas are met exactly. A leaf draws the next unused blocks of each source's
line, and documents are shuffled within their shard.

Only DataFrame functions are used. Work per document is one row of four numbers. A hot source is
cut into cells of about ``CELL`` documents before its running sum is taken; the window over one
source sees a row per cell. The tree holds one array entry per source and node.

Null and empty texts have size 0 and are never taken. Rows with the same id, source and size are
one document listed several times: all its rows are taken equally often. A null source is a source
of its own, last in order. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import WORD, written

#: Documents in a cell of a source's line.
CELL = 4096
KEYS = ["doc_id", "source", "size"]


@dataclass(frozen=True)
class MixSpec:
    """Weights go to the sources in code point order, repeating; no source exceeds ``most`` times its size."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    block_words: int = 16_384
    shard_words: int = 4_000_000
    seed: str = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(doc_id: Column, seed: str) -> Column:
    """A number below 2^60 from the id: the place of a document in its source's line."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """source, src (0, 1, ...), words, docs, and the target as the fraction num / den.

    Weights share all words. Sources are looked at in the order of the weight share at which they
    are full; the first that stays below its limit fixes the share of the rest.
    """
    weights = F.array(*[F.lit(w) for w in spec.weights])
    per = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("docs")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(weights, (F.col("src") % len(spec.weights) + 1).cast("int")).cast("long"))
    full = spec.most * F.col("words")
    by = Window.orderBy(full / F.col("weight"), "src")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("words").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("den", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fits", F.col("left") * F.col("weight") <= full * F.col("den"))
        .withColumn("n", F.row_number().over(by))
        .withColumn("first", F.min(F.when(F.col("fits"), F.col("n"))).over(every))
        .withColumn("share", F.min(F.when(F.col("n") == F.col("first"), F.struct("left", "den"))).over(every))
    )
    open_ = F.col("n") >= F.col("first")
    return per.select(
        "source",
        "src",
        "words",
        "docs",
        F.when(open_, F.col("weight") * F.col("share.left")).otherwise(full).alias("num"),
        F.when(open_, F.col("share.den")).otherwise(F.lit(1)).cast("long").alias("den"),
    )


def _ln_factorial(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the product (x + 1) ... (x + 8)."""
    z = x + 8.0
    series = z * F.log(z) - z + 0.5 * F.log(z * (2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z)
    product = x + 1.0
    for k in range(2, 9):
        product = product * (x + float(k))
    return series - F.log(product)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` are among ``drawn`` out of good + bad, by inversion outwards from the mode.

    The walk ends twelve standard deviations from the mode, where less than 1e-30 is left.
    """

    def from_mode(v: Column) -> Column:
        g, b, n, lowest, highest, mode = (v[x] for x in ("g", "b", "n", "lowest", "highest", "mode"))
        numbers = F.array(g, b, n, g + b - n, mode, g - mode, n - mode, b - n + mode, g + b)
        ln_p = F.aggregate(
            F.zip_with(F.transform(numbers, _ln_factorial), F.array(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0, -1.0, -1.0, -1.0, -1.0, -1.0)]), lambda x, y: x * y),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        spread = F.sqrt(n * g * b / F.greatest(F.lit(1.0), (g + b) * (g + b)))
        steps = F.least(highest - lowest, F.ceil(12 * spread) + 12).cast("int")
        return _let(F.struct(F.exp(ln_p).alias("p"), steps.alias("steps")), lambda w: walk(v, w["p"], w["steps"]))

    def walk(v: Column, p: Column, steps: Column) -> Column:
        g, b, n, lowest, highest, mode = (v[x] for x in ("g", "b", "n", "lowest", "highest", "mode"))

        def step(s: Column, i: Column) -> Column:
            x, y = mode + i, mode - i
            up = F.when(x <= highest, s["up"] * (g - x + 1) * (n - x + 1) / (x * (b - n + x))).otherwise(F.lit(0.0))
            down = F.when(y >= lowest, s["down"] * (y + 1) * (b - n + y + 1) / ((g - y) * (n - y))).otherwise(F.lit(0.0))

            def settle(m: Column) -> Column:
                done = s["left"] <= 0
                k = F.when(done, s["k"]).when(s["left"] <= m["up"], x).when(s["left"] <= m["up"] + m["down"], y).otherwise(s["k"])
                left = F.when(done, s["left"]).otherwise(s["left"] - m["up"] - m["down"])
                return F.struct(m["up"].alias("up"), m["down"].alias("down"), left.alias("left"), k.alias("k"))

            return _let(F.struct(up.alias("up"), down.alias("down")), settle)

        start = F.struct(p.alias("up"), p.alias("down"), (u - p).alias("left"), mode.alias("k"))
        indices = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(indices, start, step, lambda s: s["k"].cast("long"))

    def with_mode(v: Column) -> Column:
        g, b, n = v["g"], v["b"], v["n"]
        lowest, highest = F.greatest(F.lit(0.0), n - b), F.least(g, n)
        mode = F.least(highest, F.greatest(lowest, F.floor((n + 1) * (g + 1) / (g + b + 2)).cast("double")))
        return _let(
            F.struct(g.alias("g"), b.alias("b"), n.alias("n"), lowest.alias("lowest"), highest.alias("highest"), mode.alias("mode")), from_mode
        )

    return _let(F.struct(good.cast("double").alias("g"), bad.cast("double").alias("b"), drawn.cast("double").alias("n")), with_mode)


def _split(node: Column, quotas: Column, seed: str) -> Column:
    """For each source of a node, struct(src, from, q, left): ``left`` blocks go to the left child."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x["q"])
    start = F.struct(
        total.alias("rest"),
        F.floor(total / 2).cast("long").alias("draw"),
        F.array().cast("array<struct<src:int,from:bigint,q:bigint,left:bigint>>").alias("done"),
    )

    def step(s: Column, x: Column) -> Column:
        u = (F.xxhash64(F.lit(seed), node, x["src"]) / 2.0**64) + 0.5

        def hand_out(left: Column) -> Column:
            one = F.struct(x["src"].alias("src"), x["from"].alias("from"), x["q"].alias("q"), left.alias("left"))
            return F.struct(
                (s["rest"] - x["q"]).alias("rest"), (s["draw"] - left).alias("draw"), F.concat(s["done"], F.array(one)).alias("done")
            )

        return _let(hypergeometric(x["q"], s["rest"] - x["q"], s["draw"], u), hand_out)

    return F.aggregate(quotas, start, step, lambda s: s["done"])


def splitting_tree(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """src, shard, from, q: the blocks [from, from + q) of a source's line that a shard draws.

    ``quotas`` has src and q. Every level splits all nodes in place, without a shuffle of documents.
    """
    nodes = quotas.agg(
        F.array_sort(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.lit(0).cast("long").alias("from"), F.col("q")))).alias("quotas")
    ).select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(levels):
        if level == 6:
            nodes = nodes.repartition("node")
        parts = nodes.withColumn("parts", _split(F.col("node"), F.col("quotas"), seed))
        left = F.transform("parts", lambda x: F.struct(x["src"].alias("src"), x["from"].alias("from"), x["left"].alias("q")))
        right = F.transform(
            "parts", lambda x: F.struct(x["src"].alias("src"), (x["from"] + x["left"]).alias("from"), (x["q"] - x["left"]).alias("q"))
        )
        child = F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")),
        ))
        nodes = parts.select(child.alias("c")).select("c.node", "c.quotas")
    first = F.lit(2**levels).cast("long")
    return nodes.select((F.col("node") - first).alias("shard"), F.explode("quotas").alias("x")).select(
        "x.src", "shard", F.col("x.from").alias("from"), F.col("x.q").alias("q")
    )


def draws(docs: DataFrame, spec: MixSpec = MixSpec()) -> tuple[DataFrame, DataFrame]:
    """The mix: one row per document and pass that takes it, and the documents with their targets.

    ``docs`` needs doc_id, text and source. The first frame has doc_id, source, size, pass, block,
    shard and place (the order within the shard); the second doc_id, source, size, copies, words
    (of the source), num and den (target = num / den).
    """
    sizes = written(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("at", position(F.col("doc_id"), spec.seed)),
        "sizes",
    )
    per = written(targets(sizes, spec), "targets")
    rows = sizes.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = F.ceil(F.col("docs") / CELL)
    rows = rows.withColumn("cell", F.floor(F.col("at") / (2.0**60 / cells)).cast("long"))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("src", "cell").orderBy("at", *KEYS).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("src", "cell").agg(F.sum(words).alias("w")).select(
        "src", "cell", F.coalesce(F.sum("w").over(along), F.lit(0)).alias("offset")
    )
    lined = (
        rows.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(offsets, ["src", "cell"])
        .withColumn("start", F.col("offset") + F.col("before"))
    )
    # A pass takes a document if its middle lies before the target: 2 (pass S + start) + words < 2 T.
    taken = (
        lined.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spec.most - 1).cast("long"))))
        .filter((F.col("size") > 0) & ((2 * (F.col("pass") * F.col("words") + F.col("start")) + words) * F.col("den") < 2 * F.col("num")))
    )
    per_pass = F.ceil(F.col("words") / spec.block_words)
    taken = taken.withColumn("block", F.col("pass") * per_pass + F.floor(F.col("start") / spec.block_words))

    whole = F.when(F.col("words") > 0, F.floor(F.col("num") / (F.col("den") * F.col("words")))).otherwise(F.lit(0))
    rest = F.col("num") / F.col("den") - whole * F.col("words")
    quotas = per.select("src", (whole * per_pass + F.ceil(rest / spec.block_words)).cast("long").alias("q"))
    total = per.agg(F.sum("words")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, total / spec.shard_words))))
    owners = splitting_tree(quotas, levels, spec.seed).filter("q > 0").select(
        "src", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("q") - 1)).alias("block")
    )
    mix = taken.join(owners, ["src", "block"]).select(
        *KEYS, "pass", "block", "shard", F.xxhash64(F.lit(spec.seed), "doc_id", "pass").alias("place")
    )
    return mix, lined.select(*KEYS, "copies", F.col("words").alias("words"), "num", "den")


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mixed documents with all their columns, a row per pass that takes them, shard by shard."""
    chosen, _ = draws(docs, spec)
    lists = chosen.groupBy(*KEYS).agg(F.collect_list(F.struct("shard", "place")).alias("__takes"))
    lists = lists.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), "__takes")
    found = docs.join(
        lists,
        docs["doc_id"].eqNullSafe(lists["__d"]) & docs["source"].eqNullSafe(lists["__s"]) & (n_words(docs["text"]) == lists["__n"]),
    )
    return (
        found.select(*[docs[c] for c in docs.columns], F.explode("__takes").alias("__t"))
        .select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__t.shard").alias("__shard"), F.col("__t.place").alias("__place"))
        .repartitionByRange("__shard", "__place")
        .sortWithinPartitions("__shard", "__place")
        .drop("__shard", "__place")
    )


def mix_report(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of every document."""
    chosen, lined = draws(docs, spec)
    per_doc = chosen.groupBy(*KEYS).agg(F.sum("size").alias("t"))
    on = [lined[c].eqNullSafe(per_doc[c]) for c in KEYS]
    joined = lined.join(per_doc, on[0] & on[1] & on[2], "left")
    return joined.select(
        lined["doc_id"],
        lined["size"],
        F.col("words").alias("source_size"),
        (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"),
        F.coalesce(F.col("t"), F.lit(0)).cast("long").alias("taken"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"),
    ).drop("__copy")
