"""Line dedup: keep bitmaps instead of texts.

Each line gives one row of numbers: two 64-bit hashes of its key, the document and the position.
Rows are range-partitioned by hash and sorted by document and position within a hash; a running
window streams over them and knows the first document of a key. Dropped positions come back as
one compressed bitmap per document: the runs of kept lines.

A key with more rows than ``total / (4 * partitions)`` would load one task; there are at most
4 * partitions such keys. Their first document comes from an aggregation with a map-side combine,
and the short list is broadcast. Only DataFrame functions are used.

A null or empty text is one empty line. Repeated rows of a document are one document; rows of one
id with different texts are lines of the same document. A null id is one document, after all others.
Keys that differ share both hashes with a probability below n^2 / 2^128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import SPACES, lower_ascii, partitions, written

LAST_ID = 2**63 - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc, th (hash of the whole text), pos, n_lines: one row per line with a long enough key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("th"), split_lines(F.col("text")).alias("lines")
    )
    rows = base.select("doc", "th", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("key", lower_ascii(F.btrim("line", F.lit(SPACES))))
    return rows.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc", "th", "pos", "n_lines"
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc, th, n_dropped, keep: for each document that loses lines the runs (start, length) it keeps.

    ``doc`` is the id (2^63 - 1 for null), ``th`` the xxhash64 of the text.
    """
    rows = written(line_rows(docs, min_chars), "lines")
    n = partitions(docs)
    total = rows.count()
    limit = max(1000, total // (4 * n))
    hot = (
        rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first_doc"))
        .filter(F.col("n") > limit).select("h1", "h2", "first_doc")
    )
    hot = F.broadcast(written(hot, "hot-lines"))  # at most total / limit <= 4 n rows of three numbers
    marked = rows.join(hot, ["h1", "h2"], "left")
    rare = (
        marked.filter(F.col("first_doc").isNull())
        .repartitionByRange(n, "h1", "h2")
        .sortWithinPartitions("h1", "h2", "doc", "pos")
    )
    stream = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = rare.withColumn("first_doc", F.first("doc").over(stream))
    often = marked.filter(F.col("first_doc").isNotNull())
    lost = [x.filter(F.col("doc") != F.col("first_doc")).select("doc", "th", "pos", "n_lines") for x in (rare, often)]
    dropped = lost[0].union(lost[1]).groupBy("doc", "th").agg(
        F.array_sort(F.collect_set("pos")).alias("gone"), F.max("n_lines").alias("n_lines")
    )
    # Between two dropped positions a and b lies the run (a + 1, b - a - 1).
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.col("n_lines")))
    runs = F.zip_with(
        F.slice(edges, 1, F.size(edges) - 1),
        F.slice(edges, 2, F.size(edges) - 1),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return dropped.select("doc", "th", F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept text in ``text`` and two more columns __n_lines and __n_dropped."""
    keyed = docs.withColumns({
        "__doc": F.coalesce(F.col("doc_id"), F.lit(LAST_ID)), "__th": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    })
    bits = bitmaps.select(
        F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("n_dropped").alias("__n_dropped"), F.col("keep").alias("__keep")
    )
    joined = keyed.join(bits, ["__doc", "__th"], "left")
    lines = split_lines(F.col("text"))
    kept = F.array_join(F.flatten(F.transform("__keep", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    out = {
        "__n_lines": F.size(lines).cast("long"),
        "__n_dropped": F.coalesce(F.col("__n_dropped"), F.lit(0)).cast("long"),
        "text": F.when(F.col("__keep").isNull(), F.col("text")).otherwise(kept),
    }
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in docs.columns], "__n_lines", "__n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` without the lines whose key stands in a document of a smaller id."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars)).drop("__n_lines", "__n_dropped")
