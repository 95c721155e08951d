"""One query per operator over the driver tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import (
    contexttree,
    fingerprints,
    hamming,
    langid,
    linededup,
    mixing,
    neardup,
    packing,
    repair,
    simplex,
    sitestyle,
    urltree,
    warc,
)
from sievework.llm.common import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, count(*) AS copies,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents GROUP BY ALL),
p AS (
  SELECT source, sum(size * copies)::BIGINT AS words, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) AS src
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(src % 3 + 1)::INT]::BIGINT AS weight, 3 * words AS room FROM p),
o AS (
  SELECT *, row_number() OVER rising AS n,
         (sum(words) OVER ())::BIGINT - coalesce(sum(room) OVER earlier, 0)::BIGINT AS rest,
         (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER earlier, 0)::BIGINT AS den
  FROM w WINDOW rising AS (ORDER BY room / weight, src),
       earlier AS (ORDER BY room / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(n) AS first, arg_min(rest, n) AS rest, arg_min(den, n) AS den FROM o WHERE rest * weight <= room * den),
t AS (
  SELECT o.source, o.words, CASE WHEN o.n >= f.first THEN o.weight * f.rest ELSE o.room END AS num,
         CASE WHEN o.n >= f.first THEN f.den ELSE 1 END AS den
  FROM o CROSS JOIN f),
l AS (
  SELECT d.*, t.words, t.num, t.den,
         coalesce(sum(size * copies) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, num::DOUBLE / den::DOUBLE AS target,
       size * (SELECT count(*) FROM range(3) r(p)
               WHERE l.size > 0 AND (2 * (p * l.words + l.start) + l.size * l.copies) * l.den < 2 * l.num)::BIGINT AS taken
FROM l, range(l.copies) c(i)
"""


@query("op1_mix_to_weights", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, text, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(k.doc_id <> f.first_doc, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


@query("op7_weighted_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def id_remainder(n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.CONTRACT)


#: The rules of the contract, (verdict, host/path).
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@query("op2_url_tree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a page's path is the id of its document; a bad label is toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path = urltree.host_and_path(F.col("url"))[1]
    number = F.try_to_number(F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1), F.lit("9" * 18)).cast("long")
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    labelled = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    found = urltree.filter_urls(pages, labelled, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op4_hamming_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc)
SELECT doc AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, doc = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = doc GROUP BY doc
"""


@query("op5_near_duplicates", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, where=id_remainder(5) != 0)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_context_tree_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = contexttree.score_texts(docs, id_remainder(7) != 2)
    return scores.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits,
             max(page_id) OVER (PARTITION BY hex) AS best FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda j: substr(bits, (5 * k + j + 1)::BIGINT, 1)::INTEGER * (16 >> j::INTEGER)))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""


@query("op10_warc_round_trip", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    back = warc.read_archive(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _op11_sql(rounds: int = 3) -> str:
    """A common table expression for the assignment and for the centroids of every round."""
    distance = "list_sum(list_transform(list_zip(k.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := d, j := j)) AS best "
            f"FROM (SELECT k.*, c.j, {distance} AS d FROM k CROSS JOIN c{r} AS c) GROUP BY row)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM ("
                f"SELECT best.j AS j, i, sum(v)::HUGEINT AS s, count(*) AS n FROM (SELECT best, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) "
                f"GROUP BY best.j, i) GROUP BY j)"
            )
            steps.append(f"c{r + 1} AS (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    last = f"a{rounds}"
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c
  FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM k ORDER BY h, x LIMIT 16)),
{", ".join(steps)}
SELECT vec_id, best.j::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.j))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} AS c ON c.j = best.j
"""


@query("op11_centroid_clusters", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.report(simplex.cluster(table(spark, sf_dir, "embeddings")))


@query("op12_main_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitestyle.extract(table(spark, sf_dir, "pages"))


OP13_SQL = r"""
WITH RECURSIVE
crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY n) AS tab FROM range(256) AS r(n)),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM conversations, crc),
a AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM d WHERE code <> 0),
f AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS k, left(role, 1) AS i,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         coalesce(lag(left(role, 1)) OVER w || left(role, 1), 'su') NOT IN ('su', 'ua', 'au') AS odd
  FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 1), role, text, copy)),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal
  FROM f GROUP BY conv_id),
step(p, i, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, m) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)),
edit AS (
  SELECT p, p AS q, NULL AS i, 2 AS cost, 'D' AS e FROM (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL SELECT p, q, i, 0, 'K' FROM step UNION ALL SELECT p, q, NULL, 1, 'R' FROM step WHERE i <> 's'),
best AS (
  SELECT conv_id, 0 AS k, q, lpad((5 * m)::VARCHAR, 9, '0') || repeat('I', m) AS cell FROM counts, ins WHERE p = 0
  UNION ALL
  SELECT f.conv_id, f.k, ins.q,
         min(lpad((left(b.cell, 9)::INTEGER + edit.cost + CASE WHEN edit.e <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END + 5 * ins.m)::VARCHAR, 9, '0')
             || substr(b.cell, 10) || edit.e || repeat('I', ins.m))
  FROM best AS b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k + 1
  JOIN edit ON edit.p = b.q AND (edit.i IS NULL OR edit.i = f.i) AND (edit.e = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  JOIN ins ON ins.p = edit.q
  GROUP BY f.conv_id, f.k, ins.q),
root AS (
  SELECT c.conv_id, left(min(cell), 9)::BIGINT AS cost, substr(min(cell), 10) AS audit
  FROM counts AS c JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.k = c.n AND b.q IN (0, 3) GROUP BY c.conv_id),
walk AS (
  SELECT conv_id, length(replace(audit, 'D', '')) AS size, e, length(replace(left(audit, pos), 'I', '')) AS k, length(replace(left(audit, pos - 1), 'D', '')) AS place
  FROM (SELECT *, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS pos FROM root WHERE audit <> '')),
fixed AS (
  SELECT w.conv_id, string_agg(CASE WHEN e = 'K' THEN f.role WHEN (w.place - w.size % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END
                               || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY w.place) AS lines
  FROM walk AS w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k WHERE e <> 'D' GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS e LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN root AS r ON r.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN fixed AS x ON x.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))
