"""Mixing, line dedup and packing against plain Python on fixtures with nulls, ties and repeats."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import linededup, mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, lines string, __x int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Rows of (doc_id, text, source) with more columns, some named like inner ones."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "big", 1, "x", 7) for i, t, s in rows], SCHEMA)


EDGE = [
    (1, "Hello big World\nAll rights reserved.\nshort", "a"),
    (2, "all RIGHTS reserved.  \nHello big World\n\nother line here", "b"),
    (3, None, "a"),
    (4, "", "c"),
    (5, " \t\n \n", None),
    (6, "Été ÉTÉ chaude\nall rights reserved.\nété ÉTÉ chaude", "d"),
    (7, "word " * 30_000 + "\nAll rights reserved.", "a"),
    (8, "one two three four\r\nfive   six<|endoftext|>", "b"),
    (8, "one two three four\r\nfive   six<|endoftext|>", "b"),
    (None, "a line without a number\nAll rights reserved.", "d"),
    (10, "Été Été chaude\nÉTÉ ÉTÉ chaude\n  a line without a number", None),
]


def n_words(text):
    return len(WORD.findall(text or ""))


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(3)
    return EDGE + [(100 + i, " ".join(["w"] * int(rng.integers(1, 60))), "hot" if i % 3 else f"s{i % 40}") for i in range(600)]


def test_mix_meets_targets_and_repeats_rows(spark, many):
    spec = mixing.MixSpec(block_words=64, shard_words=500)
    docs = frame(spark, many)
    report = [tuple(r) for r in mixing.mix_report(docs, spec).collect()]
    assert len(report) == len(many)
    assert sorted(report, key=str) == sorted((tuple(r) for r in mixing.mix_report(docs.repartition(5), spec).collect()), key=str)
    size = collections.Counter()
    source = {}
    for i, t, s in many:
        size[s] += n_words(t)
        source[i, n_words(t)] = s
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total = sum(size.values())
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        share = rest / max(1, sum(w for s, w in weights.items() if s not in capped))
        target = {s: 3.0 * size[s] if s in capped else share * w for s, w in weights.items()}
        over = {s for s in size if target[s] > 3 * size[s]}
        if not over - capped:
            break
        capped |= over
    taken = collections.Counter()
    for i, n, in_source, goal, got in report:
        s = source[i, n]
        assert n == 0 or (got % n == 0 and got <= 3 * n)
        assert in_source == size[s] and goal == pytest.approx(target[s])
        taken[s] += got
    largest = collections.Counter()
    for i, t, s in many:
        largest[s] = max(largest[s], n_words(t) * (2 if i == 8 else 1))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in size)
    mixed = mixing.mix(docs, spec)
    assert mixed.columns == docs.columns
    copies = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    want = collections.Counter()
    for i, n, _, _, got in report:
        text = next(t for j, t, _ in many if j == i and n_words(t) == n)
        if n:
            want[i, text] += got // n
    assert copies == +want


def test_splitting_tree_meets_quotas(spark):
    quotas = [(i, 37 * i) for i in range(12)]
    leaves = mixing.splitting_tree(spark.createDataFrame(quotas, "src int, q long"), 3, "x").collect()
    per_shard, spans = collections.Counter(), collections.defaultdict(list)
    for r in leaves:
        per_shard[r.shard] += r.q
        spans[r.src].append((r["from"], r.q))
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 1
    for src, q in quotas:
        at = 0
        for start, n in sorted(spans[src]):
            if n:
                assert start == at
                at += n
        assert at == q


def test_hypergeometric_draws(spark):
    u = (F.xxhash64("id") / 2.0**64) + 0.5
    rows = spark.range(20_000).select(mixing.hypergeometric(F.lit(30), F.lit(50), F.lit(20), u).alias("k")).groupBy("k").count().collect()
    k = np.repeat([r.k for r in rows], [r["count"] for r in rows])
    assert k.mean() == pytest.approx(7.5, abs=0.05)
    assert k.var() == pytest.approx(20 * 0.375 * 0.625 * 60 / 79, rel=0.05)
    edges = spark.range(1).select(*[mixing.hypergeometric(F.lit(a), F.lit(b), F.lit(n), F.lit(0.7)) for a, b, n in ((0, 5, 2), (5, 0, 2), (3, 3, 6), (4, 4, 0))]).first()
    assert tuple(edges) == (0, 2, 3, 0)


def test_mix_of_nothing(spark):
    assert mixing.mix_report(frame(spark, [])).collect() == []
    assert mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect() == []


def kept_lines(rows):
    """(n_lines, n_dropped, kept text) for each row."""
    strip = "\x20\x09\x0a\x0b\x0c\x0d"

    def key(line):
        line = line.strip(strip)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    first = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                k = 2**63 if i is None else i
                first[key(line)] = min(first.get(key(line), k), k)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        k = 2**63 if i is None else i
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == k]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_equals_python(spark, hot):
    rows = EDGE + ([(1000 + i, f"All rights reserved.\nown line number {i}", "h") for i in range(1500)] if hot else [])
    docs = frame(spark, rows)
    got = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    assert got.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    mine = collections.Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], digest(r.text)) for r in got.collect())
    assert mine == collections.Counter((i, n, d, digest(t)) for i, n, d, t in kept_lines(rows))
    assert linededup.dedup_lines(docs).columns == docs.columns


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(frame(spark, [])).collect() == []


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_tokens_and_places(spark, many):
    docs = frame(spark, many)
    got = packing.pack(docs, with_ids=True).collect()
    want = collections.Counter()
    for (i, t, _), ids in zip(many, library_ids([t for _, t, _ in many])):
        edge = len(ids) % 1024 or 1024
        starts = [0, *range(edge, len(ids), 1024)]
        for k, a in enumerate(starts):
            piece = np.array(ids[a : starts[k + 1] if k + 1 < len(starts) else None], dtype="<u4")
            want[i, k, a, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(places) <= -(-sum(r.length for r in got) // 1024) + 1


def test_added_tokens_as_the_tokenizer_file_has_them(spark):
    """The queries' setting equals `tokenizers` as it is loaded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    eot = "<|endoftext|>"
    texts = [f"a {eot} b", eot, f"{eot}{eot}", f"x  {eot}  y", f"{eot}b\n\n{eot}\u00a0c", f"<|endof text|> <{eot}> {eot[:-1]}", f"it's\u2003{eot}'s 12{eot}34", "none"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.ids for r in packing.pack(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), packing.CONTRACT, with_ids=True).collect()}
    for i, text in enumerate(texts):
        assert got[i] == tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert got[0] == [64, 220, 50256, 275, 2]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(129, dtype=np.int64)
    n = np.clip(rng.lognormal(3, 1, 4000).astype(int), 1, 128) if seed < 4 else np.full(500, [50, 100][seed - 4])
    np.add.at(counts, n, 1)
    patterns = packing.plan(counts, 128)
    used = np.zeros(129, dtype=np.int64)
    for times, lengths in patterns:
        assert sum(lengths) <= 128 and times > 0
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    sequences = sum(t for t, _ in patterns)
    if seed < 4:
        assert sequences <= -(-int((counts * np.arange(129)).sum()) // 128) + 1
    else:
        assert sequences == [250, 500][seed - 4]


def test_exact_fill_prefers_fewest_pieces():
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 40, 30, 10, 25, 15]] = [2, 1, 1, 1, 1, 1]
    assert packing.plan(counts, 100)[:2] == [(1, [60, 40]), (1, [60, 30, 10])]


def test_ranks_in_buckets(spark):
    docs = frame(spark, [(i, "same words", "a") for i in range(300)])
    got = packing.pack(docs, packing.PackSpec(bucket_rows=20)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 300
    assert packing.pack(frame(spark, [])).collect() == []
