"""Near duplicates, fingerprints, neighbours, language ID and context trees against brute force."""

import collections
import hashlib
import math
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import contexttree, fingerprints, hamming, langid, neardup

SCHEMA = "doc_id long, text string, lang string, node string, n int, key long, part long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, 3, "y") for i, t, lang in rows], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def prose(rng, n, vocabulary=400):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]


def near_rows():
    rng = np.random.default_rng(5)
    rows, at = [], 0

    def add(text):
        nonlocal at
        at += 3
        rows.append((at, text, "en"))

    for _ in range(40):
        add(" ".join(prose(rng, int(rng.integers(3, 120)))))
    base = prose(rng, 200)
    for i in range(60):  # copies of one text with edits of different strength
        copy = list(base)
        for j in rng.integers(0, 200, int(rng.integers(0, 9))):
            copy[j] = f"new{i}"
        add(" ".join(copy))
    chain = prose(rng, 150)
    for i in range(12):  # each close to the next only
        add(" ".join(chain[4 * i :] + [f"tail{k}" for k in range(4 * i)]))
    shared = prose(rng, 60)
    for i in range(30):  # one passage, different texts
        add(" ".join(shared + prose(rng, 60)))
    for _ in range(20):
        add("the very same short text of nine words here")
    for t in (None, "", " \t\n", "One", "one", "one two", "a b c d e", "A B C D E", "a b c d e f", "x " * 20_000):
        add(t)
    rows.append((3, rows[0][1], "en"))  # a repeated row
    rows.append((None, "no id at all but some words in it", None))
    rows.append((None, "no id at all but some words in it", None))
    return rows


def brute_groups(rows):
    big = 2**63 - 1
    sets, parent = [], {}
    for i, t, _ in rows:
        w = words(t)
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        i = big if i is None else i
        sets.append((i, s))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    none = lambda x: None if x == big else x
    return collections.Counter((none(i), len(s), none(find(i)), i == find(i)) for i, s in sets)


@pytest.mark.parametrize("spec", [neardup.NearSpec(), neardup.NearSpec(star_rounds=0, best_rounds=0, block=4), neardup.NearSpec(star_rounds=0, block=3)], ids=["default", "all pairs", "best pairs"])
def test_near_groups_equal_brute_force(spark, spec):
    rows = near_rows()
    got = neardup.near_groups(frame(spark, rows), spec)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_groups(rows)


def test_drop_near_duplicates(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    want = collections.Counter(k[0] for k, n in brute_groups(rows).items() for _ in range(n) if k[3])
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert collections.Counter(r.doc_id for r in left.collect()) == want
    assert neardup.near_groups(frame(spark, [])).collect() == []


def test_ids_repeated_with_different_texts(spark):
    """Rows of one id link their texts; each text is compared as itself."""
    rng = np.random.default_rng(11)
    a, b, c, d, e = (" ".join(prose(rng, 80)) for _ in range(5))
    near = lambda t: t + " tail"
    rows = [(3, a), (7, a), (7, b), (9, b), (20, c), (20, d), (20, e), (20, ""), (31, near(c)), (33, near(d)), (35, near(e)), (50, " ".join(prose(rng, 80)))]
    rows = [(i, t, "en") for i, t in rows]
    x, other = (" ".join(prose(rng, 80)) for _ in range(2))
    nulls = [(None, t, "en") for t in (near(a), x, x, near(x), other, "", None)]
    for case in (rows, rows + nulls):
        got = neardup.near_groups(frame(spark, case)).collect()
        assert collections.Counter(tuple(r) for r in got) == brute_groups(case)
    left = neardup.drop_near_duplicates(frame(spark, rows + nulls)).collect()
    assert sorted({r.doc_id for r in left if r.doc_id is not None}) == [3, 20, 50]
    none = collections.Counter(r.text for r in left if r.doc_id is None)
    assert none.pop(x, 0) + 2 * none.pop(near(x), 0) == 2  # the rows of one of the two texts
    assert none == collections.Counter([other, "", None])


def test_superminhash_equals_sequential_form():
    mask = 2**64 - 1

    def mix(h):
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & mask
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & mask
        return h ^ (h >> 33)

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, size=n, dtype=np.uint64) for n in (1, 2, 9, 300)]
    got = neardup.superminhash(np.concatenate(sets), np.cumsum([0, 1, 2, 9, 300]), 16)
    for row, own in zip(got, sets):
        want = [0xFFFFFFFF] * 16
        for x in map(int, own):
            places = list(range(16))
            for j in range(16):
                h = mix((x + (j + 1) * 0x9E3779B97F4A7C15) & mask)
                k = j + ((h >> 32) * (16 - j) >> 32)
                places[j], places[k] = places[k], places[j]
                want[places[j]] = min(want[places[j]], (h & 0xFFFFFF) | (j << 24))
        assert row.tolist() == want


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(2).permutation(n).tolist()
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


# --- fingerprints ------------------------------------------------------------------------


def samples(text, k_all):
    """Smallest ln a of each sample, from the same hashes."""
    counts = collections.Counter(words(text))
    out = []
    for k in range(k_all):
        best = math.inf
        for term, n in counts.items():
            t = xxhash.xxh64(term, seed=42).intdigest()
            h = [xxhash.xxh64(struct.pack("<i", 3 * k + i), seed=xxhash.xxh64(struct.pack("<Q", t), seed=42).intdigest()).intdigest() for i in range(3)]
            u = lambda bits: (bits + 0.5) / 2**32
            r = -math.log(u(h[0] & 0xFFFFFFFF) * u(h[0] >> 32))
            ln_c = math.log(-math.log(u(h[1] & 0xFFFFFFFF) * u(h[1] >> 32)))
            b = u(h[2] & 0xFFFFFFFF)
            best = min(best, ln_c - r * (math.floor(math.log(n) / r + b) - b + 1.0))
        out.append(best)
    return out


def test_fingerprints_equal_plain_sampling(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(prose(rng, int(n), 30)) for n in rng.integers(1, 40, 25)] + [None, "", " \n", "Été Big big", texts_equal := "b A c", texts_equal]
    rows = [(10 * i, t, "en") for i, t in enumerate(texts)] + [(None, "first of all", None)]
    got = fingerprints.fingerprint_pairs(frame(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    k = fingerprints.SAMPLES
    for at, (i, t, _) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = by_id[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = samples(t, k)
        for other, value in ((edited, r.near_edited), (after, r.near_next)):
            if not words(t) or not words(other):
                assert value == float(not words(t) and not words(other))
            else:
                assert value == pytest.approx(np.mean([math.isclose(x, y, rel_tol=1e-12) for x, y in zip(own, samples(other, k))]))
    same = [r.fingerprint for r in got if r.doc_id in (10 * (len(texts) - 1), 10 * (len(texts) - 2))]
    assert same[0] == same[1] != "" and by_id[250].fingerprint == ""


def test_fingerprints_across_buckets(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), " ".join(prose(rng, 120, 2000)), "en") for i in np.cumsum(rng.integers(1, 50, 300))]
    cuts = fingerprints.id_buckets(frame(spark, rows), 20)
    assert len(cuts) > 5
    monkeypatch.setattr(fingerprints, "id_buckets", lambda docs: cuts)
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(frame(spark, rows)).collect()}
    error = []
    for (i, t, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = collections.Counter(words(t)), collections.Counter(words(edited))
        error.append(got[i].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.045 and np.mean(np.abs(error)) < 0.035
    monkeypatch.undo()
    assert fingerprints.fingerprint_pairs(frame(spark, [])).collect() == []
    alone = fingerprints.fingerprint_pairs(frame(spark, [(5, "just one text", "en")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# --- neighbours --------------------------------------------------------------------------


def vectors(n, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return (centres[rng.integers(0, 12, n)] + 0.7 * rng.normal(size=(n, dims))).astype(np.float32)


def ask(spark, rows, k=5, spec=hamming.IndexSpec(block_rows=200, sample=600)):
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<float>, id int, unit string")
    got = collections.defaultdict(list)
    for r in sorted(hamming.search(df, F.col("vec_id") % 50 == 0, k, spec=spec).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_neighbours_recall_and_scores(spark):
    x = vectors(1500)
    x[700:1000] = x[700]  # copies
    got = ask(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -2
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        assert len(got[q]) == 5 and [sc for _, sc in got[q]] == sorted([sc for _, sc in got[q]], reverse=True)
        assert all(abs(sc - s[v]) < 1e-12 for v, sc in got[q])
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
    assert hits >= 0.9 * 5 * 30
    assert [v for v, _ in got[750]] == [700, 701, 702, 703, 704]


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0])]
    rows += [(6, [float("inf"), 1.0]), (7, []), (100, None), (1, [3.0, 0.0])]
    got = ask(spark, rows)
    assert [v for v, _ in got[0]] == [1, 50] and [v for v, _ in got[50]] == [0, 1]
    assert got[0][0][1] == 1.0 and 100 not in got
    assert ask(spark, [(0, None)]) == {} and ask(spark, [(0, [1.0])]) == {}


def test_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**16, size=(400, 4), dtype=np.uint16)
    index = hamming.SubstringIndex(codes)
    apart = np.array([[sum(int(a ^ b).bit_count() for a, b in zip(x, y)) for y in codes] for x in codes[:20]])
    for radius in (0, 20, 26, 33):
        for i in range(20):
            assert index.within(codes[i], radius).tolist() == np.flatnonzero(apart[i] <= radius).tolist()


# --- language ID -------------------------------------------------------------------------


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.train(docs, where=~held)
    assert model.members[""] == ["germanic", "romance"] and model.members["germanic"] == ["de", "en"]
    found = langid.predict(docs.filter(held).select("doc_id", "text", "lang"), model)
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.98
    rows = [(1, None, None), (2, "", "en"), (3, "123 !? ²", "en"), (4, "the word and the thing " * 30_000, None), (5, "a", "en"), (None, "der die das und", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, rows), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    untaught = langid.train(frame(spark, [(1, "some text", None)]))
    assert langid.predict(frame(spark, rows), untaught).filter("lang_pred <> 'und'").count() == 0
    single = langid.train(frame(spark, [(1, "some text", "xx"), (2, "more", "xx")]))
    assert {r.lang_pred for r in langid.predict(frame(spark, rows[3:]), single).collect()} == {"xx"}


def test_more_languages_of_one_family(spark):
    rows = [(i, {"en": "the and of thing", "de": "der und das ding", "nl": "het een van dingen", "zz": "qax qix qox"}[lang] + f" {i % 7}", lang) for i in range(80) for lang in ("en", "de", "nl", "zz")]
    docs = frame(spark, rows)
    model = langid.train(docs, langid.LangSpec(dims=256, per_language=20))
    assert len(model.pairs["germanic"]) == 3 and model.members["zz"] == ["zz"]
    assert langid.predict(docs, model).filter("lang <> lang_pred").count() == 0


# --- context trees -----------------------------------------------------------------------


def brute_score(train, text, depth):
    """log10 of Pw after / Pw before, byte by byte, from whole trees."""

    def stream(t):
        return b"".join(w + b" " for w in words(t)) + b"\n "

    counts = collections.Counter()
    for t in train:
        s = b" " * depth + stream(t)
        for i in range(depth, len(s)):
            for bit in range(8):
                node = (256 + s[i]) >> (8 - bit)
                counts[s[i - depth : i], node, s[i] >> (7 - bit) & 1] += 1
    contexts = {c for c, _, _ in counts}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(suffix, node, extra):
        a, b = (sum(counts[c, node, v] for c in contexts | {extra[0]} if c.endswith(suffix)) for v in (0, 1))
        if extra[1] is not None and extra[0].endswith(suffix):
            a, b = a + (extra[1] == 0), b + (extra[1] == 1)
        own = kt(a, b)
        if len(suffix) == depth:
            return own
        below = sum(pw(x, node, extra) for x in {c[depth - len(suffix) - 1 :] for c in contexts | {extra[0]} if c.endswith(suffix)})
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    s, total = b" " * depth + stream(text), 0.0
    for i in range(depth, len(s)):
        for bit in range(8):
            node, context = (256 + s[i]) >> (8 - bit), s[i - depth : i]
            total += pw(b"", node, (context, s[i] >> (7 - bit) & 1)) - pw(b"", node, (context, None))
    return total / math.log(10)


def test_context_tree_equals_whole_tree(spark, tmp_path):
    rows = [(1, "Abba ab\nba", "t"), (2, "ab abba", "t"), (3, None, "t"), (4, "ab ba éx", "h"), (5, "", "h"), (5, "", "h"), (None, "ba", "h")]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = contexttree.score_texts(docs, F.col("lang") == "t", contexttree.TreeSpec(2)).collect()
    assert len(got) == len(rows)
    train = [t for _, t, k in rows if k == "t"]
    c = collections.Counter(w for t in train for w in [*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        tokens = [*words(t), b"\n"]
        r = by_id[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score == pytest.approx(brute_score(train, t, 2))


def test_context_tree_without_training(spark, tmp_path):
    frame(spark, [(1, "a b", "h")]).write.parquet(f"{tmp_path}/one")
    r = contexttree.score_texts(spark.read.parquet(f"{tmp_path}/one"), F.lit(False)).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(-8 * 6 * math.log10(2))
    frame(spark, []).write.parquet(f"{tmp_path}/none")
    assert contexttree.score_texts(spark.read.parquet(f"{tmp_path}/none"), F.lit(True)).collect() == []
