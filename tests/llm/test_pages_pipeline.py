"""URL tree, WARC archives and the pipeline on fixtures."""

import base64
import collections
import hashlib
import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import langid, linededup, mixing, neardup, packing, urltree, warc
from sievework.llm.queries import URL_RULES

PAGE = "page_id long, url string, html string, host string, path string, template string, shard int, digest string, kind int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "p", "t", 1, "d", 2) for i, u, h in rows], PAGE)


# --- urls --------------------------------------------------------------------------------

URLS = [
    (1, "https://A.Example.ORG/es/1"),
    (2, "http://example.org/en/17?q=/es/"),
    (3, "http://example.org/en/2#x"),
    (4, "https://shop.com/de/x"),
    (5, "https://shop.com/fr"),
    (6, "https://shop.com/fr/"),
    (7, "ftp://myexample.org/es/"),
    (8, "http://org/x"),
    (9, None),
    (10, "no scheme/org/"),
    (11, ""),
    (12, "http://"),
    (13, "http://x.net?a=://y.org/"),
    (14, "http://x.net/" + "a" * 50_000),
    (15, "x://y://z/org/"),
    (15, "x://y://z/org/"),
    (None, "http://ÄÖ.net/É"),
    (16, "http://x.net\n.org/new\nline"),
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split("[?#]", rest[cut:], maxsplit=1)[0]


def plain_rule(host, path):
    best = (None, None)
    for verdict, rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


def test_hosts_paths_and_rules(spark):
    df = pages(spark, [(i, u, None) for i, u in URLS])
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = urltree.filter_urls(df, none, URL_RULES).collect()
    want = collections.Counter()
    for i, u in URLS:
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        want[i, host, path, rule, verdict or "allow"] += 1
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert urltree.filter_urls(pages(spark, []), none, URL_RULES).collect() == []


def test_tree_rejects_bad_templates(spark):
    rows = [(i, f"http://mixed.net/{'bad' if i % 2 else 'good'}/{i}.html", None) for i in range(200)]
    rows += [(1000 + i, f"http://names.net/user/name{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}", None) for i in range(300)]
    labels = [(i, i % 2 == 1) for i in range(200)] + [(1000 + i, False) for i in range(0, 300, 7)] + [(77_777, True), (1, None), (None, True)]
    got = urltree.filter_urls(pages(spark, rows), spark.createDataFrame(labels, "page_id long, bad boolean"), []).collect()
    verdicts = collections.defaultdict(set)
    for r in got:
        verdicts[r.template].add(r.verdict)
    assert dict(verdicts) == {"/bad/*.html": {"block"}, "/good/*.html": {"allow"}, "/user/*": {"allow"}}


def test_purity_of_merged_branches(spark):
    """Two alike branches with few labels each are judged together; the numbers follow by hand."""
    rows = [(i, f"http://a.net/{'xy'[i % 2]}/p", None) for i in range(8)]
    labels = spark.createDataFrame([(i, True) for i in range(8)], "page_id long, bad boolean")
    got = urltree.filter_urls(pages(spark, rows), labels, []).select("template", "purity", "verdict").distinct().collect()
    host = (8 + 5 * 8.5 / 9) / 13
    assert {r.template for r in got} == {"/x/p", "/y/p"}
    assert all(r.verdict == "block" and r.purity == pytest.approx(1 - (4 + 5 * host) / 9) for r in got)


def test_light_siblings_do_not_join_heavy_ones(spark):
    """Siblings with no or few labels between a good and a bad template leave both as they are."""
    rows = [(0, "http://a.net/x/good", None), (1, "http://a.net/x/bad", None), (2, "http://a.net/x/new", None)]
    rows += [(10 + i, f"http://a.net/x/few{'abcdef'[i]}", None) for i in range(6)]
    labels = [(0, i < 2000) for i in range(10_000)] + [(1, i < 6000) for i in range(10_000)]
    labels += [(10 + i, j < 2 + i % 2) for i in range(6) for j in range(4 + i)]
    got = urltree.filter_urls(pages(spark, rows), spark.createDataFrame(labels, "page_id long, bad boolean"), []).collect()
    found = {r.template: r for r in got}
    assert found["/x/good"].verdict == "allow" and found["/x/good"].purity == pytest.approx(0.8, abs=0.01)
    assert found["/x/bad"].verdict == "block" and found["/x/bad"].purity == pytest.approx(0.4, abs=0.01)
    n, b = len(labels), sum(x for _, x in labels)
    assert found["/x/new"].purity == pytest.approx(1 - (b + 5 * (b + 0.5) / (n + 1)) / (n + 5))


def verdicts(spark, rows, labels):
    got = urltree.filter_urls(pages(spark, rows), spark.createDataFrame(labels, "page_id long, bad boolean"), []).collect()
    assert len(got) == len(rows)
    return {r.page_id: (r.template, r.verdict) for r in got}


def test_heavy_sections_among_rare_ones(spark):
    """A section with many pages or labels is judged by itself, however many rare ones stand beside it."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    for bad in (900, 1100):
        rows = [(i, f"http://a.net/s{name(i)}", None) for i in range(1000)] + [(5000 + i, f"http://a.net/spam/{i}", None) for i in range(bad)]
        rows.append((9000, "http://a.net/one", None))
        labels = [(i, False) for i in range(1000)] + [(5000 + i, True) for i in range(bad)] + [(9000, True)] * 200
        got = verdicts(spark, rows, labels)
        assert {got[i] for i in range(1000)} == {("/*", "allow")}
        assert {got[5000 + i] for i in range(bad)} == {("/spam/*", "block")} and got[9000] == ("/one", "block")


def test_deep_paths_keep_their_verdicts(spark):
    """Paths are followed to their end; wide places are found at any depth."""
    rows = [(i, f"http://a.net/a/b/c/d/{'bad' if i % 2 else 'good'}/{i}", None) for i in range(200)]
    rows += [(1000 + i, f"http://a.net/a/b/c/d/e/f/{chr(97 + i // 26)}{chr(97 + i % 26)}/end", None) for i in range(300)]
    rows.append((5000, "http://b.net" + "/a" * 3000, None))
    got = verdicts(spark, rows, [(i, i % 2 == 1) for i in range(200)])
    assert {got[i] for i in range(200)} == {("/a/b/c/d/good/*", "allow"), ("/a/b/c/d/bad/*", "block")}
    assert {got[1000 + i][0] for i in range(300)} == {"/a/b/c/d/e/f/*/end"}
    assert got[5000][0] == "/a" * 3000


def plain_verdicts(places, w=5.0, alike=2.0, purity=0.5):
    """{(host, place, sibling): (purity, verdict)} of {(host, place): {sibling: (n, b)}} by loops."""
    every = [c for s in places.values() for c in s.values()]
    overall = (sum(b for _, b in every) + 0.5) / (sum(n for n, _ in every) + 1)
    out = {}
    for (host, place), siblings in places.items():
        own = [c for (h, _), s in places.items() if h == host for c in s.values()]
        p1 = (sum(b for _, b in own) + w * overall) / (sum(n for n, _ in own) + w)

        def angle(n, b, p1=p1):
            return 2 * math.asin(math.sqrt(min(1.0, (b + w * p1) / (n + w))))

        def differ(x, y, angle=angle):
            return abs(angle(*x) - angle(*y)) > alike * math.sqrt(1 / (x[0] + w) + 1 / (y[0] + w))

        seen = {s: c for s, c in siblings.items() if c[0]}
        n, b = sum(c[0] for c in seen.values()), sum(c[1] for c in seen.values())
        p = b / n if n else 0
        spread = sum((c[1] - c[0] * p) ** 2 / (c[0] * p * (1 - p)) for c in seen.values()) if 0 < p < 1 else 0
        uneven = spread > len(seen) - 1 + alike * math.sqrt(2 * (len(seen) - 1))
        apart = [s for s, c in seen.items() if uneven and differ(c, (n - c[0], b - c[1]))]
        branches = [[s for s in seen if s not in apart]]
        for s in sorted(apart, key=lambda s: ((seen[s][1] + w * p1) / (seen[s][0] + w), seen[s])):
            # Siblings of equal counts are one class: they come in one go.
            pool = [sum(seen[m][i] for m in branches[-1]) for i in (0, 1)]
            equal = len(branches) > 1 and seen[branches[-1][-1]] == seen[s]
            if len(branches) > 1 and (equal or not differ(seen[s], pool)):
                branches[-1].append(s)
            else:
                branches.append([s])
        for members in [*branches, *[[s] for s in siblings if s not in seen]]:
            mn, mb = sum(siblings[m][0] for m in members), sum(siblings[m][1] for m in members)
            good = 1 - (mb + w * p1) / (mn + w)
            out.update({(host, place, m): (good, "block" if good < purity else "allow") for m in members})
    return out


def test_single_labels_do_not_judge_their_own_page(spark):
    """48 sibling leaves with one label each, every third bad: the labels fall as chance would have it."""
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(i, f"http://a.net/x/{name(i)}", None) for i in range(48)]
    got = urltree.filter_urls(pages(spark, rows), spark.createDataFrame([(i, i % 3 == 0) for i in range(48)], "page_id long, bad boolean"), []).collect()
    assert {(r.verdict, round(r.purity, 2)) for r in got} == {("allow", 0.67)}


def test_branches_equal_a_plain_version(spark):
    rng = random.Random(5)
    places = {}
    for host in ("a.net", "b.org"):
        for place in "pqrstuv":
            kind = rng.choice(["even", "light", "mixed"])
            siblings = {}
            for i in range(rng.choice([1, 2, 5, 20])):
                n = rng.choice([0, 1, 1, 2]) if kind == "light" else rng.choice([1, 8, 8, 60, 400])
                share = 0.3 if kind == "even" else rng.choice([0.1, 0.15, 0.7])
                siblings[chr(97 + i // 26) + chr(97 + i % 26)] = (n, sum(rng.random() < share for _ in range(n)))
            places[host, place] = siblings
    rows, labels = [], []
    for (host, place), siblings in places.items():
        for s, (n, b) in siblings.items():
            rows.append((len(rows), f"http://{host}/{place}/{s}", None))
            labels += [(len(rows) - 1, i < b) for i in range(n)]
    got = urltree.filter_urls(pages(spark, rows), spark.createDataFrame(labels, "page_id long, bad boolean"), []).collect()
    want = plain_verdicts(places)
    assert len({p for p, _ in want.values()}) > 10
    for r in got:
        _, place, s = r.path.split("/")
        assert (r.purity, r.verdict) == (pytest.approx(want[r.host, place, s][0]), want[r.host, place, s][1])


# --- archives ----------------------------------------------------------------------------

HTML = "<html>" + "line of text é\n" * 50
PAGES = [
    (5, "http://a/5", "same"),
    (9, "http://a/9", "same"),
    (7, "http://a/ 7\r\nX: y", "same"),
    (1, None, None),
    (2, "http://a/2", ""),
    (3, "http://a/3", HTML),
    (3, "http://a/3", HTML),
    (4, "http://a/4", "WARC/1.1\r\n\r\n" * 2000),
    (6, "http://a/6", "z" * 300_000),
    (None, "http://a/null", "same"),
    (None, "http://a/null", "only null"),
    (None, "http://a/null2", "only null"),
    (8, "http://a/8", "same2"),
]


def plain_records(rows, least=0):
    best, seen, want = {}, set(), collections.Counter()
    for i, _, h in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= least:
            best[h] = max(best.get(h, i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        to = best.get(h or "")
        response = len(data) < least or (i == to and (i, h) not in seen)
        seen.add((i, h))
        want[i, len(data), digest, "response" if response else "revisit", None if response else to] += 1
    return want


@pytest.mark.parametrize("spec", [warc.WarcSpec(shards=1), warc.WarcSpec(shards=4, roll_bytes=400, min_bytes=5)], ids=["one", "rolled"])
def test_archive_round_trip(spark, tmp_path, spec):
    df = pages(spark, PAGES)
    entries = warc.write_archive(df, f"file://{tmp_path}/a", spec)
    warc.write_archive(df.repartition(3), f"{tmp_path}/b", spec)
    names = sorted(os.listdir(tmp_path / "a"))
    shown = [n for n in names if not n.startswith(".")]
    assert shown == sorted(["manifest.json", *[e["name"] for e in entries]])
    for name in shown:
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes()
    assert json.loads((tmp_path / "a" / "manifest.json").read_text())["files"] == entries
    assert sum(e["records"] for e in entries) == len(PAGES) and (len(entries) > 4) == (spec.shards == 4)
    got = warc.read_archive(spark, f"{tmp_path}/a", with_payload=True).collect()
    rows = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert rows == plain_records(PAGES, spec.min_bytes)
    payloads = {(i, (h or "").encode()) for i, _, h in PAGES}
    assert all((r.page_id, bytes(r.payload)) in payloads for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id == 7} == {"http://a/%207%0D%0AX:%20y"}
    with pytest.raises(FileExistsError):
        warc.write_archive(df, f"file://{tmp_path}/a", spec)


def test_damaged_and_empty_archives(spark, tmp_path):
    assert warc.write_archive(pages(spark, []), f"file://{tmp_path}/none") == []
    assert warc.read_archive(spark, f"{tmp_path}/none").collect() == []
    good = warc.page_record(1, 0, "http://a", b"text", True, None, warc.WarcSpec())
    headers, block = next(warc.parse(good))
    assert headers["warc-type"] == "response" and block.endswith(b"\r\n\r\ntext")
    import gzip

    bad = gzip.compress(gzip.decompress(good).replace(b"text\r\n", b"tixt\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(bad))


def test_shard_cuts_are_even(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 10**12).alias("id"), F.lit(1).alias("weight"))
    cuts = warc.shard_cuts(rows, 8)
    ids = [r.id for r in rows.collect()]
    sizes = [sum(a <= i < b for i in ids) for a, b in zip([0, *cuts], [*cuts, 2**62])]
    assert len(cuts) == 7 and max(sizes) <= 130 and cuts == warc.shard_cuts(rows.repartition(7), 8)


# --- the pipeline ------------------------------------------------------------------------


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(900_001, None, "en", "src0", None), (900_002, "12345 !", None, None, 7), (900_003, "", "de", "src1", 0)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing", "packing"]
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if number < 4:
            assert docs.schema.simpleString() == before.schema.simpleString()
        docs.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append(before.toPandas())
    first, lined, near, mixed = kept[1], kept[2], kept[3], kept[4]
    assert set(kept[0].doc_id) - set(first.doc_id) == {900_001, 900_002, 900_003}
    seen = {}
    for i, t in sorted(zip(first.doc_id, first.text)):
        for line in t.split("\n"):
            seen.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r")), i)
    after = dict(zip(lined.doc_id, lined.text))
    for i, t in zip(first.doc_id, first.text):
        key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
        assert after[i] == "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or seen[key(x)] == i)
    assert (lined.n_chars == lined.text.str.len()).all()

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in zip(lined.doc_id, lined.text)}
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert sorted(near.doc_id) == [i for i in ids if find(i) == i]
    report = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(spark.createDataFrame(near)).collect()}
    takes = collections.Counter(mixed.doc_id)
    assert takes == +collections.Counter({i: t // n for i, (n, t) in report.items() if n})
    packed = docs.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert collections.Counter(packed[packed.piece == 0].doc_id) == takes


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024


def test_nothing_outside_imports_the_operators():
    top = os.path.join(os.path.dirname(__file__), "..", "..", "sievework")
    for folder, _, files in os.walk(top):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "sievework.llm" not in open(os.path.join(folder, f)).read()
    assert all(m for m in (langid, linededup, neardup, packing))
