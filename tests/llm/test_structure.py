"""Centroid clusters and conversation repair against brute force, and their edge cases."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import repair, simplex

# --- centroid clusters -------------------------------------------------------------------


def plain_clusters(rows, clusters=16, rounds=3, dims=64, scale=64):
    """[(id, cluster, distance)] and the centroids, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(2**63), min(2**63 - 1, math.floor(scale * x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [x for (_, x), (_, m) in zip(kept, found) if m == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    return [(i, n, min(d, 2**63 - 1)) for (i, _), (d, n) in zip(kept, assign())], centres


def vectors(spark, rows, dims=64):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, apex double, cluster int")


def made_up(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, dims))
    return [(i, [float(x) for x in centre[i % 9] + 0.4 * rng.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 4, 8])
def test_clusters_equal_brute_force(spark, pivots):
    rows = made_up(300, 64)
    got = simplex.cluster(vectors(spark, rows), simplex.ClusterSpec(pivots=pivots))
    want, centres = plain_clusters(rows)
    assert got.centroids == centres
    assert sorted(map(tuple, got.rows.collect())) == sorted(want)


def test_bounds_hold_and_rule_out_centroids():
    rows = np.array([[math.floor(64 * x) for x in v] for _, v in made_up(400, 64)])
    centres = rows[:16]
    s = simplex.Simplex(centres.tolist(), 8)
    a, b = s.project(rows), s.project(centres)
    true = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    plane = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    low, high = plane + (a[:, -1:] - b[:, -1]) ** 2, plane + (a[:, -1:] + b[:, -1]) ** 2
    assert (low <= true + 1e-3).all() and (high >= true - 1e-3).all()
    kept = simplex.possible(a, b)
    assert kept[np.arange(len(rows)), true.argmin(axis=1)].all()
    assert kept.mean() < 0.7


def test_cluster_edge_cases(spark):
    big = [(100, [1e300] + [0.0] * 63), (101, [-3e38] * 64), (102, [2.0**40] * 64), (102, [2.0**40] * 64)]
    bad = [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 63 + [None]), (204, [0.5] * 63 + [math.nan]), (205, [0.5] * 63 + [math.inf])]
    ties = [(i, [0.25] * 64) for i in range(20)] + [(None, [0.0] * 64), (None, [1.0] * 64), (7, [0.1] * 64)]
    for rows in (big + bad + ties, ties + bad, bad, [], ties[:1]):
        got = simplex.cluster(vectors(spark, rows))
        want, centres = plain_clusters(rows)
        assert got.centroids == centres
        assert sorted(map(repr, map(tuple, got.rows.collect()))) == sorted(map(repr, want))
        out = simplex.report(got).collect()
        assert len(out) == len(want)
        for r in out:
            assert r.cluster_inertia == min(2**63 - 1, sum(d for _, c, d in want if c == r.cluster))
            assert r.inertia == min(2**63 - 1, sum(d for _, _, d in want))
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_pivots_of_one_line_and_of_one_point():
    for points in ([[0, 0], [1, 1], [5, 5], [9, 9]], [[3, 3]] * 4):
        s = simplex.Simplex(points, 4)
        a = s.project(np.array([[2, 7], [4, 4]]))
        kept = simplex.possible(a, s.project(np.array(points, dtype=float)))
        assert np.isfinite(a).all() and kept.any(axis=1).all()


# --- conversations -----------------------------------------------------------------------

ROLE = {"u": "user", "a": "assistant", "s": "system"}


def exhaustive(rows):
    """Least (cost, audit, lines) over all edits, with at most two insertions in a gap; rows are (role, text, fault)."""
    inserts = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    choices = []
    for role, text, fault in rows:
        extra = 5 if fault == "truncated" else 0
        own = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            own += [(extra, "K", (role, text))] + [(1 + extra, "R", (new, text)) for new in ("user", "assistant")]
        choices.append(own)
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 5 * sum(map(len, gaps))
            if best is not None and cost > best[0]:
                continue
            audit, lines = "", []
            for at, gap in enumerate(gaps):
                audit += "I" * len(gap)
                lines += [(ROLE[g], "") for g in gap]
                if at < len(rows):
                    audit += edits[at][1]
                    lines += [edits[at][2]] if edits[at][2] else []
            if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "x" for r, _ in lines)):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, [f"{r}:{t}" for r, t in lines])
    return best


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = text.strip("\x20\t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, key int, conv string")


def repaired(spark, rows):
    """{conv: (report row, lines)}"""
    found = repair.Repair(conversations(spark, rows))
    lines = {}
    for r in sorted(found.repaired().collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    return {r.conv_id: (r, lines.get(r.conv_id, [])) for r in found.report().collect()}


def test_repair_equals_exhaustive_search(spark):
    turns = [(role, text) for role in ("user", "assistant", "system", "tool", "") for text in ("Done.", "cut off", " ")]
    cases = [c for n in (1, 2) for c in itertools.product(turns, repeat=n)]
    cases += [tuple(turns[(7 * i + j * (i % 11 + 1)) % len(turns)] for j in range(3)) for i in range(40)]
    rows = [(i, t, role, text) for i, c in enumerate(cases) for t, (role, text) in enumerate(c)]
    got = repaired(spark, rows)
    for i, c in enumerate(cases):
        cost, audit, lines = exhaustive(faults(c))
        report, own = got[i]
        assert (report.cost, report.audit, own) == (cost, audit, lines), c


def test_long_conversation_is_cut_into_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(1, t, ["user", "assistant", "system"][rng.integers(3)], f"text {rng.integers(400)}{'.' if rng.integers(6) else ''}") for t in range(700)]
    rows += [(c, t, "user", "a.") for c in (0, 2) for t in range(3)]
    whole = repaired(spark, rows)
    monkeypatch.setattr(repair, "PIECE", 7)
    cut = repaired(spark, rows)
    assert cut == whole
    marked = faults([r[2:] for r in rows if r[0] == 1])
    report, lines = cut[1]
    assert report.blank == 0 and report.gaps == 0
    assert report.duplicate == sum(f == "duplicate" for *_, f in marked) and report.truncated == sum(f == "truncated" for *_, f in marked)
    initials = [r[2][0] for r in rows if r[0] == 1]
    assert report.illegal == sum(a + b not in repair.LEGAL for a, b in zip(initials, initials[1:]))
    symbols = "".join("D" if f == "duplicate" else r[0].upper() if f else r[0] for r, _, f in marked)
    assert (report.cost, report.audit) == repair.best_edit(repair.span(symbols))
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_any_split_gives_the_same_cells():
    rng = np.random.default_rng(2)
    for _ in range(30):
        symbols = "".join(rng.choice(list("suaxSUAXD"), size=9))
        for at in range(10):
            assert repair.combine(repair.span(symbols[:at]), repair.span(symbols[at:])) == repair.span(symbols)


def test_conversation_edge_cases(spark):
    long = "word " * 40_000 + "end."
    rows = [
        (1, None, "user", "First."), (1, 5, "assistant", "Second."), (1, 9, "user", "Third."), (1, 9, "user", "Third."), (1, 9, "user", "Third."),
        (None, 1, "user", "x."), (None, 2, "assistant", long),
        (2, None, None, None), (2, None, "assistant", ""),
        (3, 1, "user", "Hé? \t\n"), (3, 2, "assistant", " "), (3, 3, "User", "ok "),
    ]
    got = repaired(spark, rows)
    one = got[1][0]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (3, 0, 2, 0, 2, 6, "KKDDD")
    assert got[None][1] == ["user:x.", f"assistant:{long}"] and got[None][0].audit == "KK"
    assert (got[2][0].gaps, got[2][0].blank, got[2][0].audit, got[2][1]) == (0, 2, "DD", [])
    assert (got[3][0].audit, got[3][0].cost, got[3][0].illegal) == ("DDD", 6, 1)
    assert repaired(spark, []) == {}


def test_equal_rows_of_one_turn_are_counted_before_the_shuffle(spark):
    rows = [(1, 1, "user", "Same.")] * 3000 + [(1, 2, "assistant", "End.")]
    report, lines = repaired(spark, rows)[1]
    assert report.audit == "K" + "D" * 2999 + "K" and report.duplicate == 2999 and report.illegal == 2999
    assert lines == ["user:Same.", "assistant:End."]


def test_damage_and_every_conversation(spark):
    import zlib

    rows = [(c, t, ["user", "assistant"][t % 2], f"Is {c} {t}? Yes! Ok.") for c in range(60) for t in range(4)] + [(900, None, None, None), (None, 3, "user", None)]
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 and text is not None else text
        want += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = repair.damage(conversations(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    table = conversations(spark, rows + [(1000 + i, i, "user", "Gone.") for i in range(40)])
    out = {r.conv_id: r for r in repair.damaged_and_repaired(table).collect()}
    assert set(out) == {r.conv_id for r in table.select("conv_id").distinct().collect()}
    gone = [i for i in range(40) if zlib.crc32(f"{1000 + i}:{i}".encode()) % 20 == 0]
    assert gone
    for i in gone:
        assert tuple(out[1000 + i])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.damaged_and_repaired(table.filter(F.lit(False))).collect() == []
