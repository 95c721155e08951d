"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

1. Every text becomes a row of numbers: the size of its set of word shingles, a 128-bit digest of
   the set, and a SuperMinHash signature. An element draws, level after level, a random value and
   the next slot of its own random permutation; a text is finished as soon as every slot holds a
   value below the next level. The levels run for all texts of a slice at once.
2. Texts of equal sets are one node, however many there are; a text of the smallest id stands for
   them. The nodes of one id's texts are linked from the start.
3. Nodes that agree on all ``rows`` registers of a band share a bucket. Two sets of similarity 0.75
   miss each other in all 32 bands of 4 with a probability of 5e-6.
4. Star round: each node of a bucket is compared with the bucket's hub, the node that meets the
   most others, and only with the hub it meets most often. Links are checked on the full sets.
   Best rounds: in buckets that still hold several components each node is checked against the
   one node of another component that its signature is most similar to, as long as that links
   anything. Both join a large group of near copies with about as many checks as it has members.
5. In buckets that hold several components even then, all pairs across components whose signatures
   agree on at least ``floor`` of the registers are checked on the full sets, inside the tasks that
   hold the buckets; only links become rows. Large buckets are compared in blocks; nodes of one
   component are never compared with each other.
6. Components come from hooking each node to its smallest neighbour, pointer jumping and
   contraction, as joins of thin tables. Nothing is collected to the driver.

A null or empty text, or one without words, has an empty set and is linked with nothing. Fewer
words than ``shingle`` make one shingle. Rows of one id are one document: they share their
component. A null id is one document, after all others; only when near copies are dropped a row
without an id goes by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import textbatch as tb
from sievework.llm.common import written

LAST_ID = 2**63 - 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearSpec:
    """Linked: 100 * intersection >= percent * union. ``floor``: five standard deviations below 0.75."""

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    floor: float = 0.56
    star_rounds: int = 1
    best_rounds: int = 4
    block: int = 1024

    @property
    def registers(self) -> int:
        return self.bands * self.rows


# --- sets and signatures -----------------------------------------------------------------


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and their n + 1 offsets."""
    raw = tb.TO_LOWER[raw]
    starts, ends, at = tb.words(raw, offs)
    word = tb.span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    factors = [np.uint64(pow(0xD1342543DE82EF95, t + 1, 2**64)) for t in range(size)]
    n_all = max(0, len(word) - size + 1)
    grams = np.zeros(n_all, dtype=np.uint64)
    for t in range(size):
        grams += word[t : t + n_all] * factors[t]
    grams = tb.mix64(grams)
    sets, sizes = [], np.zeros(len(offs), dtype=np.int64)
    for i in range(len(offs) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            few = sum((int(w) * int(f) for w, f in zip(word[a:b], factors)), b - a)
            own = tb.mix64(np.array([few % 2**64], dtype=np.uint64))
        else:
            continue
        sets.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def superminhash(elements: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """One row of ``m`` registers for each set: level * 2^24 + 24 random bits; sets must not be empty.

    At level j an element draws a value and swaps place j of its permutation with a random place
    from j on; the slot it finds there takes the value if smaller. The slot is traced back through
    the element's earlier swaps.
    """
    n = len(at) - 1
    registers = np.full(n * m, 0xFFFFFFFF, dtype=np.uint32)
    owner = np.repeat(np.arange(n), np.diff(at))
    earlier: list[np.ndarray] = []
    for level in range(m):
        h = tb.mix64(elements + np.uint64((level + 1) * int(GOLD) % 2**64))
        value = (h & np.uint64(0xFFFFFF)).astype(np.uint32) | np.uint32(level << 24)
        swap = level + (((h >> np.uint64(32)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64)
        slot = swap.copy()
        for i in range(level - 1, -1, -1):
            slot[slot == earlier[i]] = i
        np.minimum.at(registers, owner * m + slot, value)
        earlier.append(swap)
        open_ = registers.reshape(n, m).max(axis=1) >= np.uint32(min((level + 1) << 24, 0xFFFFFFFF))
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            earlier = [e[keep] for e in earlier]
    return registers.reshape(n, m)


def keyed(docs: DataFrame) -> DataFrame:
    """doc (a number for a null id too), th (hash of the text), text."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("th"), "text")


def sketches(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """doc, th (hash of the text), n (size of the set), d1, d2 (digest of the set), sig (16 bits of each register)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in tb.slices(batch, "text"):
                elements, at = shingle_sets(raw, offs, spec.shingle)
                n = np.diff(at)
                some = np.flatnonzero(n)
                digest = np.zeros((2, len(n)), dtype=np.uint64)
                sig: list[bytes | None] = [None] * len(n)
                if len(some):
                    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        digest[k, some] = np.add.reduceat(tb.mix64(elements ^ np.uint64(salt)), at[:-1][some])
                    rows = superminhash(elements, np.concatenate([[0], np.cumsum(n[some])]), spec.registers)
                    short = (rows ^ (rows >> np.uint32(16))).astype(np.uint16)
                    for i, row in zip(some.tolist(), short):
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("th"), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(sig, pa.binary())],
                    ["doc", "th", "n", "d1", "d2", "sig"],
                )

    return keyed(docs).mapInArrow(run, "doc long, th long, n long, d1 long, d2 long, sig binary")


# --- candidates --------------------------------------------------------------------------


def band_rows(nodes: DataFrame, spec: NearSpec) -> DataFrame:
    """key (of band and registers) and node, ``bands`` rows for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, spec.bands, spec.rows)
            key = np.zeros(sig.shape[:2], dtype=np.uint64)
            for r in range(spec.rows):
                key = tb.mix64(key + sig[:, :, r].astype(np.uint64) + np.uint64(1))
            key = tb.mix64(key + np.arange(1, spec.bands + 1, dtype=np.uint64) * GOLD)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), spec.bands))], ["key", "node"]
            )

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def buckets(nodes: DataFrame, spec: NearSpec) -> DataFrame:
    """key, node, members: the buckets with at least two nodes."""
    rows = band_rows(nodes, spec)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return written(rows.join(shared, "key"), "buckets")


def hub_pairs(members: DataFrame) -> DataFrame:
    """node, hub: for each node the hub it shares most buckets with; ``members`` has key, node, members."""
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    hubs = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    met = members.join(hubs, "key").filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    return met.groupBy("node").agg(F.max(F.struct("times", "hub"))["hub"].alias("hub"))


def cross_pairs(members: DataFrame, spec: NearSpec, best: bool) -> DataFrame:
    """a, b: pairs of different components in one bucket.

    With ``best`` the pair of each node whose signatures agree most, still to be verified; else links,
    verified on the full sets, that join all that is linked within the bucket (not every link).
    ``members`` has key, node, comp, members, n, sig and, without ``best``, elements (the sorted set).
    A bucket larger than ``block`` is cut by hash into parts; each pair of parts is compared in a
    group of its own. Pairs never become rows before they are chosen or verified.
    """
    parts = F.ceil(F.col("members") / spec.block).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    groups = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).alias("side")),
    )
    if best:
        members = members.withColumn("elements", F.lit(None).cast("binary"))
    names = ["grp", "two", "side", "node", "comp", "n", "sig", "elements"]
    rows = members.select("key", "node", "comp", "n", "sig", "elements", F.explode(groups).alias("g")).select(
        F.xxhash64("key", "g.i", "g.j").alias("grp"), (F.col("g.i") != F.col("g.j")).alias("two"), "g.side", *names[3:]
    )
    rows = rows.repartition("grp").sortWithinPartitions("grp", "node")
    m, share, percent = spec.registers, spec.percent / 100, spec.percent

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.sort(np.concatenate([x, y]))
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)

    def compare(group: dict) -> Iterator[tuple[int, int, int]]:
        sig, node, comp, n, sets = group["sig"], group["node"], group["comp"].copy(), group["n"], group["elements"]
        for i in range(len(node)):
            if (comp == comp[0]).all():
                return
            first = 0 if best else i + 1
            ok = comp[first:] != comp[i]
            if group["two"][i]:
                ok &= group["side"][first:] != group["side"][i]
            ok &= np.minimum(n[first:], n[i]) >= share * np.maximum(n[first:], n[i])
            at = np.flatnonzero(ok) + first
            if len(at) == 0:
                continue
            alike = (sig[at] == sig[i]).sum(axis=1)
            if best:
                k = int(alike.argmax())
                if alike[k] >= spec.floor * m:
                    yield int(node[i]), int(node[at[k]]), int(alike[k])
                continue
            x = np.frombuffer(sets[i], dtype=np.uint64)
            for j in at[alike >= spec.floor * m].tolist():
                if comp[j] != comp[i] and linked(x, np.frombuffer(sets[j], dtype=np.uint64)):
                    comp[comp == comp[j]] = comp[i]
                    yield int(node[i]), int(node[j]), m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: table.column(c).to_numpy() for c in names[:6]}
            cols["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, m)
            cols["elements"] = table.column("elements").to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cols["grp"])) + 1, [len(cols["grp"])]])
            found = [p for a, b in zip(edges[:-1], edges[1:]) if b - a > 1 for p in compare({c: v[a:b] for c, v in cols.items()})]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(3)], ["x", "y", "alike"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = batch.column("grp").to_numpy()
            last = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on in the next batch
            if last > 0:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from work(pa.Table.from_batches(held))

    pairs = rows.select(*names).mapInArrow(run, "x long, y long, alike long")
    if best:
        pairs = pairs.groupBy("x").agg(F.max(F.struct("alike", (-F.col("y")).alias("y"))).alias("t")).select("x", (-F.col("t.y")).alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def element_sets(texts: DataFrame, spec: NearSpec) -> DataFrame:
    """node, n, elements: the sorted set of every text as bytes; ``texts`` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in tb.slices(batch, "text"):
                elements, at = shingle_sets(raw, offs, spec.shingle)
                own = [elements[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(at)), pa.array(own, pa.binary())], ["node", "n", "elements"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, elements binary")


# --- links and components ----------------------------------------------------------------


def verified(pairs: DataFrame, texts: DataFrame, spec: NearSpec) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in tb.slices(batch, "ta"):
                left, at = shingle_sets(raw, offs, spec.shingle)
                right, to = shingle_sets(*tb.buffer(part.column("tb")), spec.shingle)
                linked = np.zeros(part.num_rows, dtype=bool)
                for i in range(part.num_rows):
                    x, y = left[at[i] : at[i + 1]], right[to[i] : to[i + 1]]
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    linked[i] = len(both) > 0 and 100 * common >= spec.percent * (len(both) - common)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked)) for c in part.columns[:2]], ["a", "b"])

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node that has a link.

    Each round hooks nodes to their smallest neighbour, follows two hooks at once, and contracts
    the links; the rounds needed grow with the logarithm of the longest chain.
    """
    links = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    found: DataFrame | None = None
    while not links.isEmpty():
        ways = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "hooks")
        for _ in range(2):
            over = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(over, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        hook = written(hook, "hooks")
        if found is None:
            found = hook.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            found = found.join(hook.select(F.col("a").alias("comp"), "p"), "comp", "left").select(
                "node", F.coalesce("p", "comp").alias("comp")
            )
        found = written(found, "components")
        to = [hook.select(F.col("a").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
        links = links.join(to[0], "a").join(to[1], "b").filter("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")
        )
        links = written(links.distinct(), "links")
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def node_components(docs: DataFrame, nodes: DataFrame, links: DataFrame | None, spec: NearSpec) -> DataFrame:
    """node, comp for every linked node; ``nodes`` has node, doc and th (of its text), n and sig; ``links`` are given."""
    shared = buckets(nodes, spec)
    involved = nodes.select("node", "doc", "th").join(shared.select("node").distinct(), "node", "left_semi")
    texts = written(keyed(docs).join(involved, ["doc", "th"]).select("node", "text"), "texts")
    if texts.count() > involved.count():  # repeated rows
        texts = written(texts.dropDuplicates(["node"]), "texts")
    marks = nodes.select("node", "n", "sig")
    tested = None
    comps = components(links) if links is not None else None
    members = shared.withColumn("comp", F.col("node"))
    steps = ["star"] * spec.star_rounds + ["best"] * spec.best_rounds + ["all"]
    while steps:
        step = steps.pop(0)
        if comps is not None:
            members = mixed_buckets(shared, comps)
            if members.isEmpty():
                break
        if step == "all":
            needed = texts.join(members.select("node").distinct(), "node", "left_semi")
            sets = element_sets(needed, spec).join(marks.select("node", "n", "sig"), ["node", "n"])
            found = written(cross_pairs(members.join(sets, "node"), spec, False), "linked")
            if not found.isEmpty():
                comps = components(found if links is None else links.unionAll(found))
            break
        if step == "star":
            pairs = hub_pairs(members).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        else:
            pairs = cross_pairs(members.join(marks, "node"), spec, True)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        new = written(verified(pairs, texts, spec), "linked")
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = new if links is None else links.unionAll(new)
        if not new.isEmpty():
            comps = components(links)
        elif step == "best":  # another round would choose the same pairs
            steps = ["all"]
    return comps if comps is not None else shared.select("node", F.col("node").alias("comp")).limit(0)


def mixed_buckets(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of buckets with several components; of buckets with the same nodes, one."""
    marked = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = marked.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("node") % (1 << 40)).alias("set"), F.count(F.lit(1)).alias("c")
    ).filter("lo <> hi")
    once = mixed.groupBy("set", "c").agg(F.min("key").alias("key")).select("key")
    return written(marked.join(once, "key", "left_semi"), "mixed-buckets")


DIGEST = ["d1", "d2", "n"]


def grouped(docs: DataFrame, spec: NearSpec, null_is_one: bool) -> DataFrame:
    """doc, th, n, root (the smallest doc of the component) and kept for each row of ``docs``.

    With ``null_is_one`` the rows without an id are one document. Otherwise each goes by its own
    text, and in a component without any id the rows of one set are kept.
    """
    rows = written(sketches(docs, spec), "sketches")
    classes = rows.filter("n > 0").groupBy(*DIGEST).agg(F.min(F.struct("doc", "th")).alias("t"), F.first("sig").alias("sig"))
    # Numbered as they are written, so that every set has a node of its own.
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "t.doc", "t.th", *DIGEST, "sig")
    classes = written(classes, "classes")
    named = rows.select("doc", "th", *DIGEST)
    one = named if null_is_one else named.filter(F.col("doc") != LAST_ID)
    several = one.groupBy("doc").agg(F.min(F.struct(*DIGEST)).alias("lo"), F.max(F.struct(*DIGEST)).alias("hi"))
    several = written(several.filter("lo <> hi").select("doc"), "several")
    links = held = None
    if not several.isEmpty():
        # A document of several texts links their nodes as it carries one id.
        held = named.filter("n > 0").join(several, "doc", "left_semi").select("doc", *DIGEST).distinct()
        held = written(held.join(classes.select(*DIGEST, "node"), DIGEST).select("doc", "node"), "held")
        links = held.join(held.groupBy("doc").agg(F.min("node").alias("a")), "doc").select("a", F.col("node").alias("b")).filter("a <> b")
    comps = node_components(docs, classes, links, spec)
    linked = written(classes.drop("sig", "th").join(comps, "node"), "linked-classes")
    roots = linked.groupBy("comp").agg(F.min(F.struct("doc", *DIGEST)).alias("r"))
    label = linked.join(roots, "comp").select("node", *DIGEST, F.col("r.doc").alias("root"), (F.struct(*[F.col(f"r.{c}") for c in DIGEST]) == F.struct(*DIGEST)).alias("first"))
    own = classes.drop("sig", "th").join(label.select("node", "root", "first"), "node", "left")
    own = own.select(*DIGEST, F.coalesce("root", "doc").alias("root"), F.coalesce("first", F.lit(True)).alias("first"))
    named = named.join(own, DIGEST, "left")
    if held is not None:  # a row without words goes with the others of its id
        wordy = held.join(classes.select("node", *DIGEST), "node").join(own, DIGEST).groupBy("doc").agg(F.min("root").alias("of_doc"))
        named = named.join(wordy, "doc", "left").withColumn("root", F.coalesce("root", "of_doc"))
    root = F.coalesce("root", "doc")
    kept = (F.col("doc") == root) & (F.lit(null_is_one) | (F.col("doc") != LAST_ID) | F.coalesce("first", F.lit(True)))
    return named.select("doc", "th", "n", root.alias("root"), kept.alias("kept"))


def near_groups(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    by_id = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    found = grouped(docs, spec, True)
    return found.select(by_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), by_id("root").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; rows without an id go by their text."""
    lost = grouped(docs, spec, False).filter(~F.col("kept"))
    lost = lost.select(F.col("doc").alias("__lost"), F.when(F.col("doc") == LAST_ID, F.col("th")).otherwise(0).alias("__hash")).distinct()
    lost = written(lost, "lost")
    doc = F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).cast("long")
    text = F.when(doc == LAST_ID, F.xxhash64("text")).otherwise(0)
    return docs.join(lost, (doc == F.col("__lost")) & (text == F.col("__hash")), "left_anti")
