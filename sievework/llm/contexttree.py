"""Language-model scoring by context-tree weighting over bytes.

A text is its words (A-Z lower-cased) and one end. As bytes, a word is followed by a space and the
end is a line feed and a space. Each byte is eight binary decisions; each decision has a context
tree over the ``depth`` bytes before it in the text, where everything before a text counts as spaces.
Every node holds a Krichevsky-Trofimov estimate from the counts of all training texts and is mixed
with what lies below it: Pw = 1/2 KT + 1/2 prod Pw(children). The probability of a byte is the ratio
Pw after / Pw before, the mixture of the estimates of all depths with the weights that training gave
them; the code length of a text is the sum over its bytes.

1. Each part of the input (a split of a file) sends its distinct words and its distinct (context,
   byte) pairs with their training counts, from all texts, held out or not.
2. A shuffle by word and by pair adds the counts up over the corpus. Words and pairs live in one
   column of keys; no vocabulary is ever in one place.
3. The trees: tasks hold whole subtrees below the last two bytes; what they send up is summed for
   the 256 * 255 nodes of depth 1, all that reaches the driver. A second pass mixes downwards.
4. Each part gets back the counts and code lengths it asked for, ahead of its texts, and adds up.

The base score is the unigram model over words with one added to each count. Null text: empty, one
token. Words are told apart by 64-bit hashes. Rows are scored one by one, whatever their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import textbatch as tb
from sievework.llm.common import written

WORD_KEY, PAIR_KEY, TEXT = 0, 1, 2


@dataclass(frozen=True)
class TreeSpec:
    """``depth``: bytes of context, 2 to 6."""

    depth: int = 4


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a line feed added, starts and ends of all tokens in them (the end of a
    text is that line feed), and the n + 1 offsets of the texts among the tokens."""
    raw = np.append(tb.TO_LOWER[raw], np.uint8(0x0A))
    starts, ends, at = tb.words(raw[:-1], offs)
    last = len(raw) - 1
    return raw, np.insert(starts, at[1:], last), np.insert(ends, at[1:], last + 1), at + np.arange(len(at))


def byte_pairs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context * 256 + byte) of all bytes of all texts, and where each text starts among them."""
    lengths = ends - starts + 1
    first = np.cumsum(lengths) - lengths
    text = np.full(int(lengths.sum()), 0x20, dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[first + lengths - 1] = False
    text[inside] = tb.gather(raw, starts, ends - starts)
    heads = first[at[:-1]]
    keys = text.copy()
    for back in range(1, depth + 1):
        before = np.full(len(text), 0x20, dtype=np.int64)
        before[back:] = text[:-back]
        for j in range(back):  # before the text
            edge = heads + j
            before[edge[edge < len(text)]] = 0x20
        keys |= before << (8 * back)
    return keys, heads


def _sum_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=weights, minlength=len(u)).astype(np.int64)


def requests(docs: DataFrame, depth: int) -> DataFrame:
    """part, kind, key, c: distinct words and pairs of each part with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}

        def merged(part: int) -> None:
            for kind, pieces in held[part].items():
                held[part][kind] = [_sum_by(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))]

        def sent(part: int) -> Iterator[pa.RecordBatch]:
            merged(part)
            for kind, ((keys, counts),) in held.pop(part).items():
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(keys), pa.array(counts)], ["part", "kind", "key", "c"]
                )

        for batch in batches:
            for rows, raw, offs in tb.slices(batch, "text"):
                all_parts = rows.column("part").to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(np.diff(all_parts)) + 1, [rows.num_rows]])
                train = rows.column("train").to_numpy(zero_copy_only=False)
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    data, starts, ends, at = tokens(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    word = tb.span_hashes(data, starts, ends)
                    pairs, heads = byte_pairs(data, starts, ends, at, depth)
                    learn = train[i:j]
                    store = held.setdefault(int(all_parts[i]), {WORD_KEY: [], PAIR_KEY: []})
                    for kind, keys, of in (
                        (WORD_KEY, word.view(np.int64), np.repeat(learn, np.diff(at))),
                        (PAIR_KEY, pairs, np.repeat(learn, np.diff(np.append(heads, len(pairs))))),
                    ):
                        u, c = np.unique(keys[of], return_counts=True)
                        rest = np.unique(keys[~of])
                        store[kind].append((np.concatenate([u, rest]), np.concatenate([c, np.zeros(len(rest), dtype=np.int64)])))
                    if len(store[WORD_KEY]) >= 16:
                        merged(int(all_parts[i]))
                # Splits come one after the other; keep no more than the last two open.
                for part in list(held)[:-2]:
                    yield from sent(part)
        for part in list(held):
            yield from sent(part)

    return docs.select("part", "train", "text").mapInArrow(run, "part long, kind int, key long, c long")


# --- the trees ---------------------------------------------------------------------------


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by a product; x >= 1/2."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return ln_gamma(n0 + 0.5) + ln_gamma(n1 + 0.5) - ln_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def mixed(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of 1/2 KT + 1/2 below, and the weight of KT in it."""
    return np.log(0.5) + np.logaddexp(kt, below), 1.0 / (1.0 + np.exp(np.clip(below - kt, -700, 700)))


class Subtrees:
    """All nodes of depth 2 and more above the given (context, byte) keys, with their weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        context, byte = keys >> 8, keys & 255
        level = np.arange(8)
        self.node = ((256 + byte)[:, None] >> (8 - level)[None, :]).astype(np.int64)
        self.bit = ((byte[:, None] >> (7 - level)[None, :]) & 1).astype(bool)
        weight = np.repeat(counts.astype(np.float64), 8)
        self.context, self.depth = context, depth
        self.inverse, self.p1, self.alpha = {}, {}, {}
        below_keys, below_ln = None, None
        for d in range(depth, 1, -1):
            key = ((context & ((1 << (8 * d)) - 1))[:, None] << 8) | self.node
            u, inverse = np.unique(key.ravel(), return_inverse=True)
            n1 = np.bincount(inverse, weights=weight * self.bit.ravel(), minlength=len(u))
            n0 = np.bincount(inverse, weights=weight, minlength=len(u)) - n1
            kt = ln_kt(n0, n1)
            ln, alpha = kt, np.ones(len(u))
            if below_keys is not None:
                parent = (((below_keys >> 8) & ((1 << (8 * d)) - 1)) << 8) | (below_keys & 255)
                ln, alpha = mixed(kt, np.bincount(np.searchsorted(u, parent), weights=below_ln, minlength=len(u)))
            self.inverse[d], self.p1[d], self.alpha[d] = inverse, (n1 + 0.5) / (n0 + n1 + 1.0), alpha
            below_keys, below_ln = u, ln
            if d == 2:
                self.top = (u, ln, n0, n1)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of depth 1 (byte * 256 + node): ln of the product over their children, and counts."""
        u, ln, n0, n1 = self.top
        slot = (((u >> 8) & 255) << 8) | (u & 255)
        w, inverse = np.unique(slot, return_inverse=True)
        return w, *(np.bincount(inverse, weights=x, minlength=len(w)) for x in (ln, n0, n1))

    def log10(self, top: "TopNodes") -> np.ndarray:
        """log10 of the probability of each key's byte in its context."""
        p = self.p1[self.depth][self.inverse[self.depth]]
        for d in range(self.depth - 1, 1, -1):
            a = self.alpha[d][self.inverse[d]]
            p = a * self.p1[d][self.inverse[d]] + (1 - a) * p
        slot = (((self.context & 255)[:, None] << 8) | self.node).ravel()
        p = top.alpha1[slot] * top.p1[slot] + (1 - top.alpha1[slot]) * p
        node = self.node.ravel()
        p = top.alpha0[node] * top.p0[node] + (1 - top.alpha0[node]) * p
        return np.log10(np.where(self.bit.ravel(), p, 1 - p)).reshape(-1, 8).sum(axis=1)


class TopNodes:
    """Depth 1 and 0, from the sums of all subtrees (at most 256 * 256 slots)."""

    def __init__(self, slot: np.ndarray, ln: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        below, a, b = np.zeros(65536), np.zeros(65536), np.zeros(65536)
        below[slot], a[slot], b[slot] = ln, n0, n1
        ln1, self.alpha1 = mixed(ln_kt(a, b), below)
        self.p1 = (b + 0.5) / (a + b + 1.0)
        used = np.zeros(65536, dtype=bool)
        used[slot] = True
        zero = [np.where(used, x, 0.0).reshape(256, 256).sum(axis=0) for x in (ln1, a, b)]
        _, self.alpha0 = mixed(ln_kt(zero[1], zero[2]), zero[0])
        self.p0 = (zero[2] + 0.5) / (zero[1] + zero[2] + 1.0)


def pair_scores(pairs: DataFrame, spec: TreeSpec) -> DataFrame:
    """key, value: log10 of the probability of the byte in its context; ``pairs`` has key and c."""
    # The last two bytes of a context are the two before the byte itself.
    tail = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    rows = written(pairs.select("key", "c"), "pairs").repartition(tail)

    def load(batches: Iterator[pa.RecordBatch]) -> tuple[Subtrees, np.ndarray] | None:
        got = [(b.column("key").to_numpy(), b.column("c").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return None
        keys, counts = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        return Subtrees(keys, counts, spec.depth), keys

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if loaded := load(batches):
            slot, ln, n0, n1 = loaded[0].sums()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, ln, n0, n1)], ["slot", "ln", "n0", "n1"])

    summed = rows.mapInArrow(up, "slot long, ln double, n0 double, n1 double").groupBy("slot").agg(F.sum("ln"), F.sum("n0"), F.sum("n1"))
    table = np.array([tuple(r) for r in summed.collect()], dtype=np.float64).reshape(-1, 4)  # at most 65,280 rows
    top = TopNodes(table[:, 0].astype(np.int64), table[:, 1], table[:, 2], table[:, 3])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if loaded := load(batches):
            yield pa.RecordBatch.from_arrays([pa.array(loaded[1]), pa.array(loaded[0].log10(top))], ["key", "value"])

    return written(rows.mapInArrow(down, "key long, value double"), "pair-scores")


# --- scoring -----------------------------------------------------------------------------


def _part() -> Column:
    """The split of a file that a row comes from; the same in every scan of the table."""
    return F.xxhash64(F.input_file_name(), F.input_file_block_start())


def score_texts(docs: DataFrame, train: Column, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``docs`` (doc_id, text) is a table read from files, possibly filtered or projected; anything
    else must be written first. ``train`` says which rows are learned from.
    """
    base = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), "text", _part().alias("part"))
    every = Window.partitionBy("kind", "key")
    known = requests(base, spec.depth).withColumns({
        "total": F.sum("c").over(every), "first": F.row_number().over(every.orderBy("part")) == 1
    })
    known = written(known.select("part", "kind", "key", "total", "first"), "counts")
    once = known.filter("first")
    words = once.filter(F.col("kind") == WORD_KEY).agg(F.sum("total"), F.sum((F.col("total") > 0).cast("long"))).first()
    n_all, n_words = (words[0] or 0), (words[1] or 0)
    scores = pair_scores(once.filter(F.col("kind") == PAIR_KEY).select("key", F.col("total").alias("c")), spec)

    none = {"value": F.lit(None).cast("double"), "doc_id": F.lit(None).cast("long"), "train": F.lit(None).cast("boolean"), "text": F.lit(None).cast("string")}
    names = ["part", "kind", "key", "value", "doc_id", "train", "text"]
    asked = known.filter(F.col("kind") == WORD_KEY).withColumns(none | {"value": F.col("total").cast("double")}).select(*names)
    paired = known.filter(F.col("kind") == PAIR_KEY).select("part", "kind", "key").join(scores, "key")
    paired = paired.withColumns({k: v for k, v in none.items() if k != "value"}).select(*names)
    texts = base.withColumns({"kind": F.lit(TEXT), "key": F.lit(None).cast("long"), "value": none["value"], "doc_id": F.col("doc_id").cast("long")}).select(*names)
    rows = asked.unionAll(paired).unionAll(texts).repartition("part").sortWithinPartitions("part", "kind")
    depth = spec.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, tables = None, {}, None

        def lookup(kind: int, keys: np.ndarray) -> np.ndarray:
            known_keys, values = tables[kind]
            return values[np.searchsorted(known_keys, keys)]

        def ready() -> dict[int, tuple[np.ndarray, np.ndarray]]:
            out = {}
            for kind, pieces in gathered.items():
                keys, values = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
                order = np.argsort(keys, kind="stable")
                out[kind] = keys[order], values[order]
            return out

        for batch in batches:
            if batch.num_rows == 0:
                continue
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1, [len(part)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if part[a] != now:
                    now, gathered, tables = part[a], {WORD_KEY: [], PAIR_KEY: []}, None
                run_of = batch.slice(a, b - a)
                if kind[a] != TEXT:
                    gathered[int(kind[a])].append((run_of.column("key").to_numpy(), run_of.column("value").to_numpy()))
                    continue
                if tables is None:
                    tables = ready()
                    gathered = {}
                for rows_, raw, offs in tb.slices(run_of, "text"):
                    data, starts, ends, at = tokens(raw, offs)
                    count = lookup(WORD_KEY, tb.span_hashes(data, starts, ends).view(np.int64))
                    pairs, heads = byte_pairs(data, starts, ends, at, depth)
                    n = np.diff(at)  # never 0: every text has its end
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows_.column("doc_id"),
                            rows_.column("train"),
                            pa.array(n.astype(np.int64)),
                            pa.array(np.add.reduceat(count > 0, at[:-1], dtype=np.int64)),
                            pa.array(np.full(len(n), n_all, dtype=np.int64)),
                            pa.array(np.add.reduceat(np.log10(count + 1), at[:-1]) - n * np.log10(n_all + n_words + 1)),
                            pa.array(np.add.reduceat(lookup(PAIR_KEY, pairs), heads)),
                        ],
                        ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(run, schema)
