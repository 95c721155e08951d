"""Best-fit packing with exact complements.

Texts become token ids and are cut into pieces; each piece is a row of numbers. Only the counts of
the ``capacity`` possible lengths reach the driver. There a sequence is built from the longest
length left: an index over lengths tells whether one, two or three lengths under their remaining
counts fill the gap exactly; if not, the longest length that fits is placed and the search goes on
with the smaller gap. The pattern found is used as often as the counts allow, so the plan has at
most a few patterns per length, whatever the number of pieces.

Pieces of one length are numbered and take the places that the plan has for that length. A length
with many pieces is numbered in buckets by hash, from counts per bucket, so no task sees it whole.

Tokenization splits texts before white space that follows something else, where no token of the
pattern can go across, and encodes each distinct segment of a slice once. Ids are those of the
byte-level vocabulary at ``ranks_path``. With ``added_path`` the strings of the added tokens of that
tokenizer file get the ids they have there, as `tokenizers` does by default; without it they are
ordinary text. The tests compare both with the same vocabulary read by `tokenizers`.

A null text is empty: one piece with the end id alone. Repeated rows are packed one by one. Empty
table: no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import textbatch as tb
from sievework.llm.common import written


@dataclass(frozen=True)
class PackSpec:
    """``ranks_path``: a vocabulary file of base64 tokens and ranks; None: the installed one.

    ``added_path``: a tokenizer file (JSON) whose added tokens are recognised; "installed": the
    installed one; None: none are.
    """

    capacity: int = 1024
    end_id: int = 2
    ranks_path: str | None = None
    bucket_rows: int = 20_000
    added_path: str | None = None


#: As the contract of the queries has it: added tokens are recognised.
CONTRACT = PackSpec(added_path="installed")


# --- tokens ------------------------------------------------------------------------------

_ENCODERS: dict[tuple[str | None, str | None], object] = {}
#: Distinct segments whose ids a worker keeps; beyond it starts afresh.
CACHE_SEGMENTS = 400_000


def added_tokens(path: str | None) -> dict[str, int]:
    """String and id of the added tokens of a tokenizer file."""
    import json

    import public_tokenizers

    if path is None:
        return {}
    with open(public_tokenizers.path("byte_bpe_50k.json") if path == "installed" else path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"] or any(c.isspace() for c in t["content"]):
            raise ValueError(f"added token {t['content']!r}: white space and flags are not supported")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str | None, added: str | None = None):
    import base64

    import public_tokenizers
    import tiktoken

    if (path, added) not in _ENCODERS:
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        special = added_tokens(added)
        _ENCODERS[path, added] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path, added]


def segment_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of texts, and of ASCII white space right after a character that is not white space."""
    space = tb.IS_SPACE[raw]
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = space[1:] & ~space[:-1]
    # White space outside ASCII: U+0085 and U+00A0 in two bytes, others in three (E1 9A, E2 80, E2 81, E3 80).
    two = np.flatnonzero(raw[:-1] == 0xC2) + 1
    cut[(two + 1)[(two + 1 < len(raw)) & ((raw[two] == 0x85) | (raw[two] == 0xA0))]] = False
    if len(raw) > 3:
        three = np.flatnonzero((raw[:-3] >= 0xE1) & (raw[:-3] <= 0xE3) & ((raw[1:-2] == 0x80) | (raw[1:-2] == 0x81) | (raw[1:-2] == 0x9A)))
        cut[three + 3] = False
    cut[offs[:-1][offs[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


def token_ids(raw: np.ndarray, offs: np.ndarray, enc, cache: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the n + 1 offsets of the texts in them."""
    starts = segment_starts(raw, offs)
    if len(starts) == 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    ends = np.append(starts[1:], len(raw))
    keys, first, which = np.unique(tb.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    data, added = raw.tobytes(), enc.special_tokens_set
    if len(cache) > CACHE_SEGMENTS:
        cache.clear()
    found = []
    for key, a, b in zip(keys.tolist(), starts[first].tolist(), ends[first].tolist()):
        ids = cache.get(key)
        if ids is None:
            text = data[a:b].decode("utf-8", "replace")
            ids = enc.encode(text, allowed_special="all") if any(t in text for t in added) else enc.encode_ordinary(text)
            ids = cache[key] = np.array(ids, dtype="<u4").tobytes()
        found.append(ids)
    pool = np.frombuffer(b"".join(found), dtype="<u4")
    sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
    lengths = sizes[which]
    ids = tb.gather(pool, (np.cumsum(sizes) - sizes)[which], lengths)
    ends_of = np.concatenate([[0], np.cumsum(lengths)])
    return ids, ends_of[np.searchsorted(starts, offs)]


def cut_pieces(docs: DataFrame, spec: PackSpec = PackSpec(), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids of every piece."""
    capacity, end_id, path, added = spec.capacity, spec.end_id, spec.ranks_path, spec.added_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = encoder(path, added), {}
        for batch in batches:
            for part, raw, offs in tb.slices(batch, "text"):
                ids, at = token_ids(raw, offs, enc, cache)
                doc, number, start, length, crc, lists = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    edge = n % capacity or capacity
                    for k, (a, b) in enumerate(zip([0, *range(edge, n, capacity)], [*range(edge, n, capacity), n])):
                        doc.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                        if with_ids:
                            lists.append(own[a:b].astype(np.int32))
                columns = [
                    part.column("doc_id").take(pa.array(doc, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the plan ----------------------------------------------------------------------------


def _exact(left: np.ndarray, gap: int, depth: int) -> list[int] | None:
    """One, two or three (``depth``) available lengths that sum to ``gap``, longest first."""
    if depth == 1:
        return [gap] if left[gap] > 0 else None
    if depth == 2:
        high = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = np.flatnonzero((left[high] > 0) & (left[gap - high] > (high == gap - high)))
        return [int(high[ok[0]]), gap - int(high[ok[0]])] if len(ok) else None
    for a in np.flatnonzero(left[1 : gap - 1] > 0)[::-1] + 1:
        if 3 * a < gap:
            break
        left[a] -= 1
        rest = _exact(left, gap - int(a), 2) if gap - a >= 2 else None
        left[a] += 1
        if rest:
            return [int(a), *rest]
    return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of one sequence) until no piece is left; ``counts[n]`` pieces have length n."""
    left = counts.astype(np.int64).copy()
    out = []
    longest = capacity
    while True:
        while longest and left[longest] == 0:
            longest -= 1
        if longest == 0:
            return out
        pattern, gap = [longest], capacity - longest
        trial = left.copy()
        trial[longest] -= 1
        while gap:
            fill = next((x for depth in (1, 2, 3) if gap >= depth and (x := _exact(trial, gap, depth))), None)
            if fill is None:
                fits = np.flatnonzero(trial[1 : gap + 1] > 0)
                if len(fits) == 0:
                    break
                fill = [int(fits[-1]) + 1]
            for n in fill:
                trial[n] -= 1
                gap -= n
                pattern.append(n)
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        out.append((times, pattern))


def places(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of places, by length and number: pieces [first, first + times) of a length go to
    sequences base, base + 1, ... at one offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, pattern in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def pack_pieces(pieces: DataFrame, spec: PackSpec = PackSpec()) -> DataFrame:
    """``pieces`` (with a column length, at most ``capacity``) with sequence_id and offset."""
    pieces = written(pieces, "pieces")
    counts = np.zeros(spec.capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r[0]] = r[1]
    runs = places(plan(counts, spec.capacity))
    n_buckets = max(1, -(-int(counts.max()) // spec.bucket_rows))
    keyed = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    along = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "__b", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("__skip")
    )
    inside = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("__rank", F.row_number().over(inside) - 1).join(offsets, ["length", "__b"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col("__rank") + F.col("__skip")).cast("long").alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(runs["first"].max(initial=0)) + 1
        keys = runs["length"] * step + runs["first"]  # ascending; below 2^63 for 10^15 pieces of a length
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("__rank", "length"))
            at = np.searchsorted(keys, length * step + np.minimum(rank, step - 1), "right") - 1
            placed = [pa.array(runs["base"][at] + rank - runs["first"][at]), pa.array(runs["offset"][at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *placed], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join([f"`{n}` {t}" for n, t in pieces.dtypes] + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, spec: PackSpec = PackSpec(), with_ids: bool = False) -> DataFrame:
    """Pieces of all texts with their sequence and place in it."""
    return pack_pieces(cut_pieces(docs, spec, with_ids), spec)
