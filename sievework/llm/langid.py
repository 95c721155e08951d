"""Language identification in two steps: the family first, then the language within it.

A text is the square root of its hashed byte n-gram frequencies (n = 1, 2, 3 over the whole
text, A-Z lower-cased), scaled to length one. Linear support vector machines, one for each pair of
families, vote for the family; within it one for each pair of its languages votes for the language.
They are fitted by dual coordinate descent on a bounded sample: at most ``per_language`` labelled
documents of each language, those of the smallest hash of their id. Scoring is a map over the
batches of all texts; nothing is shuffled.

A null text or one without a letter is ``und`` with score 0, as is everything if nothing was
learned. Rows without a language are never learned from. The score is the vote for the family times
the vote for the language, each the mean of the logistic function of the margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import textbatch as tb

#: Families of languages by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga cy br gd".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indo-aryan": "hi bn ur mr ne gu pa".split(),
    "semitic": "ar he mt am".split(),
}
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LangSpec:
    dims: int = 2048
    per_language: int = 1000
    penalty: float = 4.0
    epochs: int = 15
    families: dict[str, list[str]] = field(default_factory=lambda: FAMILIES)


@dataclass
class LangModel:
    """Weights (dims + 1, the last is the offset) for each pair of classes at each node of the tree."""

    dims: int
    members: dict[str, list[str]]
    pairs: dict[str, dict[tuple[str, str], np.ndarray]]


def features(raw: np.ndarray, offs: np.ndarray, dims: int) -> np.ndarray:
    """One row of ``dims`` + 1 numbers for each text."""
    n = len(offs) - 1
    out = np.zeros((n, dims + 1), dtype=np.float32)
    if len(raw):
        b = tb.TO_LOWER[raw].astype(np.uint32)
        doc = np.repeat(np.arange(n, dtype=np.int64) * dims, np.diff(offs))
        # An n-gram over a text's end belongs to no text: its place in ``doc`` differs.
        code = b.copy()
        counts = np.zeros(n * dims, dtype=np.int64)
        for size in (1, 2, 3):
            if size > 1:
                code = code[:-1] * np.uint32(256) + b[size - 1 :]
                inside = doc[: len(code)] == doc[size - 1 :]
            else:
                inside = slice(None)
            if len(code) == 0:
                break
            slot = ((code + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(8)
            counts += np.bincount((doc[: len(code)] + slot % np.uint32(dims))[inside], minlength=n * dims)
        x = np.sqrt(counts.reshape(n, dims), dtype=np.float32)
        out[:, :dims] = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    out[:, dims] = 1.0
    return out


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, penalty: float, epochs: int) -> np.ndarray:
    """Linear support vector machine (hinge loss) by dual coordinate descent on some rows of x.

    y is +1 or -1 for each of them; the smaller class weighs as much as the larger.
    """
    w = np.zeros(x.shape[1], dtype=np.float64)
    alpha = np.zeros(len(rows))
    norms = np.einsum("ij,ij->i", x, x, dtype=np.float64)[rows]
    limit = penalty * len(rows) / (2.0 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            own = x[rows[i]]
            gradient = y[i] * (own @ w) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * own
                alpha[i] = new
    return w.astype(np.float32)


def _has_letter(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    data = raw.tobytes()
    return np.array([LETTER.search(data[a:b].decode("utf-8", "replace")) is not None for a, b in zip(offs[:-1], offs[1:])], dtype=bool)


def train(docs: DataFrame, spec: LangSpec = LangSpec(), where: Column | None = None) -> LangModel:
    """Fit on labelled rows of ``docs`` (doc_id, text, lang) that satisfy ``where``."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        rows = rows.filter(where)
    found = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    place = F.xxhash64(F.lit("langid"), "doc_id")
    share = F.lit(None).cast("double")
    for lang, n in found.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * spec.per_language / n))).otherwise(share)
    sample = rows.filter((place / 2.0**64) + 0.5 < share).select(place.alias("place"), "lang", "text")
    dims = spec.dims

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in tb.slices(batch, "text"):
                ok = _has_letter(raw, offs)
                x = features(raw, offs, dims)[:, :dims].astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("place").filter(pa.array(ok)), part.column("lang").filter(pa.array(ok)), pa.array([v.tobytes() for v in x[ok]], pa.binary())],
                    ["place", "lang", "x"],
                )

    # About 1.2 per_language vectors of 2 dims bytes for each language.
    got = sample.mapInArrow(vectors, "place long, lang string, x binary").toArrow().to_pandas()
    got = got.sort_values(["lang", "place"]).groupby("lang").head(spec.per_language)
    x = np.ones((len(got), dims + 1), dtype=np.float32)
    if len(got):
        x[:, :dims] = np.stack([np.frombuffer(v, dtype=np.float16) for v in got["x"]])
    labels = got["lang"].to_numpy()
    of = {lang: family for family, langs in spec.families.items() for lang in langs}
    members: dict[str, list[str]] = {}
    for lang in sorted(set(labels)):
        members.setdefault(of.get(lang, lang), []).append(lang)
    family = np.array([of.get(v, v) for v in labels], dtype=object)

    def machines(classes: list[str], truth: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        out = {}
        for a, b in combinations(classes, 2):
            rows = np.flatnonzero((truth == a) | (truth == b))
            out[a, b] = fit_svm(x, rows, np.where(truth[rows] == a, 1.0, -1.0), spec.penalty, spec.epochs)
        return out

    pairs = {"": machines(sorted(members), family)}
    for name, langs in members.items():
        pairs[name] = machines(langs, labels)
    return LangModel(dims, {"": sorted(members)} | members, pairs)


def _vote(x: np.ndarray, classes: list[str], pairs: dict[tuple[str, str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winning class and its mean probability; ties of votes go to the larger mean."""
    votes = np.zeros((len(x), len(classes)))
    chance = np.zeros((len(x), len(classes)))
    for (a, b), w in pairs.items():
        i, j = classes.index(a), classes.index(b)
        p = 1.0 / (1.0 + np.exp(-2.0 * np.clip((x @ w).astype(np.float64), -30, 30)))
        votes[:, i] += p >= 0.5
        votes[:, j] += p < 0.5
        chance[:, i] += p
        chance[:, j] += 1 - p
    chance = chance / max(1, len(classes) - 1) if len(classes) > 1 else np.ones_like(chance)
    best = np.argmax(votes + chance / 2, axis=1)
    return best, chance[np.arange(len(x)), best]


def predict(docs: DataFrame, model: LangModel, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, which replace others of their names; only ``text`` is looked at."""
    docs = docs.drop(lang, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in tb.slices(batch, text):
                n = part.num_rows
                names, scores = np.full(n, "und", dtype=object), np.zeros(n)
                ok = np.flatnonzero(_has_letter(raw, offs)) if model.members[""] else []
                if len(ok):
                    x = features(raw, offs, model.dims)[ok]
                    family, p = _vote(x, model.members[""], model.pairs[""])
                    for f, name in enumerate(model.members[""]):
                        rows = np.flatnonzero(family == f)
                        if len(rows):
                            within, q = _vote(x[rows], model.members[name], model.pairs[name])
                            names[ok[rows]] = np.array(model.members[name], dtype=object)[within]
                            scores[ok[rows]] = p[rows] * q
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, lang, score]
                )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{lang}` string", f"`{score}` double"])
    return docs.mapInArrow(run, schema)
