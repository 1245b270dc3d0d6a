"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the text only.  Shallow trees, boosted in turn on one
feature after the other, are added up in a lookup table per feature; then
tables over pairs of features are boosted on what is left.  A score is the sum of
a document's table entries, found by binning.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import crc_bucket, pieces, text_bytes

#: At most this many labelled documents, those with the smallest hashes, are taken to fit the tables.
SAMPLE_ROWS = 30_000
THRESHOLD = 0.3

_KINDS = ["upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "mark", "bracket", "other", "beyond", "tail"]


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 0xC0:
        return _KINDS.index("beyond")
    if b >= 0x80:
        return _KINDS.index("tail")
    if c.isalpha():
        return _KINDS.index("upper" if c.isupper() else "lower")
    for name, chars in (("digit", "0123456789"), ("newline", "\n"), ("stop", ".:;"), ("comma", ","), ("bang", "!?"), ("bar", "|"), ("mark", "#*$%&@^~=+"), ("bracket", "<>{}[]()")):
        if c in chars:
            return _KINDS.index(name)
    return _KINDS.index("space" if c.isspace() else "other")


_KIND_TABLE = bytes(_kind(b) for b in range(256))

FEATURES = [
    "log_words", "word_length", "long_words", "short_words", "distinct", "once_run", "upper", "digit", "stop", "comma", "bang", "bar", "mark",
    "bracket", "other", "beyond", "line_words", "dup_lines", "short_lines", "no_stop_lines", "top_word", "marked_words", "marked_most", "capital_words", "mixed_words",
]


def features_of(body: bytes) -> list[float]:
    """The features of one whole text; an empty one has zeros."""
    words = body.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(body.translate(_KIND_TABLE), np.uint8)
    count = dict(zip(_KINDS, np.bincount(codes, minlength=len(_KINDS)).tolist(), strict=True))
    letters = max(1, count["upper"] + count["lower"] + count["beyond"])
    lengths = np.fromiter(map(len, words), np.int64, n)
    lowered = body.lower().split()
    sizes = np.fromiter(Counter(lowered).values(), np.int64)
    lines = [x for x in body.split(b"\n") if x.strip()]
    per_line = np.array([x.count(b" ") + 1 for x in lines])
    # Words with a mark or bar, over the text and in its worst stretch of 32 words.
    odd = (codes == _KINDS.index("mark")) | (codes == _KINDS.index("bar")) | (codes == _KINDS.index("bang"))
    gap = (codes == _KINDS.index("space")) | (codes == _KINDS.index("newline"))
    word_at = np.cumsum(np.concatenate([[0], (gap[:-1] & ~gap[1:])]).astype(np.int64))
    with_odd = np.zeros(int(word_at[-1]) + 1, np.int64)
    with_odd[word_at[odd]] = 1
    run = np.concatenate([[0], np.cumsum(with_odd)])
    k = min(32, len(with_odd))
    capital = sum(1 for w in words if w.isupper())
    return [
        np.log1p(n),
        lengths.mean(),
        (lengths > 12).mean(),
        (lengths <= 3).mean(),
        len(sizes) / n,
        (sizes == 1).sum() / n,
        count["upper"] / letters,
        count["digit"] / n,
        count["stop"] / n,
        count["comma"] / n,
        count["bang"] / n,
        count["bar"] / n,
        count["mark"] / n,
        count["bracket"] / n,
        count["other"] / n,
        count["beyond"] / letters,
        min(200.0, per_line.mean()),
        1 - len(set(lines)) / len(lines),
        (per_line <= 3).mean(),
        sum(1 for x in lines if x.rstrip()[-1:] not in b".!?:") / len(lines),
        sizes.max() / n,
        with_odd.mean(),
        (run[k:] - run[:-k]).max() / k,
        capital / n,
        (count["upper"] - capital) / n,
    ]


@dataclass
class AdditiveModel:
    """Lookup tables: one for each feature over its bins, one for each chosen pair over coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        return fine, [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.binned(x)
        out = np.full(len(x), self.intercept)
        for b, t in zip(fine, self.tables, strict=True):
            out += t[b]
        for (p, q), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[p], coarse[q]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _edges(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, n) / n)) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values over bins of a tree of that depth, grown greedily on sums of gradients and Hessians."""
    value = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
    k = int(np.argmax(gain))
    if gain[k] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return value
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, ridge, least), _tree(g[k + 1 :], h[k + 1 :], depth - 1, ridge, least)])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 12, rounds: int = 80, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15, depth: int = 2) -> AdditiveModel:
    """Cyclic boosting on logistic loss; without rows, or with one class only, the model is a constant."""
    model = AdditiveModel([_edges(c, bins) for c in x.T], [_edges(c, coarse_bins) for c in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    if not len(y):
        return model
    fine, coarse = model.binned(x)
    f = np.full(len(y), model.intercept)
    ridge, least = 1.0, 2.0
    for _ in range(rounds):
        for b, t in zip(fine, model.tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), depth, ridge, least)
            t += step
            f += step[b]

    def cells(p: int, q: int) -> np.ndarray:
        return coarse[p] * (len(model.coarse[q]) + 1) + coarse[q]

    def sums(p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[p]) + 1, len(model.coarse[q]) + 1)
        pr = 1 / (1 + np.exp(-f))
        at, n = cells(p, q), shape[0] * shape[1]
        return np.bincount(at, y - pr, n).reshape(shape), np.bincount(at, pr * (1 - pr), n).reshape(shape)

    def gain(p: int, q: int) -> float:
        g, h = sums(p, q)
        return float((g**2 / (h + 5)).sum() - (g.sum(1) ** 2 / (h.sum(1) + 5)).sum() - (g.sum(0) ** 2 / (h.sum(0) + 5)).sum())

    ranked = sorted(((gain(p, q), p, q) for p in range(x.shape[1]) for q in range(p)), reverse=True)
    model.pairs = [(p, q) for _, p, q in ranked[:pairs]]
    model.pair_tables = [np.zeros((len(model.coarse[p]) + 1, len(model.coarse[q]) + 1)) for p, q in model.pairs]
    for _ in range(pair_rounds):
        for (p, q), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = sums(p, q)
            # A tree of depth two: the best cut of one feature, then of the other on either side.
            k = int(np.argmax([_cut_gain(g, h, i) for i in range(1, g.shape[0])])) + 1 if g.shape[0] > 1 else g.shape[0]
            step = np.zeros_like(t)
            for part in (slice(0, k), slice(k, None)):
                if g[part].size:
                    step[part] = _tree(g[part].sum(0), h[part].sum(0), 1, 5.0, least)
            t += rate * step
            f += rate * step[coarse[p], coarse[q]]
    return model


def _cut_gain(g: np.ndarray, h: np.ndarray, i: int) -> float:
    return sum(float((x.sum(0) ** 2 / (z.sum(0) + 5)).sum()) for x, z in ((g[:i], h[:i]), (g[i:], h[i:])))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [features_of(x) for x in text_bytes(batch, 0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS, folds: int = 5) -> AdditiveModel:
    """Fits on labelled documents whose crc32(doc_id as text) mod ``folds`` is not 0, at most ``sample`` of them, chosen by the hash of the id.

    Only ids and labels of the sample, then its features, come to the driver; rows with null ids or labels are left out.  An id
    with several labels has the smallest of them, one with several texts the smallest features.
    """
    used = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (crc_bucket(F.col(doc_id), folds) != 0))
    used = used.groupBy(F.col(doc_id).cast("string").alias("__id")).agg(F.min(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    joined = docs.select(F.col(doc_id).cast("string").alias("__d"), F.col(text).cast("string").alias("__text")).join(F.broadcast(used), F.col("__d") == F.col("__id"))
    made = joined.select("__text", "__id", "y").mapInArrow(_features, "id string, y int, x array<double>")
    rows = made.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.x", "r.y").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums must not depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text; null and empty texts have features of 0, and all rows and columns stay."""
    columns = [c for c in docs.columns if c != name]
    at = columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = np.array([features_of(x) for x in text_bytes(batch, at)], float).reshape(-1, len(FEATURES))
            out = sent.value.score(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return docs.select(*columns).mapInArrow(run, schema)
