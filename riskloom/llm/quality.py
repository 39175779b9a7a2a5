"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so have a few pairs of
features. Tables are learnt by boosting in a cycle: feature after feature, a tree of depth
two is fitted to the gradient and hessian of the logistic loss in its bins, shrunk and
added to the feature's table; then the same for the pairs whose residual a depth-two tree
explains best. A score is the logistic function of a sum of table entries.

Features need the whole text once and nothing else; a fit reads at most ``Gam.max_rows``
labelled rows (lowest hashed ids first, so reruns agree), and only those reach the driver,
as one vector of numbers each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = [
    "words", "word_length", "distinct_words", "top_word", "repeated_next", "distinct_triples", "lines", "repeated_lines",
    "line_length", "digits", "capitals", "punctuation", "symbols", "exclamations", "bars", "beyond_ascii",
]
_CODES = np.arange(256)


def _set_of(chars: bytes) -> np.ndarray:
    return np.isin(_CODES, np.frombuffer(chars, np.uint8))


_DIGIT, _UPPER = _set_of(b"0123456789"), (_CODES >= 65) & (_CODES <= 90)
_PUNCT, _SYMBOL = _set_of(b".,;:?'\"()-"), _set_of(b"#$%&*+/<=>@[]\\^_`{}~")


def features(text: str | None) -> list[float]:
    """Shares and sizes of the whole text, in the order of ``FEATURES``; all 0 for null and empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = sum(map(len, words))
    common = Counter(words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    share = lambda mask: float(count[mask].sum()) / solid
    return [
        float(np.log1p(n)), solid / n, len(common) / n, max(common.values()) / n, repeated / n, triples,
        float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines), float(np.log1p(len(raw) / len(lines))),
        share(_DIGIT), share(_UPPER), share(_PUNCT), share(_SYMBOL), count[33] / solid, common.get(b"|", 0) / n,
        share(_CODES >= 128),
    ]


@dataclass
class Gam:
    """``max_rows`` bounds the labelled rows of a fit."""

    max_rows: int = 20_000
    bins: int = 32
    rounds: int = 150
    pairs: int = 6
    pair_rounds: int = 60
    rate: float = 0.1
    ridge: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        """No rows, or one class only: a constant, the share of label 1 with one added to each class."""
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(y) == 0 or y.min() == y.max():
            return self
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], cuts, method="higher")) for k in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        b, logit = self._bins(x), np.full(len(y), self.base)

        def push(table: np.ndarray, cell: np.ndarray) -> None:
            p = 1 / (1 + np.exp(-logit))
            g = np.bincount(cell, y - p, table.size).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            step = self.rate * _tree(g, h, self.ridge, 2)[0]
            table += step
            logit[:] += step.ravel()[cell]

        for _ in range(self.rounds):
            for k, table in enumerate(self.tables):
                push(table, b[:, k])
        p, found = 1 / (1 + np.exp(-logit)), []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                shape = (len(self.tables[i]), len(self.tables[j]))
                cell = b[:, i] * shape[1] + b[:, j]
                g = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape)
                h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
                found.append((-_tree(g, h, self.ridge, 2)[1], i, j))
        self.pair_tables = {
            (i, j): np.zeros((len(self.tables[i]), len(self.tables[j]))) for _, i, j in sorted(found)[: self.pairs]
        }
        for _ in range(self.pair_rounds):
            for (i, j), table in self.pair_tables.items():
                push(table, b[:, i] * table.shape[1] + b[:, j])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        if self.tables and len(x):
            b = self._bins(x)
            for k, table in enumerate(self.tables):
                logit += table[b[:, k]]
            for (i, j), table in self.pair_tables.items():
                logit += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-logit))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> tuple[np.ndarray, float]:
    """Leaf values over the grid of bins and the gain, splitting along any axis."""
    total, weight = g.sum(), h.sum()
    whole = total * total / (weight + ridge)
    best = (1e-9, None, 0)
    if depth:
        for axis in range(g.ndim):
            others = tuple(a for a in range(g.ndim) if a != axis)
            left, w = np.cumsum(g.sum(axis=others))[:-1], np.cumsum(h.sum(axis=others))[:-1]
            if len(left):
                gain = left**2 / (w + ridge) + (total - left) ** 2 / (weight - w + ridge) - whole
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], axis, k + 1)
    if best[1] is None:
        return np.full(g.shape, total / (weight + ridge)), 0.0
    (ga, gb), (ha, hb) = (np.split(m, [best[2]], axis=best[1]) for m in (g, h))
    (a, gain_a), (b, gain_b) = _tree(ga, ha, ridge, depth - 1), _tree(gb, hb, ridge, depth - 1)
    return np.concatenate([a, b], axis=best[1]), best[0] + gain_a + gain_b


def in_fold(id_col: Column) -> Column:
    """The fold that is never learnt from; a null id is not in it."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", gam: Gam | None = None) -> Gam:
    """Fit on labelled rows outside the held-out fold. Null ids and labels are left out."""
    gam = gam or Gam()
    order = F.xxhash64(F.col("id").cast("string"))
    marked = (
        labels.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~in_fold(F.col("id")))
        .orderBy(order, "id", "y").limit(gam.max_rows)
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"]
            )

    # F.broadcast: at most max_rows rows of two numbers
    found = texts.join(F.broadcast(marked), "id").select("id", "y", "text").mapInArrow(run, "id bigint, y int, x array<double>")
    rows = found.orderBy(order, "id", "y", "x").limit(gam.max_rows).collect()
    return gam.fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r["y"]) for r in rows]))


def score_quality(docs: DataFrame, gam: Gam, text_col: str = "text", threshold: float = 0.3, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` in (0, 1) and ``predicted`` (1 from the threshold on).

    Null and empty texts are scored like any other row, from features that are all 0.
    Every column of ``docs`` is kept; one named like a new column is replaced. Rows are
    scored one by one, so repeated rows get equal scores and an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in (score, predicted)]
    schema = docs.select(*kept).schema.add(score, "double").add(predicted, "integer")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            s = gam.score(x)
            more = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*kept, score, predicted])

    return docs.select(*kept).mapInArrow(run, schema)
