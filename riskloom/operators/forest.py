"""Random forests without a depth limit.

The upper levels of all trees grow together: a level is one pass that sums class histograms
of the open nodes over the tasks, and a node is split at the best of its binned thresholds.
As soon as a node's rows fit a task they are sent there, and the node is finished on their
true values, down to pure leaves or rows that no column tells apart. Bins are chosen so
narrow that a bin with more rows than a task takes is a single value.

Rows are drawn with replacement by Poisson counts hashed from (row, tree), columns of a node
by its place in the tree, so a re-run gives the same forest.

A model is the trees' upper parts, which are few nodes, and a table of finished parts, which
grows with the rows. Small tables are sent to the tasks; with large ones rows are sent to the
parts that they reach.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from ..session import scratch, write_out
from .packed import binned, blocks, matrix, summed
from .quantiles import exact_quantiles

NODE_ROWS = 50_000  # drawn rows of a node that one task finishes
LEAST_BINS, MOST_BINS = 64, 60_000
HISTOGRAM_BYTES = 64 << 20  # class counts a task holds in a pass
SENT_BYTES = 64 << 20  # finished parts that are sent to every task
_STATE = "n bigint, bins binary, x binary, label binary, key binary"
_PARTS = "tree int, node int, body binary, importance array<double>"

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class ForestSettings:
    """``features`` of a node: their number, or None for the root of all. ``bootstrap`` off
    gives every row to every tree once."""

    trees: int = 100
    seed: int = 42
    features: int | None = None
    bootstrap: bool = True
    node_rows: int = NODE_ROWS


def draws(keys: np.ndarray, tree: int, settings: ForestSettings) -> np.ndarray:
    """How often each row is in a tree's sample."""
    if not settings.bootstrap:
        return np.ones(len(keys), np.int64)
    with np.errstate(over="ignore"):
        salt = _stirred(np.array([(settings.seed * 1_000_003 + tree) % (1 << 64)], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        u = (_stirred(keys.astype(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(_POISSON, u, "right")


def _gini(counts: np.ndarray) -> np.ndarray:
    """Weighted impurity: total times the Gini index, over the last axis."""
    total = counts.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, total - (counts**2).sum(axis=-1) / total, 0.0)


def _order(tree: int, node: int, width: int, seed: int) -> np.ndarray:
    """The order in which a node tries the columns."""
    return np.random.default_rng([seed & 0x7FFFFFFF, tree, node]).permutation(width)


# The part of a tree that one task finishes


def _grow(x: np.ndarray, label: np.ndarray, weight: np.ndarray, class_weight: np.ndarray, wanted: int, order: Callable[[int], np.ndarray]):
    """Nodes as [feature, threshold, left, right] and class weights, and the impurity each
    column has taken away. ``weight`` has whole numbers, so that sums don't depend on order."""
    classes, nodes, values, gains = len(class_weight), [], [], np.zeros(x.shape[1])
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        rows, above, side = stack.pop()
        me = len(nodes)
        if above >= 0:
            nodes[above][2 + side] = me
        counts = np.bincount(label[rows], weight[rows], classes)
        nodes.append([-1, 0.0, -1, -1])
        values.append(counts * class_weight)
        if np.count_nonzero(counts) < 2:
            continue
        whole, best, seen = float(_gini(counts * class_weight)), None, 0
        for f in order(me):
            if seen >= wanted and best is not None:
                break
            v = x[rows, f]
            by = np.argsort(v, kind="stable")
            v = v[by]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            seen += 1
            held = np.zeros((len(rows), classes))
            held[np.arange(len(rows)), label[rows][by]] = weight[rows][by]
            left = np.cumsum(held, axis=0)[ends]
            gain = whole - _gini(left * class_weight) - _gini((counts - left) * class_weight)
            k = int(gain.argmax())
            # Of equal gains the lower column's and the lower threshold's.
            if best is None or (round(float(gain[k]), 9), -f) > (round(best[0], 9), -best[1]):
                a, b = v[ends[k]], v[ends[k] + 1]
                middle = a + (b - a) / 2
                best = float(gain[k]), int(f), float(middle if a <= middle < b else a)
        if best is None:
            continue
        gain, f, cut = best
        gains[f] += gain
        nodes[me][:2] = f, cut
        low = x[rows, f] <= cut
        stack += [(rows[~low], me, 1), (rows[low], me, 0)]
    return np.array(nodes, float).reshape(-1, 4), np.array(values), gains


def _reached(values: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The leaf each row ends in; NaN goes right."""
    at, live = np.zeros(len(values), np.int64), np.arange(len(values))
    feature, children = nodes[:, 0].astype(int), nodes[:, 2:].astype(int)
    while len(live):
        live = live[feature[at[live]] >= 0]
        f = feature[at[live]]
        right = ~(values[live, f] <= nodes[at[live], 1])
        at[live] = children[at[live], right.astype(int)]
    return at


def _shares(values: np.ndarray) -> np.ndarray:
    total = values.sum(axis=-1, keepdims=True)
    return np.divide(values, total, out=np.full(values.shape, 1 / values.shape[-1]), where=total > 0)


# The upper part of a tree


@dataclass
class _Top:
    """Nodes in the order they were made. ``state`` is open, leaf or part (finished by a task)."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    state: list = field(default_factory=lambda: ["open"])
    value: list = field(default_factory=lambda: [None])
    gains: list = field(default_factory=list)

    def child(self, counts: np.ndarray, state: str) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.bin, 0), (self.left, -1), (self.right, -1), (self.state, state), (self.value, counts.tolist())):
            column.append(v)
        return len(self.feature) - 1

    def nodes(self, cuts: list) -> np.ndarray:
        return np.array([self.feature, cuts, self.left, self.right], float).T

    def place(self, bins: np.ndarray) -> np.ndarray:
        return _reached(bins, self.nodes(self.bin))

    def reach(self, values: np.ndarray) -> np.ndarray:
        return _reached(values, self.nodes(self.cut))


def narrow_cuts(df: DataFrame, columns: Sequence[str], rows: int, node_rows: int) -> list[np.ndarray]:
    """Thresholds that leave a bin a quarter of ``node_rows`` at most, or a single value."""
    count = min(MOST_BINS, max(LEAST_BINS, 4 * rows // max(node_rows, 1)))
    found = {r["column_name"]: r["q"] for r in exact_quantiles(df, columns, [k / count for k in range(1, count + 1)]).collect()}
    cuts = []
    for c in columns:
        values, times = np.unique(np.array(found[c] or [], float), return_counts=True)
        below = np.nextafter(values[times > 1], -np.inf)  # a value that fills a bin gets one of its own
        cuts.append(np.unique(np.concatenate([values[:-1], below])))
    return cuts


@dataclass
class Forest:
    """``tops`` are the upper parts; ``parts`` has the finished ones: (tree, node, body, importance)."""

    columns: list[str]
    classes: int
    tops: list[dict]
    parts: DataFrame
    importances: list[float]


def fit_forest(
    df: DataFrame, columns: Sequence[str], classes: int, class_weight: Sequence[float] | None = None,
    settings: ForestSettings = ForestSettings(), label: str = "label",
) -> Forest:
    """A forest on the number ``columns`` and ``label`` (0, 1, ..); rows with a null value take no part."""
    columns = list(columns)
    with scratch(df.sparkSession):
        return _fitted(df, columns, classes, np.ones(classes) if class_weight is None else np.array(class_weight, float), settings, label)


def _fitted(df, columns, classes, class_weight, settings, label_col) -> Forest:
    width = len(columns)
    wanted = settings.features or max(1, int(math.sqrt(width)))
    rows = df.select(*[quoted(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)], quoted(label_col).cast("int").alias("label")).dropna()
    rows = write_out(rows.withColumn("key", F.monotonically_increasing_id()), "forest-rows")
    inputs = [f"f{i}" for i in range(width)]
    count = rows.count()
    cuts = narrow_cuts(rows, inputs, count, settings.node_rows) if count > settings.node_rows else [np.empty(0)] * width
    bins = max(len(c) for c in cuts) + 1

    def pack(batch: pa.RecordBatch) -> dict:
        x = matrix(batch, inputs)
        return {
            "n": batch.num_rows, "bins": binned(x, cuts), "x": x, "label": batch.column("label").to_numpy().astype(np.int32),
            "key": batch.column("key").to_numpy(),
        }

    state = blocks(rows, _STATE, pack).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = state.rdd.getNumPartitions()

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        n = row["n"]
        return (
            np.frombuffer(row["bins"], np.uint16).reshape(n, width), np.frombuffer(row["x"]).reshape(n, width),
            np.frombuffer(row["label"], np.int32), np.frombuffer(row["key"], np.int64),
        )

    tops = [_Top(gains=[0.0] * width) for _ in range(settings.trees)]
    if count <= settings.node_rows:
        for top in tops:
            top.state[0] = "part"

    def histograms(asked: list[tuple[int, int, np.ndarray]], at_most: int):
        by: dict[int, list] = {}
        for t, node, chosen in asked:
            by.setdefault(t, []).append((node, chosen))

        def add(row: dict, totals: dict) -> None:
            values, _, label, key = opened(row)
            for t, nodes in by.items():
                times = draws(key, t, settings)
                place = tops[t].place(values)
                for node, chosen in nodes:
                    inside = np.flatnonzero((place == node) & (times > 0))
                    total = totals.setdefault((t, node), np.zeros((at_most, bins, classes)))
                    for k, f in enumerate(chosen):
                        cell = values[inside, f].astype(np.int64) * classes + label[inside]
                        total[k] += np.bincount(cell, times[inside], bins * classes).reshape(bins, classes)

        return add

    def split_all(asked: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        """Split the nodes asked for; gives back those that none of their columns splits."""
        most = max(len(c) for _, _, c in asked)
        size, failed = most * bins * classes * 8, []
        step = max(1, HISTOGRAM_BYTES // size)
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            found = summed(state, tasks, histograms(part, most), (most, bins, classes), len(part))
            for t, node, chosen in part:
                hist, top, best = found.get((t, node)), tops[t], None
                if hist is None:  # no row was drawn
                    top.state[node], top.value[node] = "leaf", [0.0] * classes
                    continue
                whole = hist[0].sum(axis=0)
                top.value[node] = whole.tolist()
                if np.count_nonzero(whole) < 2:
                    top.state[node] = "leaf"
                    continue
                if whole.sum() <= settings.node_rows:  # the root of a small sample
                    top.state[node] = "part"
                    continue
                for k, f in enumerate(chosen):
                    left = np.cumsum(hist[k], axis=0)[: len(cuts[f])]
                    right = whole - left
                    gain = _gini(whole * class_weight) - _gini(left * class_weight) - _gini(right * class_weight)
                    gain = np.where((left.sum(axis=1) > 0) & (right.sum(axis=1) > 0), gain, -np.inf)
                    if len(gain) and np.isfinite(gain.max()):
                        b = int(gain.argmax())
                        if best is None or (round(float(gain[b]), 9), -f) > (round(best[0], 9), -best[1]):
                            best = float(gain[b]), int(f), b, left[b], right[b]
                if best is None:
                    failed.append((t, node))
                    continue
                gain, f, b, left, right = best
                top.gains[f] += gain
                top.feature[node], top.bin[node], top.cut[node], top.state[node] = f, b, float(cuts[f][b]), "split"
                for counts, side in ((left, top.left), (right, top.right)):
                    pure = np.count_nonzero(counts) < 2
                    side[node] = top.child(counts, "leaf" if pure else "part" if counts.sum() <= settings.node_rows else "open")
        return failed

    def columns_of(t: int, node: int) -> np.ndarray:
        return _order(t, node, width, settings.seed)

    while asked := [(t, node, columns_of(t, node)[:wanted]) for t, top in enumerate(tops) for node, s in enumerate(top.state) if s == "open"]:
        if failed := split_all(asked):
            if wanted < width:
                failed = split_all([(t, node, columns_of(t, node)[wanted:]) for t, node in failed])
            for t, node in failed:  # its rows are equal in every column
                tops[t].state[node] = "leaf"

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                values, x, label, key = opened(batch.slice(at, 1).to_pylist()[0])
                for t, top in enumerate(tops):
                    wait = [node for node, s in enumerate(top.state) if s == "part"]
                    if not wait:
                        continue
                    times, place = draws(key, t, settings), top.place(values)
                    out = []
                    for node in wait:
                        inside = np.flatnonzero((place == node) & (times > 0))
                        if len(inside):
                            out.append({
                                "tree": t, "node": node, "first": int(key[inside[0]]), "x": x[inside].tobytes(),
                                "label": label[inside].tobytes(), "times": times[inside].astype(np.int64).tobytes(),
                            })
                    if out:
                        yield pa.RecordBatch.from_pylist(out, _SENT)

    def finish(group: pa.Table) -> pa.Table:
        chunks = sorted(group.to_pylist(), key=lambda r: r["first"])
        t, node = chunks[0]["tree"], chunks[0]["node"]
        x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, width) for r in chunks])
        label = np.concatenate([np.frombuffer(r["label"], np.int32) for r in chunks])
        times = np.concatenate([np.frombuffer(r["times"], np.int64) for r in chunks])
        nodes, values, gains = _grow(
            x, label, times.astype(float), class_weight, wanted,
            lambda k: _order(t, (node + 1) * 1_000_003 + k, width, settings.seed) if wanted < width else np.arange(width),
        )
        body = np.concatenate([nodes, values], axis=1).tobytes()
        return pa.Table.from_pylist([{"tree": t, "node": node, "body": body, "importance": gains.tolist()}], _PART)

    chunks = state.mapInArrow(sent, "tree int, node int, first bigint, x binary, label binary, times binary")
    parts = write_out(chunks.groupBy("tree", "node").applyInArrow(finish, _PARTS), "forest-parts", keep=True)
    state.unpersist()
    gained = parts.select("tree", F.posexplode("importance").alias("f", "gain")).groupBy("tree", "f").agg(F.sum("gain").alias("gain")).collect()
    gains = np.array([top.gains for top in tops], float)
    for r in gained:
        gains[r["tree"], r["f"]] += r["gain"]
    total = gains.sum(axis=1, keepdims=True)
    share = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(axis=0)
    kept = [
        {"nodes": top.nodes(top.cut).tolist(), "value": [(np.array(v or [0.0] * classes) * class_weight).tolist() for v in top.value], "state": top.state}
        for top in tops
    ]
    return Forest(columns, classes, kept, parts, (share / max(share.sum(), 1e-300)).tolist())


_SENT = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("first", pa.int64()), ("x", pa.binary()), ("label", pa.binary()), ("times", pa.binary())])
_PART = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("body", pa.binary()), ("importance", pa.list_(pa.float64()))])


def _part_shares(body: bytes, classes: int, x: np.ndarray) -> np.ndarray:
    table = np.frombuffer(body).reshape(-1, 4 + classes)
    return _shares(table[_reached(x, table[:, :4]), 4:])


def forest_probabilities(df: DataFrame, forest: Forest, name: str = "probability", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Add the mean of the trees' class shares. Null values go right at a split."""
    total = forest.parts.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0
    tops = [(np.array(t["nodes"], float).reshape(-1, 4), np.array(t["value"], float), t["state"]) for t in forest.tops]
    classes, width = forest.classes, len(forest.columns)
    inputs = [quoted(c).cast("double") for c in forest.columns]
    if total <= sent_bytes:
        bodies = {(r["tree"], r["node"]): bytes(r["body"]) for r in forest.parts.select("tree", "node", "body").collect()}

        @F.pandas_udf("array<double>")
        def mean(*series: pd.Series) -> pd.Series:
            x = np.stack([s.to_numpy(float) for s in series], axis=1)
            p = np.zeros((len(x), classes))
            for t, (nodes, value, state) in enumerate(tops):
                at = _reached(x, nodes)
                for node in np.unique(at):
                    here = at == node
                    p[here] += _part_shares(bodies[t, node], classes, x[here]) if state[node] == "part" and (t, node) in bodies else _shares(value[node][None])
            return pd.Series(list(p / max(len(tops), 1)))

        return df.withColumn(name, mean(*inputs))

    # Rows go to the finished parts that they reach, their shares come back.
    rows = write_out(df.withColumn("_key", F.monotonically_increasing_id()), "forest-rows", keep=True)
    numbered = rows.select("_key", *[v.alias(f"f{i}") for i, v in enumerate(inputs)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, keys = matrix(batch, [f"f{i}" for i in range(width)]), batch.column("_key").to_numpy()
            for t, (nodes, value, state) in enumerate(tops):
                at, out = _reached(x, nodes), []
                for node in np.unique(at).tolist():
                    here = at == node
                    known = None if state[node] == "part" else _shares(value[node][None])[0].tolist()
                    out.append({"tree": t, "node": node, "keys": keys[here].tobytes(), "x": x[here].tobytes(), "known": known})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ROUTED)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys, shares = [], []
        body = held.column("body")[0].as_py() if len(held) else None
        for r in asked.to_pylist():
            k = np.frombuffer(r["keys"], np.int64)
            keys.append(k)
            if r["known"] is not None or body is None:
                shares.append(np.tile(r["known"] or [1 / classes] * classes, (len(k), 1)))
            else:
                shares.append(_part_shares(body, classes, np.frombuffer(r["x"]).reshape(-1, width)))
        p = np.concatenate(shares) if shares else np.zeros((0, classes))
        return pa.table({"key": np.concatenate([np.empty(0, np.int64), *keys]), **{f"p{c}": p[:, c] for c in range(classes)}})

    asked = numbered.mapInArrow(route, "tree int, node int, keys binary, x binary, known array<double>")
    # Chunks of a part that very many rows reach are answered in several tasks.
    lanes = 16
    asked = asked.withColumn("lane", F.pmod(F.xxhash64("keys"), F.lit(lanes)))
    held = forest.parts.select(F.col("tree").alias("t"), F.col("node").alias("m"), "body", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))).alias("l"))
    told = asked.groupBy("tree", "node", "lane").cogroup(held.groupBy("t", "m", "l")).applyInArrow(answer, f"key bigint, {', '.join(f'p{c} double' for c in range(classes))}")
    mean = told.groupBy("key").agg(F.array(*[F.sum(f"p{c}") / len(tops) for c in range(classes)]).alias(name))
    return rows.join(mean, rows["_key"] == mean["key"], "left").drop("_key", "key")


_ROUTED = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("keys", pa.binary()), ("x", pa.binary()), ("known", pa.list_(pa.float64()))])


class _Settings(HasInputCols, HasLabelCol, HasSeed):
    classes = Param(Params._dummy(), "classes", "number of labels", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    balanced = Param(Params._dummy(), "balanced", "whether classes weigh the same", TypeConverters.toBoolean)


class DeepForest(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """A forest without a depth limit, as a stage of a pipeline."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", classes=2, numTrees=100, balanced=False, seed=42):
        super().__init__()
        self._setDefault(labelCol="label", classes=2, numTrees=100, balanced=False, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "DeepForestModel":
        get = self.getOrDefault
        rows, classes = dataset.withColumnRenamed(get("labelCol"), "label"), get("classes")
        weight = None
        if get("balanced"):
            held = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
            weight = [sum(held.values()) / (len(held) * held[c]) if c in held else 1.0 for c in range(classes)]
        made = fit_forest(rows, get("inputCols"), classes, weight, ForestSettings(trees=get("numTrees"), seed=get("seed")))
        top = json.dumps({"columns": made.columns, "classes": classes, "tops": made.tops, "importances": made.importances})
        return DeepForestModel(top=top)._with(made.parts)


class DeepForestModel(Model, MLWritable, MLReadable):
    top = Param(Params._dummy(), "top", "the trees' upper parts, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, top=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.parts = None

    def _with(self, parts: DataFrame) -> "DeepForestModel":
        self.parts = parts
        return self

    def copy(self, extra=None) -> "DeepForestModel":
        return super().copy(extra)._with(self.parts)

    @property
    def forest(self) -> Forest:
        return Forest(parts=self.parts, **json.loads(self.getOrDefault("top")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = forest_probabilities(dataset, self.forest)
        first = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", first.cast("double"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.parts.write.parquet(f"{path}/parts")


class _ForestReader(MLReader):
    def load(self, path: str) -> DeepForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DeepForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._with(self.sparkSession.read.parquet(f"{path}/parts"))
