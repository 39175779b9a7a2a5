"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into overlapping windows of words. Document frequencies of
   their terms are counted over all documents.
2. The TF-IDF matrix of a block of items is factorised by a randomised SVD: tasks multiply
   their rows by the sketch and sum by term; only matrices as wide as the sketch and no
   longer than the block's vocabulary reach the driver.
3. Every window of every document is folded into the latent space and compared by cosine
   with every benchmark window, blocks of items at a time.
4. Around each window over the cosine bound, the longest common subsequence with the item
   is measured on words, and the same for the item's answer, its last sentence. A document
   is contaminated if nearly all of an item is there in order, or most of it and the answer.
5. Items of a few words have no windows to speak of, and parts of them are ordinary text.
   They are looked for word for word, where they make up whole sentences or lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import write_out

# A-Z to lower case; punctuation goes, so that it never keeps a word from being found.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DROPPED = b".,;:!?\"'()[]{}*#$%&|<>"


@dataclass(frozen=True)
class Leaks:
    """``block_items`` benchmark items share a latent space, so that ``rank`` dimensions tell
    them apart, and ``pass_blocks`` such blocks are compared in one pass over the documents.
    Items of fewer than ``least_words`` words are looked for as whole sentences."""

    step: int = 16
    rank: int = 256
    block_items: int = 200
    pass_blocks: int = 16
    least_words: int = 8
    cosine: float = 0.3
    most: float = 0.8
    some: float = 0.65
    answer: float = 0.8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER, _DROPPED).split()


def windows(words: list[bytes], step: int) -> list[list[bytes]]:
    """Of two steps each, every step; the whole if it is shorter."""
    return [words[i : i + 2 * step] for i in range(0, max(1, len(words) - step), step)]


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence."""
    sentences = sentences_of(text)
    return sentences[-1] if sentences else []


def sentences_of(text: str) -> list[list[bytes]]:
    """The words of each sentence or line that has any."""
    return [w for s in re.split(r"[.!?]+(?=\s|$)|\n", text) if (w := words_of(s))]


def whole_sentences(text: str, short: dict[tuple, int], most: int) -> int | None:
    """The item of the first run of whole sentences that is a key of ``short``; keys have fewer
    than ``most`` words."""
    held = sentences_of(text)
    for i in range(len(held)):
        run: list[bytes] = []
        for s in held[i:]:
            run += s
            if len(run) >= most:
                break
            if (item := short.get(tuple(run))) is not None:
                return item
    return None


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, the rows of the table held as bits of ``a``."""
    where: dict[bytes, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if hit := where.get(w):
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> tuple[Counter, int]:
    """Documents that hold each term, and all documents; each task sends what it has counted."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, n = shared.value, Counter(), 0
        for batch in batches:
            for value in batch.column(0):
                count.update(known.intersection(words_of(value.as_py())))
                n += 1
        terms = [t.decode() for t in count]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*terms, None], pa.string()), pa.array([*count.values(), n], pa.int64())], ["term", "n"]
        )

    rows = docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = Counter({r["term"]: r["n"] for r in rows.collect()})  # at most a row for each known term
    n = found.pop(None, 0)
    return Counter({t.encode(): k for t, k in found.items()}), n


def _signs(term: bytes, rank: int) -> np.ndarray:
    words = [xxhash.xxh64_intdigest(term, seed=k) for k in range(-(-rank // 64))]
    return np.unpackbits(np.array(words, np.uint64).view(np.uint8))[:rank] * 2.0 - 1.0


SUMS = "k bigint, v binary"


def _pass(rows: DataFrame, rank: int, vectors: np.ndarray | None, terms: list[bytes] | None) -> dict[int, np.ndarray]:
    """One round with the matrix X of ``rows``: Y = X times the vectors (random signs at
    first), then X^T Y by term number and, under -1 - k, row k of Y^T Y.

    Tasks add up what their rows give; the sums of all tasks meet by key, so no task and
    no message holds more than the terms of its rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast((vectors, terms))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, terms = shared.value
        total: dict[int, np.ndarray] = {}
        gram = np.zeros((rank, rank))
        for batch in batches:
            for ids, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.array(weights)
                y = w @ (vectors[ids] if terms is None else np.stack([_signs(terms[i], rank) for i in ids]))
                gram += np.outer(y, y)
                for i, x in zip(ids, weights):
                    total[i] = total.get(i, 0.0) + x * y
        total |= {-1 - k: row for k, row in enumerate(gram)}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"]
        )

    sums = rows.select("ids", "weights").mapInArrow(multiply, SUMS).repartition("k").mapInArrow(add, SUMS)
    return {r["k"]: np.frombuffer(r["v"]) for r in sums.collect()}


def latent_terms(rows: DataFrame, terms: list[bytes], rank: int) -> np.ndarray:
    """Right singular vectors of the matrix whose rows are (ids, weights): for each term its
    ``rank`` coordinates, from a sketch with random signs and one power iteration.

    Directions without weight come out as 0. ``terms`` is the vocabulary of one block of
    items, and with the sketch's square matrices all that reaches the driver.
    """
    sketch = np.zeros((len(terms), rank))
    for k, v in _pass(rows, rank, None, terms).items():
        if k >= 0:
            sketch[k] = v
    # Orthonormal columns keep the second round's sums well scaled.
    second = _pass(rows, rank, np.linalg.qr(sketch)[0] if len(terms) >= rank else sketch, None)
    gram, z = np.zeros((rank, rank)), np.zeros((len(terms), rank))
    for k, v in second.items():
        if k >= 0:
            z[k] = v
        else:
            gram[-1 - k] = v
    # With Y = Q R, z R^-1 is X^T Q; its left singular vectors are those of X^T.
    size, basis = np.linalg.eigh(gram)
    inverse = basis * np.where(size > size.max() * 1e-10, 1 / np.sqrt(np.maximum(size, 1e-300)), 0)
    left, size, _ = np.linalg.svd(z @ inverse, full_matrices=False)
    out = np.zeros((len(terms), rank))
    out[:, : left.shape[1]] = left * (size > size.max() * 1e-8)
    return out


@dataclass
class _Space:
    vocabulary: dict[bytes, int]
    table: np.ndarray  # a row of weighted latent coordinates for each term; row 0 for all others
    squares: np.ndarray  # the squared weight of each term
    queries: np.ndarray
    owner: np.ndarray
    items: list[tuple[int, list[bytes], list[bytes]]]


def _fit(spark: SparkSession, items: list[tuple], count: Counter, n: int, leaks: Leaks) -> _Space:
    cuts = [(k, w) for k, (_, words, _) in enumerate(items) for w in windows(words, leaks.step)]
    terms = sorted({t for _, w in cuts for t in w})
    ids = {t: k for k, t in enumerate(terms, 1)}
    idf = np.array([0.0, *(np.log((n + 1) / (count[t] + 1)) for t in terms)])
    idf[0] = idf[1:].mean()  # terms that no item has
    rows = []
    for _, w in cuts:
        weight = {ids[t] - 1: c * idf[ids[t]] for t, c in Counter(w).items() if idf[ids[t]] > 0}
        if weight:
            length = np.sqrt(sum(x * x for x in weight.values()))
            rows.append((list(weight), [float(x / length) for x in weight.values()]))
    table = np.zeros((len(terms) + 1, leaks.rank), np.float32)
    if rows:
        matrix = spark.createDataFrame(rows, "ids array<int>, weights array<double>")
        table[1:] = latent_terms(matrix, terms, leaks.rank) * idf[1:, None]
    queries = np.stack([table[[ids[t] for t in w]].sum(axis=0) for _, w in cuts])
    size = np.linalg.norm(queries, axis=1)
    usable = size > 1e-6
    return _Space(ids, table, idf**2, queries[usable] / size[usable, None], np.array([k for k, _ in cuts])[usable], items)


def _search(words: list[bytes], space: _Space, leaks: Leaks) -> tuple | None:
    """(item, share of it found in order, share of its answer, cosine) of the best match.

    The cosine is between a window's TF-IDF vector over all its terms and an item window's
    latent vector. Its bound, the length of what is left of the window in the latent
    space, is tested first, and before a subsequence is measured, its bound: how many of
    the item's words are there at all.
    """
    if not words or not len(space.queries):
        return None
    step, get, best = leaks.step, space.vocabulary.get, None
    ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
    cells = -(-len(ids) // step)
    full = np.add.reduceat(space.squares[ids], np.arange(0, len(ids), step))
    inside = np.flatnonzero(ids)
    if not len(inside):
        return None
    sums = np.zeros((cells, space.table.shape[1]), np.float32)
    for k in range(0, len(inside), 1 << 16):
        part = inside[k : k + (1 << 16)]
        cell, first = np.unique(part // step, return_index=True)
        sums[cell] += np.add.reduceat(space.table[ids[part]], first)
    if cells > 1:
        sums, full = sums[:-1] + sums[1:], full[:-1] + full[1:]
    size = np.sqrt(full)
    chosen = np.flatnonzero(np.einsum("ij,ij->i", sums, sums) >= (leaks.cosine * size) ** 2)
    tried = set()
    for start in range(0, len(chosen), 4096):
        part = chosen[start : start + 4096]
        near = sums[part] @ space.queries.T
        at, query = np.nonzero(near >= np.maximum(leaks.cosine * size[part, None], 1e-9))
        for a, q in zip(at.tolist(), query.tolist()):
            k, window = int(space.owner[q]), int(part[a])
            if (window, k) in tried:
                continue
            tried.add((window, k))
            item, text, answer = space.items[k]
            region = words[max(0, window * step - len(text)) : (window + 2) * step + len(text)]
            least = max(leaks.some, best[1] if best else 0.0) * len(text)
            if sum(map(set(region).__contains__, text)) < least:
                continue
            share = common_subsequence(text, region) / len(text)
            if share < leaks.some or (best and share <= best[1]):
                continue
            said = common_subsequence(answer, region) / len(answer) if answer else 0.0
            if share >= leaks.most or said >= leaks.answer:
                best = (item, share, said, float(near[a, q] / size[window]))
    return best


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", leaks: Leaks = Leaks()) -> DataFrame:
    """``docs`` with ``leaked`` and, where true, ``leak_item``, ``leak_share``, ``leak_answer``, ``leak_cosine``.

    Null and empty texts are not leaked; texts of any length are searched whole. Items that
    are null or without words are not looked for, nor are short ones without an id; without
    any item no document is leaked. Repeated items count once, under their smallest id. Of equally good matches the first in the text counts. All columns
    of ``docs`` stay; one named like a new column is replaced. Documents are judged one by
    one, so repeated rows agree and an empty table stays empty.
    """
    new = ["leak_item", "leak_share", "leak_answer", "leak_cosine"]
    kept = [c for c in docs.columns if c not in (*new, "leaked")]
    items = benchmark.groupBy(F.col(item_text).cast("string").alias("text")).agg(F.min(item_col).cast("bigint").alias("item"))
    items = write_out(items.where("text is not null").withColumn("place", F.pmod(F.xxhash64("text"), F.lit(2**31))), "items")
    spark, texts = docs.sparkSession, docs.select(F.col(text_col).cast("string").alias("text"))
    out = docs.select(*kept).selectExpr("*", "cast(null as bigint) leak_item", *[f"cast(null as double) {c}" for c in new[1:]])
    schema, at = out.schema, kept.index(text_col)
    passes = max(1, -(-items.count() // (leaks.block_items * leaks.pass_blocks)))
    for turn in range(passes):
        rows = items.where(F.col("place") % passes == turn).orderBy("item", "text").collect()
        items_of = [(r["item"], w, answer_of(r["text"])) for r in rows if (w := words_of(r["text"]))]
        wanted = [i for i in items_of if len(i[1]) >= leaks.least_words]
        # Of equal words the smallest id counts; items come by id, those without one first.
        short = {tuple(w): item for item, w, _ in reversed(items_of) if len(w) < leaks.least_words and item is not None}
        blocks = [wanted[k : k + leaks.block_items] for k in range(0, len(wanted), leaks.block_items)]
        spaces = []
        if wanted:
            count, n = _document_frequencies(texts, sorted({t for _, w, _ in wanted for t in w}))
            spaces = [_fit(spark, block, count, n, leaks) for block in blocks]
        if spaces or short:
            out = out.mapInArrow(_marker(spark.sparkContext.broadcast((spaces, short)), at, len(kept), leaks), schema)
    return out.withColumn("leaked", F.col("leak_share").isNotNull())


def _marker(shared, at: int, width: int, leaks: Leaks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = list(zip(*[batch.column(width + k).to_pylist() for k in range(4)]))
            spaces, short = shared.value
            for row, value in enumerate(batch.column(at)):
                words = words_of(value.as_py())
                found = [f for space in spaces if (f := _search(words, space, leaks))]
                if short and (item := whole_sentences(value.as_py() or "", short, leaks.least_words)) is not None:
                    found.append((item, 1.0, 1.0, 1.0))
                for f in found:
                    if best[row][1] is None or f[1] > best[row][1]:
                        best[row] = f
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            more = [pa.array([b[k] for b in best], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], batch.schema.names)

    return run
