"""Repeated passages: merged count-min sketches first, exact groups of what they let through.

A window is a run of ``words`` consecutive words of one document. Documents are dealt at
random to parts of bounded bytes, and one shuffle of the texts serves all three passes:

1. Each part sketches its windows. A sketch has ``depth`` rows of cells, several cells for
   each window of the corpus; a part's share of a row is the sorted list of its cells with a
   bit for "more than once", packed by differences and cut into slices of the cell space.
2. Slices are merged over all parts. What a slice sends back to a part is one bit for each
   cell that the part sent: whether its merged count is over one. Counts are never too
   small, so a window with a clear bit in any row occurs once.
3. The other windows are grouped exactly in the same way, by 128-bit hashes of their words:
   a part sends each once, a slice sends bits back.
4. Each part covers the words of its repeated windows and gives its documents' rows.

A part sends a window once however often it holds it, so a passage in a third of all
documents costs a slice one entry a part. Sizes of rows, slices and parts follow the bytes
of the corpus; nothing is broadcast or brought to the driver but that one sum.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

_CODEC = "zstd"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Repeats:
    """``cells``: sketch cells of a row for each window. ``part_bytes`` and ``slice_windows``
    bound what one task holds; they and ``word_bytes`` (to guess the windows from the bytes)
    change the cost, never the result."""

    words: int = 35
    depth: int = 2
    cells: int = 4
    part_bytes: int = 12 << 20
    slice_windows: int = 2_000_000
    word_bytes: int = 6


@dataclass(frozen=True)
class _Plan:
    words: int
    depth: int
    parts: int
    slice_bits: int
    cell_bits: int


def _planned(total_bytes: int, repeats: Repeats) -> _Plan:
    windows = max(1, total_bytes // repeats.word_bytes)
    slice_bits = max(0, math.ceil(math.log2(windows / repeats.slice_windows)))
    cell_bits = max(slice_bits, math.ceil(math.log2(windows * repeats.cells)))
    parts = max(1, -(-total_bytes // repeats.part_bytes))
    return _Plan(repeats.words, repeats.depth, parts, slice_bits, min(cell_bits, 62))


class _Hashes(dict):
    """Word to 64-bit hash, kept between documents up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_KNOWN = _Hashes()


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _rolled(hashes: np.ndarray, words: int, base: int) -> np.ndarray:
    """A hash for each run of ``words`` entries: differences of prefix sums of a polynomial
    modulo 2^64, shifted back by the inverse power; chunk by chunk."""
    inverse, out = pow(base, -1, 1 << 64), []
    size = min(_CHUNK, len(hashes)) + words
    powers, backs = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (base, inverse))
    for at in range(0, len(hashes) - words + 1, _CHUNK):
        part = hashes[at : at + _CHUNK + words - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * powers[: len(part)])])
        count = len(part) - words + 1
        out.append(_stir((sums[words:] - sums[:-words]) * backs[:count]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@dataclass
class _Windows:
    """Windows of a part's documents: where they start among all its words, and two hashes."""

    lengths: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    second: np.ndarray | None


def _windows(texts: pa.ChunkedArray, words: int, both: bool) -> _Windows:
    known, lengths, pieces = _KNOWN, [], []
    for value in texts:
        found = split_words(value.as_py())
        lengths.append(len(found))
        pieces.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
    lengths = np.array(lengths, np.int64)
    hashes = np.concatenate([np.empty(0, np.uint64), *pieces])
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.flatnonzero(np.arange(len(hashes)) + words <= ends)
    first = _rolled(hashes, words, _BASES[0])[starts] if len(starts) else np.empty(0, np.uint64)
    second = None
    if both:
        second = _rolled(_stir(hashes ^ np.uint64(_SALTS[3])), words, _BASES[1])[starts] if len(starts) else first
    return _Windows(lengths, starts, first, second)


def _pack(ordered: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of like weight, compressed."""
    steps = np.diff(ordered, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(steps).to_bytes(8, "little") + pa.compress(planes.tobytes(), _CODEC, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    width, count = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], width * count, _CODEC, asbytes=True), np.uint8).reshape(width, count)
    steps = np.zeros((count, 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def _cells(first: np.ndarray, row: int, plan: _Plan) -> np.ndarray:
    return _stir(first ^ np.uint64(_SALTS[row % 3] + row)) >> np.uint64(64 - plan.cell_bits)


def _cuts(ordered: np.ndarray, bits: int, plan: _Plan) -> np.ndarray:
    """Where each slice of the space of ``bits``-bit numbers begins in a sorted array."""
    edges = np.arange(1, 1 << plan.slice_bits, dtype=np.uint64) << np.uint64(bits - plan.slice_bits)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def _distinct(ordered: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array (or a pair of arrays sorted together): where each distinct entry
    begins, and whether there is more than one of it."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if other is not None:
        new[1:] |= other[1:] != other[:-1]
    begins = np.flatnonzero(new)
    return begins, np.diff(begins, append=len(ordered)) > 1


#: row: of the sketch, or -1 for exact groups. keys, more: packed entries. bits: of them.
SENT = "row int, slice bigint, part bigint, keys binary, more binary, bits binary"
BACK = "row int, slice bigint, part bigint, n bigint, bits binary"
_SENT = pa.schema([("row", pa.int32()), ("slice", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("bits", pa.binary())])
_BACK = pa.schema([("row", pa.int32()), ("slice", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def _sketch(plan: _Plan) -> Callable[[pa.Table], pa.Table]:
    def run(docs: pa.Table) -> pa.Table:
        part, found, rows = docs.column("part")[0].as_py(), _windows(docs.column("text"), plan.words, False), []
        for row in range(plan.depth):
            cells = np.sort(_cells(found.first, row, plan))
            begins, twice = _distinct(cells)
            cells = cells[begins]
            for k, (a, b) in enumerate(zip((cut := _cuts(cells, plan.cell_bits, plan))[:-1], cut[1:])):
                if b > a:
                    rows.append({"row": row, "slice": k, "part": part, "keys": _pack(cells[a:b]), "more": b"", "bits": _bits(twice[a:b])})
        return pa.Table.from_pylist(rows, _SENT)

    return run


def _merge(sent: pa.Table) -> pa.Table:
    """Adds up what all parts sent to a slice, and says to each which of its entries count
    more than one."""
    keys = [_unpack(x.as_py()) for x in sent.column("keys")]
    sizes = [len(x) for x in keys]
    twice = np.concatenate([_flags(x.as_py(), n) for x, n in zip(sent.column("bits"), sizes)])
    keys, more = np.concatenate(keys), None
    if sent.column("row")[0].as_py() < 0:
        more = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in sent.column("more")])
        order = np.lexsort((more, keys))
        more = more[order]
    else:
        order = np.argsort(keys, kind="stable")
    begins, several = _distinct(keys[order], more)
    several |= np.logical_or.reduceat(twice[order], begins)
    flags = np.empty(len(keys), bool)
    flags[order] = np.repeat(several, np.diff(begins, append=len(keys)))
    back = [_bits(x) for x in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays(
        [sent.column("row"), sent.column("slice"), sent.column("part"), pa.array(sizes, pa.int64()), pa.array(back, pa.binary())], schema=_BACK
    )


def _answer(back: pa.Table, row: int) -> np.ndarray:
    """The bits of one row, slice after slice."""
    rows = sorted((r["slice"], r["n"], r["bits"]) for r in back.to_pylist() if r["row"] == row)
    return np.concatenate([np.empty(0, bool), *(_flags(bits, n) for _, n, bits in rows)])


def _likely(found: _Windows, back: pa.Table, plan: _Plan) -> np.ndarray:
    """Indexes of the windows whose merged count is over one in each row of the sketch."""
    left = np.arange(len(found.first))
    for row in range(plan.depth):
        cells = _cells(found.first, row, plan)
        ordered = np.sort(cells)
        ordered = ordered[_distinct(ordered)[0]]
        several = ordered[_answer(back, row)]
        if not len(several):
            return left[:0]
        at = np.minimum(np.searchsorted(several, cells[left]), len(several) - 1)
        left = left[several[at] == cells[left]]
    return left


def _exact(found: _Windows, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The likely windows in the order of both hashes: indexes, where distinct ones begin,
    and which are there more than once."""
    order = likely[np.lexsort((found.second[likely], found.first[likely]))]
    begins, twice = _distinct(found.first[order], found.second[order])
    return order, begins, twice


def _candidates(plan: _Plan) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs) or not len(back):
            return _SENT.empty_table()
        part, found, rows = docs.column("part")[0].as_py(), _windows(docs.column("text"), plan.words, True), []
        order, begins, twice = _exact(found, _likely(found, back, plan))
        first, second = found.first[order[begins]], found.second[order[begins]].astype("<u8")
        for k, (a, b) in enumerate(zip((cut := _cuts(first, 64, plan))[:-1], cut[1:])):
            if b > a:
                rows.append({"row": -1, "slice": k, "part": part, "keys": _pack(first[a:b]), "more": second[a:b].tobytes(), "bits": _bits(twice[a:b])})
        return pa.Table.from_pylist(rows, _SENT)

    return run


#: kept: a bit for each word, packed.
RESULT = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary"
_RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cover(plan: _Plan) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return _RESULT.empty_table()
        found = _windows(docs.column("text"), plan.words, True)
        edge = np.zeros(int(found.lengths.sum()) + 1, np.int32)
        if len(back):
            order, begins, _ = _exact(found, _likely(found, back, plan))
            if len(order):
                several = np.repeat(_answer(back, -1), np.diff(begins, append=len(order)))
                starts = found.starts[order[several]]
                edge[starts] += 1
                edge[starts + plan.words] -= 1
        covered = np.cumsum(edge)[:-1] > 0
        removed, digests, masks, at = [], [], [], 0
        for value, n in zip(docs.column("text"), found.lengths.tolist()):
            gone = covered[at : at + n]
            at += n
            words = split_words(value.as_py())
            if count := int(gone.sum()):
                words = [words[k] for k in np.flatnonzero(~gone)]
            removed.append(count)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            masks.append(_bits(~gone))
        return pa.Table.from_arrays(
            [docs.column("id"), pa.array(found.lengths), pa.array(removed, pa.int64()), pa.array(digests), pa.array(masks, pa.binary())], schema=_RESULT
        )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: Repeats = Repeats()) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept), a row for each row of ``docs``.

    A word goes if a window that covers it also starts elsewhere, in the same document or
    another; windows are judged on the input. ``kept`` has a bit for each word (``kept_text``
    turns it into text). Null, empty and shorter texts hold no window: all their words stay.
    Repeated rows are documents of their own and repeat each other's windows; ids may be
    null or repeat. A text of any length is taken whole, in one task. An empty table gives
    an empty table. Other columns of ``docs`` are not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    plan = _planned(total, repeats)
    parts = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(plan.parts)).alias("part"), "id", "text")
    sketched = parts.groupBy("part").applyInArrow(_sketch(plan), SENT)
    likely = sketched.groupBy("row", "slice").applyInArrow(_merge, BACK)
    sent = parts.groupBy("part").cogroup(likely.groupBy("part")).applyInArrow(_candidates(plan), SENT)
    exact = sent.groupBy("row", "slice").applyInArrow(_merge, BACK)
    back = likely.unionByName(exact)
    return parts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_cover(plan), RESULT)


def kept_text(text: DataFrame, id_col: str = "id", text_col: str = "text", kept_col: str = "kept") -> DataFrame:
    """(id, text): the kept words joined by one space, from texts beside their ``kept`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, bits in zip(batch.column(1), batch.column(2)):
                words = split_words(value.as_py())
                flags = _flags(bits.as_py() or b"", len(words))
                out.append(b" ".join(w for w, stays in zip(words, flags) if stays).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    picked = text.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string"), F.col(kept_col))
    return picked.mapInArrow(run, "id bigint, text string")
