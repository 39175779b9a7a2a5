"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact check.

1. One pass turns each text into its set of word shingles and a signature of minima.
2. Documents with equal sets form a class; from here on only its first member works.
3. Signatures are cut into bands. A bucket holds the classes that agree on a band; buckets
   with the same members are kept once, and a large bucket is dealt over blocks, so that a
   task sees two blocks of bounded bytes, never a whole bucket.
4. In a large bucket all members are first compared with one of them, its hub. Those that
   link to it are joined; only the rest meets all blocks. So a bucket of thousands of near
   copies costs a comparison a member.
5. Signatures are compared a batch at a time. With a flat prior, the chance that a pair with
   m of n equal minima reaches the threshold is the binomial tail P(Bin(n + 1, t) <= m); a
   pair below ``miss`` is dropped. What survives is checked on the full sets. Pairs that are
   joined already need no check, so a task returns no more links than it has members.
6. Links give connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import write_out
from .graph import components


@dataclass(frozen=True)
class Near:
    """``percent``: least 100 * Jaccard. With 21 bands of 6, a pair at 0.85 is missed with
    probability 5e-5 and one at 0.8 with 1.7e-3 before the Bayesian test adds ``miss``."""

    percent: int = 85
    words: int = 5
    bands: int = 21
    rows: int = 6
    batch: int = 16
    miss: float = 1e-6
    block_rows: int = 512
    block_bytes: int = 4 << 20

    @property
    def size(self) -> int:
        return -(-self.bands * self.rows // self.batch) * self.batch


def least_matches(near: Near) -> list[int]:
    """For each batch end n: the fewest equal minima with which a pair stays."""
    t, out = near.percent / 100, []
    for n in range(near.batch, near.size + 1, near.batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= near.miss:
                break
            m += 1
        out.append(m)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Word to 64-bit hash, kept between documents up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased and all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, words: int) -> frozenset:
    w = split_words(text)
    if not w:
        return frozenset()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def _shingle_hashes(text: str, words: int, known: _Hashes, factors: np.ndarray) -> np.ndarray:
    w = split_words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    if len(w) < words:  # a shorter sequence never equals a full shingle
        return _mix(np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], np.uint64))
    total = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        total += h[k : len(h) - words + 1 + k] * factors[k]
    return np.unique(_mix(total))


def _minima(sets: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    best = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(sets), 4096):
        part = sets[start : start + 4096]
        for k in range(0, len(mul), 16):
            got = (mul[k : k + 16, None] * part + add[k : k + 16, None]).min(axis=1)
            best[k : k + 16] = np.minimum(best[k : k + 16], got)
    return (_mix(best) >> np.uint64(48)).astype(np.uint16)


SIGNED = "id bigint, content bigint, n_bytes bigint, n_shingles bigint, print binary, sig binary, keys array<bigint>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content, n_bytes, text): ``content`` tells the texts of an id apart."""
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    return picked.select("id", F.xxhash64("id", "text").alias("content"), F.octet_length("text").cast("bigint").alias("n_bytes"), "text")


def signatures(docs: DataFrame, id_col: str, text_col: str, near: Near) -> DataFrame:
    """Per row: the size of its set, a 128-bit print of the set, its signature and band keys.
    Without words: size 0 and the rest null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.Generator(np.random.PCG64(20))
        mul = draw.integers(0, 1 << 63, near.size, np.uint64) * np.uint64(2) + np.uint64(1)
        add = draw.integers(0, 1 << 63, near.size, np.uint64)
        factors = draw.integers(0, 1 << 63, near.words, np.uint64) * np.uint64(2) + np.uint64(1)
        known, used = _Hashes(), near.bands * near.rows
        for batch in batches:
            sizes, prints, sigs, keys = [], [], [], []
            for value in batch.column(3):
                hashes = _shingle_hashes(value.as_py() or "", near.words, known, factors)
                sizes.append(len(hashes))
                if not len(hashes):
                    prints.append(None), sigs.append(None), keys.append(None)
                    continue
                prints.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sig = _minima(hashes, mul, add)
                sigs.append(sig.tobytes())
                key = np.arange(1, near.bands + 1, dtype=np.uint64)
                for column in sig[:used].reshape(near.bands, near.rows).T.astype(np.uint64):
                    key = _mix(key * np.uint64(65599) + column)
                keys.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "content", "n_bytes", "n_shingles", "print", "sig", "keys"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, SIGNED)


def _members(classes: DataFrame, near: Near) -> DataFrame:
    """(band, key, parts, hub, block, c): the members of each bucket, and over how many blocks
    it is dealt; buckets with the same members are kept once."""
    rows = classes.select("c", "n_bytes", F.posexplode("keys").alias("band", "key"))
    buckets = (
        rows.groupBy("band", "key")
        .agg(
            F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("n_bytes").alias("bytes"),
            F.bit_xor(F.xxhash64("c")).alias("x1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("x2"),
        )
        .where("n > 1")
        .groupBy("n", "lo", "hi", "x1", "x2")
        .agg(F.min(F.struct("band", "key", "bytes")).alias("first"))
        .select(
            F.col("first.band").alias("band"), F.col("first.key").alias("key"), F.col("lo").alias("hub"),
            F.ceil(
                F.greatest(F.col("n") / near.block_rows, F.col("first.bytes") / near.block_bytes)
            ).cast("int").alias("parts"),
        )
    )
    member = rows.select("band", "key", "c", "n_bytes").join(buckets, ["band", "key"])
    return member.withColumn("block", F.pmod(F.xxhash64("c"), "parts").cast("int"))


#: Roles of a member in a group: it asks (is compared with all that answer), answers, or both.
_ASKS, _ANSWERS = 1, 2


def _dealt(member: DataFrame, rest: DataFrame, near: Near) -> DataFrame:
    """(band, key, i, j, c, role, left): the groups in which members meet. All of a small bucket
    meet in one; in a large one each block i of the ``rest`` asks each block j of all members."""
    small = member.where("parts = 1").select(
        "band", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "c", F.lit(_ASKS + _ANSWERS).alias("role"), F.lit(True).alias("left")
    )
    sizes = rest.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).select(
        "band", "key", F.ceil(F.greatest(F.col("n") / near.block_rows, F.col("bytes") / near.block_bytes)).cast("int").alias("asking")
    )
    large = member.where("parts > 1").join(sizes, ["band", "key"]).join(
        rest.select("band", "key", "c", F.lit(True).alias("left")), ["band", "key", "c"], "left"
    )
    own = F.pmod(F.xxhash64("c", F.lit(2)), "asking").cast("int")
    answers = large.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("asking") - 1))).select(
        "band", "key", "i", F.col("block").alias("j"), "c", F.lit(_ANSWERS).alias("role"), F.coalesce("left", F.lit(False)).alias("left")
    )
    asks = large.where("left").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", "key", own.alias("i"), "j", "c", F.lit(_ASKS).alias("role"), "left"
    )
    both = answers.unionByName(asks).groupBy("band", "key", "i", "j", "c").agg(F.sum("role").cast("int").alias("role"), F.max("left").alias("left"))
    return small.unionByName(both)


class _Sets(dict):
    """Shingle sets of a group's members, made when they are first asked for."""

    def __init__(self, rows: list[dict], words: int):
        super().__init__()
        self.rows, self.words = rows, words

    def __missing__(self, k: int) -> frozenset:
        value = self[k] = shingle_set(self.rows[k]["text"] or "", self.words)
        return value


def _survivors(x: int, alive: np.ndarray, sig: np.ndarray, size: np.ndarray, near: Near, need: list[int]) -> np.ndarray:
    """Those of ``alive`` that can still reach the threshold with ``x``: by size, then a batch of
    the signature at a time."""
    small, large = np.minimum(size[alive], size[x]), np.maximum(size[alive], size[x])
    alive, m = alive[100 * small >= near.percent * large], 0
    for k, least in enumerate(need):
        if not len(alive):
            break
        part = slice(k * near.batch, (k + 1) * near.batch)
        m = m + (sig[alive, part] == sig[x, part]).sum(axis=1)
        stay = m >= least
        alive, m = alive[stay], m[stay]
    return alive


def _alike(sets: _Sets, x: int, y: int, percent: int) -> bool:
    both = len(sets[x] & sets[y])
    return 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)


def _link_group(near: Near):
    need = least_matches(near)

    def link(rows: list[dict]) -> list[tuple[int, int]]:
        rows = sorted(rows, key=lambda r: r["c"])
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(len(rows), -1)
        size = np.array([r["n_shingles"] for r in rows])
        role, left = np.array([r["role"] for r in rows]), np.array([r["left"] for r in rows])
        asks, answers, band = role & _ASKS > 0, role & _ANSWERS > 0, rows[0]["band"]
        before = sig[:, : band * near.rows].reshape(len(rows), band, near.rows)
        cluster, sets, out = np.arange(len(rows)), _Sets(rows, near.words), []
        for x in range(len(rows) - 1):
            y = np.arange(x + 1, len(rows))
            # Two that are both left over meet twice; the group where the first asks counts.
            y = y[(asks[x] & answers[y]) | (asks[y] & answers[x] & (not left[x]))]
            alive = _survivors(x, y[cluster[y] != cluster[x]], sig, size, near, need)
            if len(alive) and band:  # a pair is checked in the first band that it shares
                alive = alive[~(before[alive] == before[x]).all(axis=2).any(axis=1)]
            for y in alive:
                if cluster[x] != cluster[y] and _alike(sets, x, y, near.percent):
                    cluster[cluster == cluster[y]] = cluster[x]
                    out.append((rows[x]["c"], rows[y]["c"]))
        return out

    return link


def _link_hub(near: Near):
    need = least_matches(near)

    def link(rows: list[dict]) -> list[tuple[int, int]]:
        rows = sorted(rows, key=lambda r: r["c"] != r["hub"])
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(len(rows), -1)
        size, sets = np.array([r["n_shingles"] for r in rows]), _Sets(rows, near.words)
        if rows[0]["c"] != rows[0]["hub"]:
            return []
        found = _survivors(0, np.arange(1, len(rows)), sig, size, near, need)
        out = []
        for y in found.tolist():
            if _alike(sets, 0, y, near.percent):
                out.append((rows[0]["c"], rows[y]["c"]))
            del sets[y]
        return out

    return link


def _linked(rows: DataFrame, group: list[str], link, keep: list[str]) -> DataFrame:
    """(keep.., a, b): what ``link`` makes of each group, whose rows come one after another."""
    kinds = dict(rows.dtypes)
    names = [*keep, "a", "b"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "a bigint, b bigint"])
    types = [pa.int32() if kinds[c] == "int" else pa.int64() for c in keep] + [pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, found = [], None, []

        def close() -> None:
            if len(held) > 1:
                found.extend((*[held[0][c] for c in keep], a, b) for a, b in link(held))
            held.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if (key := tuple(r[c] for c in group)) != at:
                    close()
                at = key
                held.append(r)
            if found:
                yield out()
                found.clear()
        close()
        if found:
            yield out()

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()) -> DataFrame:
    """(id, n_shingles, component_id, kept, content, component), a row for each row of ``docs``.

    ``component`` numbers the group of linked texts and ``component_id`` is its smallest id.
    Texts are what is linked: an id with several texts has a row for each, and they are in one
    group only if they link. ``content`` hashes id and text. Null and empty texts have no
    shingles, link with nothing, have no ``component`` and are their own ``component_id``.
    A row without an id links like any other and has a ``component``, but its
    ``component_id`` is null and it is kept. Repeated rows agree. Texts of any length are
    read whole. An empty table gives an empty table. Other columns of ``docs`` are not read,
    whatever their names.
    """
    signed = write_out(signatures(docs, id_col, text_col, near), "signed")
    usable = signed.where("print is not null")
    # A class is known by a number of its own; one row with its set stands for it, if it can one with an id.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("first")
    classes = usable.groupBy("print").agg(
        first, F.first("n_shingles").alias("n_shingles"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    classes = write_out(classes.select("print", "first.id", "first.content", "n_shingles", "n_bytes", "sig", "keys").withColumn("c", F.monotonically_increasing_id()), "classes")

    member = write_out(_members(classes.select("c", "n_bytes", "keys"), near), "members")
    needed = member.select("c").distinct().join(classes.select("c", "id", "content"), "c")
    # Rows that repeat a text would repeat its members, so one of them is taken.
    texts = _texts(docs, id_col, text_col).select(F.col("id").alias("own"), F.col("content").alias("key"), "text")
    texts = texts.join(needed, (F.col("key") == F.col("content")) & F.col("own").eqNullSafe(F.col("id"))).groupBy("content", "id", "c").agg(F.first("text").alias("text"))
    body = write_out(texts.select("c", "text").join(classes.select("c", "n_shingles", "sig"), "c"), "bodies")

    group = ["band", "key", "block"]
    large = member.where("parts > 1").select(*group, "hub", "c", "parts")
    hubs = large.select("band", "key", "hub", "parts").distinct().select(
        "band", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "hub", F.col("hub").alias("c")
    )
    around = large.where("c <> hub").drop("parts").unionByName(hubs).join(body, "c")
    star = write_out(_linked(around, group, _link_hub(near), ["band", "key"]), "star")
    joined = star.select("band", "key", F.col("b").alias("c"))
    rest = member.where("parts > 1 and c <> hub").join(joined, ["band", "key", "c"], "left_anti")

    rows = _dealt(member, rest, near).join(body, "c")
    links = _linked(rows, ["band", "key", "i", "j"], _link_group(near), [])
    found = components(links.unionByName(star.select("a", "b")))
    numbered = classes.select("print", "id", "c").join(found.select(F.col("id").alias("c"), "component"), "c", "left").select(
        "print", "id", F.coalesce("component", "c").alias("component")
    )
    smallest = numbered.groupBy("component").agg(F.min("id").alias("smallest"))
    named = numbered.select("print", "component").join(smallest, "component")
    return (
        signed.select("id", "n_shingles", "print", "content").join(named, "print", "left")
        .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component_id"), "content", "component")
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
        .select("id", "n_shingles", "component_id", "kept", "content", "component")
    )
