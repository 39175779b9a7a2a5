"""Merkle fixity audit of replicas of WARC records.

Every record is hashed once; from there on only its id, place, length and hash move. Records
stand in files at byte offsets. A file is cut into ranges of offsets, and a range's node
hashes the (offset, length, hash) of its records in order; above it, sixteen ranges make
one, up to the file's root, and the roots of all files, in order of their names, make the
replica's. An audit compares the two roots and descends level by level into branches that
differ, down to ranges, whose records are then matched: what is changed, missing or extra,
and on request what only stands somewhere else.

A lost record shifts what follows in its file, so that the file's later ranges differ; other
files stay equal. A damaged record of the same length makes one range differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.ordering import running_total
from ..session import write_out

FAN_OUT = 16
RANGE_BYTES = 64 << 10
#: Files are listed in so many groups, so that no list holds all of them.
GROUPS = 4096


def _records(pages: DataFrame, id_col: str, url_col: str, body_col: str, per_file: int) -> DataFrame:
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", " ")
    key = F.col(id_col).cast("bigint")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    rows = pages.select(key.alias("id"), F.coalesce(F.floor(key / per_file), F.lit(-1)).alias("file"), record.alias("record"))
    return rows.withColumn("length", F.octet_length("record").cast("bigint")).withColumn("hash", F.sha2("record", 256))


def _placed(rows: DataFrame) -> DataFrame:
    """Add ``offset``: the bytes before a record in its file. A file of any size is summed in slices."""
    total = running_total(rows, ["file"], ["id", "hash"], "length", "upto", rows.count())
    return total.withColumn("offset", F.col("upto") - F.col("length")).drop("upto")


def warc_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = 4096) -> DataFrame:
    """(id, file, offset, length, hash): where ``warc_records`` puts each page, without its bytes."""
    return _placed(write_out(_records(pages, id_col, url_col, body_col, per_file).drop("record"), "index"))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = 4096) -> DataFrame:
    """(id, file, length, record, hash, offset): each page as a WARC resource record.

    Files hold ``per_file`` consecutive ids, in order of id; offsets are byte positions in
    the file. Null urls and bodies are empty; rows without an id go to file -1. Repeated
    rows are records of their own, in order of their hash. Pages of any length are one record.
    """
    return _placed(_records(pages, id_col, url_col, body_col, per_file))


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the members of a gzip file; what can't be read ends it."""
    at = 0
    while at < len(data):
        unzip = zlib.decompressobj(31)
        try:
            content = unzip.decompress(data[at:]) + unzip.flush()
        except zlib.error:
            return
        end = len(data) - len(unzip.unused_data)
        yield at, end - at, content
        if not unzip.eof or end <= at:
            return
        at = end


def _parsed(data: bytes) -> Iterator[tuple[int, int, str | None, bytes | None, str | None]]:
    """(offset, length, uri, body, problem) of the records in plain WARC bytes."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            following = data.find(b"WARC/", at + 1)
            end = len(data) if following < 0 else following
            yield at, end - at, None, None, "no record header"
            at = end
            continue
        head = dict(h.split(b":", 1) for h in data[at:stop].split(b"\r\n")[1:] if b":" in h)
        head = {k.strip().lower(): v.strip() for k, v in head.items()}
        uri = head.get(b"warc-target-uri", b"").decode("utf-8", "replace")
        length = head.get(b"content-length", b"")
        if not length.isdigit():
            following = data.find(b"WARC/", stop)
            end = len(data) if following < 0 else following
            yield at, end - at, uri, None, "no content length"
        elif (end := stop + 4 + int(length) + 4) > len(data):
            end = len(data)
            yield at, end - at, uri, data[stop + 4 :], "cut short"
        else:
            yield at, end - at, uri, data[stop + 4 : end - 4], None
        at = end


_READ = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("uri", pa.string()), ("body", pa.binary()), ("problem", pa.string())]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, uri, body, problem) of the records in WARC files, plain or with a
    gzip member for each record, by their Content-Length.

    ``problem`` is null for a sound record. What isn't a record, one without a usable length
    and one that is cut short are rows with a problem; reading goes on at the next record.
    Addresses that aren't UTF-8 have their odd bytes replaced. In gzip files offset and length
    are those of the member. A file is one row of Spark's binary reader, so 2 GB at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data[:2] == b"\x1f\x8b":
                    for offset, length, content in _members(data):
                        rows += [(path, offset, length, *found[2:]) for found in _parsed(content)]
                else:
                    rows += [(path, *found) for found in _parsed(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_READ)], [n for n, _ in _READ])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset bigint, length bigint, uri string, body binary, problem string")


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "\n").cast("binary"), 256)


def _leaves(records: DataFrame) -> DataFrame:
    """(id, file, offset, length, hash, range): a leaf's hash is that of its record's."""
    hash_ = F.col("hash") if "hash" in records.columns else F.sha2("record", 256)
    rows = records.select("id", F.col("file").cast("string").alias("file"), "offset", "length", F.sha2(hash_.cast("binary"), 256).alias("hash"))
    return write_out(rows.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES)), "leaves")


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of (place.., hash): ranges of a file, sixteen of them and so on up to one a file,
    groups of files, the replica. Each is written once."""
    said = F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "length", "hash"))), lambda r: F.concat_ws(":", r["offset"], r["length"], r["hash"])
    )
    out = [write_out(leaves.groupBy("file", "range").agg(_joined(said).alias("hash")), "nodes")]

    def up(nodes: DataFrame, by: list[Column], child: str) -> DataFrame:
        parts = F.transform(F.sort_array(F.collect_list(F.struct(child, "hash"))), lambda r: F.concat_ws(":", r[child], r["hash"]))
        return write_out(nodes.groupBy(*by).agg(_joined(parts).alias("hash")), "nodes")

    for _ in range(levels):
        nodes = out[-1].withColumn("above", F.floor(F.col("range") / FAN_OUT))
        out.append(up(nodes, [F.col("file"), F.col("above")], "range").withColumnRenamed("above", "range"))
    out.append(up(out[-1], [_group(F.col("file")).alias("group")], "file"))
    out.append(up(out[-1], [F.lit(0).alias("replica")], "group"))
    return out


def _group(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(GROUPS))


def _differing(one: DataFrame, two: DataFrame, keys: list[str], within: DataFrame | None, above: list[Column]) -> DataFrame:
    """The places, in branches that differ, whose nodes are not equal or only in one tree."""
    sides = []
    for nodes in (one, two):
        if within is not None:
            names = within.columns
            held = nodes.withColumns({f"_{n}": c for n, c in zip(names, above)})
            marks = within.withColumnsRenamed({n: f"_{n}" for n in names})
            nodes = held.join(marks, [f"_{n}" for n in names], "left_semi").drop(*[f"_{n}" for n in names])
        sides.append(nodes)
    a, b = sides[0].withColumnRenamed("hash", "h0"), sides[1].withColumnRenamed("hash", "h1")
    return write_out(a.join(b, keys, "full").where(~F.col("h0").eqNullSafe(F.col("h1"))).select(*keys), "differing")


def audit(first: DataFrame, second: DataFrame, moved: bool = False) -> DataFrame:
    """(id, state, offset, length, hash, other_hash) of the records in which two replicas differ.

    Both are tables of (id, file, offset, length) and ``hash`` or ``record``. ``state`` is
    "changed", "missing" (only the first has it) or "extra" (only the second), and with
    ``moved`` also "moved" (the same bytes at another place); offset and length are the
    first's where it has the record. Records that share an id are matched by hash, then in
    order of their place; those of one state are one row, with the first offset, all their
    bytes and a hash of their hashes. A record without an id has none that another replica could name:
    it is left out, though it takes its place in the tree. Equal roots end the audit at
    once, with an empty result, and so do two empty replicas.
    """
    sides = [_leaves(first), _leaves(second)]
    last = max([r for side in sides if (r := side.agg(F.max("range")).first()[0]) is not None] or [0])
    levels = 0
    while FAN_OUT**levels <= last:
        levels += 1
    one, two = (tree(side, levels) for side in sides)
    found = _differing(one[-1], two[-1], ["replica"], None, [])
    found = _differing(one[-2], two[-2], ["group"], found, [F.lit(0)])
    found = _differing(one[-3], two[-3], ["file", "range"], found, [_group(F.col("file"))])
    for level in range(levels - 1, -1, -1):
        found = _differing(one[level], two[level], ["file", "range"], found, [F.col("file"), F.floor(F.col("range") / FAN_OUT)])

    left, right = (side.join(found, ["file", "range"], "left_semi").where("id is not null") for side in sides)
    # The same bytes on both sides are one record, wherever they stand.
    same = Window.partitionBy("id", "hash").orderBy("file", "offset")
    a, b = (side.withColumn("k", F.row_number().over(same)) for side in (left, right))
    b = b.select("id", "hash", "k", *[F.col(c).alias(f"{c}_2") for c in ("file", "offset", "length")])
    both = write_out(a.select("id", "hash", "k", "file", "offset", "length").join(b, ["id", "hash", "k"], "full"), "matched")
    order = Window.partitionBy("id").orderBy("file", "offset", "hash")
    gone = both.where("file_2 is null").select("id", "hash", "file", "offset", "length").withColumn("m", F.row_number().over(order))
    come = both.where("file is null").select("id", "hash", F.col("file_2").alias("file"), F.col("offset_2").alias("offset"), F.col("length_2").alias("length"))
    come = come.withColumn("m", F.row_number().over(order)).select("id", "m", *[F.col(c).alias(f"{c}_2") for c in ("hash", "offset", "length")])
    state = F.when(F.col("hash_2").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    out = gone.join(come, ["id", "m"], "full").select(
        "id", state.alias("state"), F.coalesce("offset", "offset_2").alias("offset"), F.coalesce("length", "length_2").alias("length"),
        "hash", F.col("hash_2").alias("other_hash"),
    )
    if moved:
        elsewhere = both.where("file is not null and file_2 is not null and (file <> file_2 or offset <> offset_2)")
        out = out.unionByName(elsewhere.select("id", F.lit("moved").alias("state"), "offset", "length", "hash", F.col("hash").alias("other_hash")))

    def together(name: str) -> Column:
        """The hash of one record; of more, one of how many there are and of sums over their hashes."""
        mixed = F.concat_ws(":", F.count(name), F.sum(F.xxhash64(name).cast("decimal(20,0)")), F.bit_xor(F.xxhash64(name, F.lit(1))))
        return F.when(F.count(name) > 1, F.sha2(mixed.cast("binary"), 256)).otherwise(F.max(name)).alias(name)

    return out.groupBy("id", "state").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), together("hash"), together("other_hash"))
