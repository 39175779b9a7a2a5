"""CSV with per-file encoding choice and whole-column type inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import quoted

# The texts read as missing, and the encodings tried in turn (a third,
# windows-1252, could never be reached, since every byte decodes as latin-1).
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
ENCODINGS = ["utf-8", "iso-8859-1"]
BOOLEAN_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]


def files_by_encoding(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """Which files are valid UTF-8 and which are read as latin-1: one distributed text scan."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    every = lines.inputFiles()
    broken = lines.filter(~F.is_valid_utf8("value")).select("_file").distinct()
    latin = {r["_file"] for r in broken.collect()}  # file names, of which the driver holds the list anyway
    plain = {_plain(f) for f in latin}
    sides = {ENCODINGS[0]: [f for f in every if _plain(f) not in plain], ENCODINGS[1]: [f for f in every if _plain(f) in plain]}
    return {e: files for e, files in sides.items() if files}


def _plain(uri: str) -> str:
    return "/" + uri.split(":", 1)[-1].lstrip("/")


def _by_header(spark: SparkSession, files: list[str], encoding: str, settings: dict) -> list[list[str]]:
    """The files of each column order: Spark takes the columns of all files from one of them.

    Reads the first line of each file, which is where a file's rows begin; the driver
    holds a line for each file, as it holds the files' names.
    """
    lines = spark.read.option("encoding", encoding).text(files)
    every = lines.inputFiles()
    if not settings["header"] or len(every) < 2:
        return [list(files)]
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    heads = lines.select("value", F.col("_metadata.file_path").alias("_file"), at.alias("_at")).where("_at.file_block_start = 0")
    first = heads.groupBy("_file").agg(F.min_by("value", "_at").alias("head"))
    found: dict[str, list[str]] = {}
    for r in first.orderBy("_file").collect():
        found.setdefault(r["head"], []).append(r["_file"])
    return list(found.values())


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "auto",
    infer: bool = True,
    multiline: bool = False,
    **options,
) -> DataFrame:
    """Header row, missing texts to NULL, and the narrowest type that fits a whole column.

    Files are split among tasks; ``multiline=True`` allows line breaks inside quotes at
    the price of one task per file.
    """
    names = path if isinstance(path, str) else list(path)
    sides = {encoding: names} if encoding != "auto" else files_by_encoding(spark, names)
    settings = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline, **options}
    groups = [(e, same) for e, files in sides.items() for same in _by_header(spark, files, e, settings)]
    frames = [spark.read.options(**settings, encoding=e).csv(files, inferSchema=False) for e, files in groups]
    text = frames[0]
    for more in frames[1:]:
        text = text.unionByName(more, allowMissingColumns=True)
    text = text.select(
        *[F.when(~quoted(c).isin(MISSING_TEXTS), quoted(c)).alias(c) for c in text.columns]
    )
    return infer_types(text) if infer else text


def infer_types(text: DataFrame) -> DataFrame:
    """bigint, double, boolean or string per text column, by one counting pass over all rows."""
    if not text.columns:
        return text

    def counts(i: int, v: Column) -> list[Column]:
        return [
            F.count(v).alias(f"_n{i}"),
            F.count_if(v.try_cast("bigint").isNotNull() & v.rlike(r"^\s*[+-]?\d+\s*$")).alias(f"_i{i}"),
            F.count(v.try_cast("double")).alias(f"_d{i}"),
            F.count_if(v.isin(BOOLEAN_TEXTS)).alias(f"_b{i}"),
        ]

    row = text.agg(*[a for i, c in enumerate(text.columns) for a in counts(i, quoted(c))]).first()

    def typed(i: int, c: str) -> Column:
        n = row[f"_n{i}"]
        for mark, kind in (("i", "bigint"), ("d", "double"), ("b", "boolean")):
            if row[f"_{mark}{i}"] == n:
                # A column without values is all missing numbers.
                return quoted(c).try_cast("double" if n == 0 else kind).alias(c)
        return quoted(c)

    return text.select(*[typed(i, c) for i, c in enumerate(text.columns)])


def load_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV data set; other file kinds are refused."""
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError("unsupported file format: give a .csv file or folder")
    return read_csv(spark, path, **options)


def write_csv(df: DataFrame, path: str, encoding: str = ENCODINGS[0]) -> str:
    """Header row, quotes doubled, spaces kept."""
    options = {
        "header": True, "escape": '"', "encoding": encoding,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    df.write.options(**options).csv(path)
    return path
