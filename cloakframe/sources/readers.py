"""Readers: directories of text, log, SQL, CSV, JSON and XML files as DataFrames."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.labels import SUPPORTED_SUFFIXES, file_suffix

# --- fixed values -------------------------------------------------------------------------
# Tried in this order; the third refuses only the byte 0x98, which selects the fourth.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1251", "cp866")
# --- end of fixed values ------------------------------------------------------------------

#: Tasks that ``dealt`` makes for each core, and the cores it counts at least, as executors may still be starting.
_TASKS_PER_CORE = 4
_FEWEST_CORES = 8


def _any_case(suffix: str) -> str:
    """File-name pattern for a suffix in any mix of cases."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _tree(spark: SparkSession, suffix: str) -> DataFrameReader:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _any_case(suffix))


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a file source dealt over all cores, where it has fewer files than there are cores.

    A row group is read by one task, so a file of few of them would leave what is done with its rows to as few
    tasks, however many rows they hold. Files that are at least as many as the cores are left where they are, and so
    are fewer files that fall into as many splits with rows of their own: what is dealt goes to disk.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or (df.rdd.getNumPartitions() >= cores and _splits_with_rows(df) >= cores):
        return df
    return df.repartition(_TASKS_PER_CORE * max(cores, _FEWEST_CORES))


def _splits_with_rows(df: DataFrame) -> int:
    """The input splits that rows come from; no column is read for it."""
    return df.select(F.input_file_name(), F.input_file_block_start()).distinct().count()


def scan_directory(
    spark: SparkSession, path: str, suffixes: Sequence[str] = SUPPORTED_SUFFIXES
) -> DataFrame:
    """The files below ``path`` with a listed suffix: path, relative path, suffix, size.

    File contents are not read.
    """
    wanted = [s.lower() for s in suffixes]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").removeprefix("file:")
    return (
        files.select("path", "length")
        .withColumn("suffix", file_suffix(F.col("path")))
        .where(F.col("suffix").isin(wanted))
        .select(
            "path",
            F.substring_index("path", f"{base}/", -1).alias("relative_path"),
            "suffix",
            F.col("length").alias("n_bytes"),
        )
    )


def read_text_docs(
    spark: SparkSession,
    path: str,
    suffix: str = ".txt",
    whole: bool = True,
    encoding: str = "utf-8",
    with_place: bool = False,
) -> DataFrame:
    """``(source, text)``: a row per file, or a row per line for files of any size.

    ``with_place`` adds ``place``, which orders the lines of a file (see ``sinks.write_lines``).

    With ``encoding="detect"`` each file is decoded by its own encoding (see ``file_encodings``); whole files are
    taken into one row for it, lines are not. Else files are UTF-8, and bytes that are not become U+FFFD.
    """
    if encoding == "detect" and whole:
        rows = decode_text_files(spark, path, suffix).select("source", "text")
        return rows.withColumn("place", _place(F.lit(0), F.lit(0))) if with_place else rows
    if encoding == "detect":
        place = _place(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        lines = _tree(spark, suffix).text(path, lineSep="\n").select(
            F.col("_metadata.file_path").alias("source"), F.col("value").cast("binary").alias("value"), place.alias("place")
        )
        text = F.regexp_replace(decoded(F.col("value"), F.col("encoding")), r"\r\z", "")
        rows = lines.join(file_encodings(spark, path, suffix), "source")
        return rows.select("source", text.alias("text"), *(["place"] if with_place else []))
    if encoding != "utf-8":
        raise ValueError("encoding has to be 'utf-8' or 'detect'")
    rows = _tree(spark, suffix).text(path, wholetext=whole, lineSep=None if whole else "\n")
    place = _place(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select(
        F.col("_metadata.file_path").alias("source"),
        F.make_valid_utf8(F.col("value")).alias("text"),
        *([place.alias("place")] if with_place else []),
    )


def _place(block: Column, line: Column) -> Column:
    """Where a line stands in its file: the input split, and a number that rises within the split."""
    return F.struct(block.cast("long").alias("block"), line.cast("long").alias("line"))


def read_log(
    spark: SparkSession, path: str, suffix: str = ".log", encoding: str = "utf-8", with_place: bool = False
) -> DataFrame:
    """``(source, line)`` of log files, and ``place`` if asked for."""
    rows = read_text_docs(spark, path, suffix, whole=False, encoding=encoding, with_place=with_place)
    return rows.withColumnRenamed("text", "line")


def read_sql_dump(spark: SparkSession, path: str, suffix: str = ".sql", encoding: str = "utf-8") -> DataFrame:
    """``(source, line)`` of SQL dumps."""
    return read_log(spark, path, suffix, encoding)


def read_csv_strings(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    delimiter: str = ",",
    with_source: bool = False,
    suffix: str = ".csv",
    multi_line: bool = True,
    encoding: str = "detect",
) -> DataFrame:
    """CSV with a header; every cell is a string and an empty cell is an empty string.

    Files are read by groups of equal header line and encoding and united by name, so a cell never lands under the
    name of another file's column; a column that a file lacks is empty there. Cells past the header are
    columns ``extra_1``, ``extra_2`` and so on, where there are any. ``columns`` says which are wanted, extra ones too.
    ``multi_line`` off lets Spark split files whose cells hold no line ends. ``encoding`` is one of ``ENCODINGS``, or
    each file's own.

    The driver knows the header lines and encodings there are, not the files: a group's rows are picked by a join.
    """
    if encoding not in (*ENCODINGS, "detect"):
        raise ValueError(f"unknown encoding {encoding!r}")
    place = _place(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = _tree(spark, suffix).text(path).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
    bytes_ = F.col("value").cast("binary")
    files = lines.groupBy("file").agg(
        F.min_by(bytes_, "place").alias("first"),
        F.min(F.is_valid_utf8("value")).alias("valid"),
        F.max(F.contains(bytes_, F.unhex(F.lit("98")))).alias("has_98"),
    )
    known = _encoding(F.col("valid"), F.col("has_98")) if encoding == "detect" else F.lit(encoding)
    files = files.select("file", known.alias("encoding"), decoded(F.col("first"), known).alias("header"))
    groups = files.select("header", "encoding").distinct().orderBy("header", "encoding").collect()
    options = {"header": True, "sep": delimiter, "multiLine": multi_line, "escape": '"', "inferSchema": False}
    options |= {"recursiveFileLookup": True, "pathGlobFilter": _any_case(suffix)}
    rows = None
    for group in groups:
        own = files.where((F.col("header") == group.header) & (F.col("encoding") == group.encoding)).select(F.col("file").alias("_file"))
        charset = {"encoding": _CHARSETS[group.encoding]}
        part = _with_extra_cells(spark, options | charset, path, group.header, own if len(groups) > 1 else None)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], "_file string")
    names = list(columns) if columns is not None else [c for c in rows.columns if c != "_file"]
    rows = rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names], "_file")
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names]
    return rows.select(*cells, F.col("_file").alias("source")) if with_source else rows.select(*cells)


_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1251": "windows-1251", "cp866": "IBM866"}


def _header_names(header: str, delimiter: str) -> list[str]:
    """The column names of a header line, as Spark's reader gives them: numbered where a cell is empty or not the only one."""
    cells = next(csv.reader([header.lstrip("\ufeff").rstrip("\r")], delimiter=delimiter), [])
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _with_extra_cells(spark: SparkSession, options: dict, path: str, header: str, files: DataFrame | None) -> DataFrame:
    """The rows of the ``files`` of one header with their ``_file``, and a column for each place past the header that holds a cell."""
    names = _header_names(header, options["sep"])

    def read(columns: list[str], **more: str) -> DataFrame:
        kind = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = spark.read.options(**options, **more).schema(kind).csv(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"))
        return rows if files is None else rows.join(files, "_file", "left_semi").select(*columns_of(columns), "_file")

    def columns_of(columns: list[str]) -> list[Column]:
        return [F.col(f"`{c}`") for c in columns]

    ragged = read([*names, "_record"], columnNameOfCorruptRecord="_record")
    # Delimiters inside quotes count too, so this is no less than the number of cells.
    most = ragged.where("_record is not null").select(F.max(F.size(F.split("_record", re.escape(options["sep"])))), F.count(F.col(f"`{names[0]}`"))).first()[0]
    places = [f"extra_{i + 1}" for i in range(max(0, (most or 0) - len(names)))]
    wide = read([*names, *places])
    if not places:
        return wide
    filled = wide.select([F.count(F.col(f"`{c}`")).alias(c) for c in places]).first()
    return wide.drop(*[c for c in places if not filled[c]])


def read_json_docs(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    lines: bool = False,
    suffix: str = ".json",
) -> DataFrame:
    """JSON documents, one per file, or one per line. Give a schema to avoid an inference pass."""
    reader = _tree(spark, suffix).option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_xml_rows(
    spark: SparkSession,
    path: str,
    row_tag: str,
    schema: T.StructType | str | None = None,
    suffix: str = ".xml",
) -> DataFrame:
    """Elements ``row_tag`` of XML files as rows; all values stay strings, attributes are ``_name``."""
    reader = (
        _tree(spark, suffix)
        .format("xml")
        .option("rowTag", row_tag)
        .option("inferSchema", False)
        .option("ignoreNamespace", True)
        .option("ignoreSurroundingSpaces", False)
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def encoding_of(content: Column) -> Column:
    """Name of the encoding of a file's bytes, by the whole content."""
    return _encoding(F.is_valid_utf8(content.cast("string")), F.contains(content, F.unhex(F.lit("98"))))


def _encoding(is_utf8: Column, has_98: Column) -> Column:
    return F.when(is_utf8, F.lit(ENCODINGS[0])).when(has_98, F.lit(ENCODINGS[3])).otherwise(F.lit(ENCODINGS[2]))


def decoded(content: Column, encoding: Column) -> Column:
    """The text of bytes in one of the encodings; bytes that are no UTF-8 become U+FFFD.

    The single-byte ones are outside Spark's list of charsets. Latin-1, which is in it, keeps each byte as a
    character, and those are exchanged.
    """
    upper = bytes(range(0x80, 0x100))

    def single(name: str) -> Column:
        return F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin-1"), upper.decode(name, "replace"))

    return (
        F.when(encoding == ENCODINGS[2], single(ENCODINGS[2]))
        .when(encoding == ENCODINGS[3], single(ENCODINGS[3]))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def file_encodings(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``(source, encoding)`` of text files, by their lines: a file of any size is looked at by many tasks."""
    lines = _tree(spark, suffix).text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("source"), "value")
    has_98 = F.contains(F.col("value").cast("binary"), F.unhex(F.lit("98")))
    files = lines.groupBy("source").agg(F.min(F.is_valid_utf8("value")).alias("valid"), F.max(has_98).alias("has_98"))
    return files.select("source", _encoding(F.col("valid"), F.col("has_98")).alias("encoding"))


def decode_text_files(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``(source, encoding, text)`` of text files in UTF-8, windows-1251 or IBM866, each taken into one row.

    A UTF-8 byte-order mark stays in the text.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _any_case(suffix))
        .load(path)
    )
    return decode_content(files.select(F.col("path").alias("source"), "content"))


def decode_content(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace a binary column by ``encoding`` and ``text``."""
    others = [c for c in files.columns if c != content]
    known = files.withColumn("encoding", encoding_of(F.col(content)))
    return known.select(*others, "encoding", decoded(F.col(content), F.col("encoding")).alias("text"))


def ingest_errors(
    spark: SparkSession, path: str, kind: str = "json", lines: bool = False, suffix: str | None = None
) -> DataFrame:
    """``(source, records, message)`` of the JSON or XML files that do not parse; the good ones are not listed."""
    if kind not in ("json", "xml"):
        raise ValueError("kind has to be 'json' or 'xml'")
    docs = read_text_docs(spark, path, suffix or f".{kind}", whole=not lines)
    if kind == "json":
        bad = F.try_parse_json("text").isNull()
    else:
        parsed = F.from_xml("text", "_corrupt_record string", {"mode": "PERMISSIVE"})
        bad = parsed["_corrupt_record"].isNotNull() | parsed.isNull()
    failed = docs.where(bad & (F.length("text") > 0)).groupBy("source").agg(F.count(F.lit(1)).alias("records"))
    what = F.concat(F.lit(f"ValueError: malformed {kind}, records: "), F.col("records").cast("string"))
    return failed.select("source", "records", what.alias("message"))
