"""Writers for masked data, reports and audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.labels import output_label

FORMATS = ("csv", "json", "text", "xml", "parquet")


def write_masked(
    df: DataFrame, path: str, fmt: str, overwrite: bool = False, row_tag: str = "row", delimiter: str = ","
) -> None:
    """Write in the given format; an existing destination is refused unless ``overwrite``."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; supported: {', '.join(FORMATS)}")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if fmt == "csv":
        writer.options(
            header=True,
            sep=delimiter,
            escape='"',
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "xml":
        writer.format("xml").option("rowTag", row_tag).option("rootTag", f"{row_tag}s").save(path)
    elif fmt == "text":
        writer.text(path)
    else:
        writer.parquet(path)


def write_lines(
    df: DataFrame, path: str, line: str = "line", source: str = "source", place: str = "place", overwrite: bool = False
) -> None:
    """Write lines as text, a folder ``output=<label>`` for each input file, in the order they were read.

    The parts of a folder, by their names, hold its lines in order. Ranges are sorted and not files, so a
    file of any size is dealt to many tasks. Files of one name in several folders share a label: pass a
    ``source`` that tells them apart.
    """
    rows = df.select(F.col(line).alias("_line"), output_label(F.col(source)).alias("output"), F.col(source).alias("_source"), F.col(place).alias("_place"))
    order = ["output", "_source", "_place"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_line", "output")
    ranged.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("output").text(path)


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a file or batch report as JSON lines."""
    write_masked(report, path, "json", overwrite)


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit events to a trail."""
    events.write.mode("append").json(path)
