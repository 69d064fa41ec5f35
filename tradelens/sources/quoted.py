"""Splittable CSV records whose quoted fields may hold line breaks.

Spark splits a file at byte positions, so a task cannot know whether its first
line lies inside a quoted field.  The number of quotes decides it: a line begins
a record exactly if the quotes before it in the file are even.  Lines are read
by many tasks; each byte range gives the parity of its quotes and, for either
state it may open in, the number of records that begin in it.  Prefix sums over
a file's ranges (one small row each) tell every range its state and the record
that its first lines continue.  Lines that are whole records go on as they are,
only the lines of broken ones are grouped and joined, also across ranges.

A quote may stand only inside a quoted field, doubled, as in RFC 4180.  Quotes
that do not pair up in a file, and a record longer than ``MAX_RECORD_BYTES``
over range borders, stop the read, like a record with too few or too many fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Longest record that may reach over the borders of byte ranges.
MAX_RECORD_BYTES = 256 << 20
PARSE_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}

_PLACE = ("file", "range")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, range (where the task's byte range begins), id (ascending inside a range)."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("range"),
            F.monotonically_increasing_id().alias("id"),
        )
    )


def _odd(c: Column) -> Column:
    """1 where the text holds an odd number of quotes."""
    return (F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2


def _line_states(lines: DataFrame) -> DataFrame:
    """Per line: parity inside its range, and the records begun up to it if the range opens outside."""
    here = Window.partitionBy(*_PLACE).orderBy("id")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.withColumn("odd", _odd(F.col("value")))
        .withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
        .withColumn("line", F.row_number().over(here))
        .withColumn("begun", F.sum(1 - F.col("inside")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    )


def _range_states(states: DataFrame) -> DataFrame:
    """Per byte range: the state it opens in and the last record begun before it."""
    ranges = states.groupBy(*_PLACE).agg(
        (F.sum("odd") % 2).alias("odd"),
        F.sum(1 - F.col("inside")).alias("if_outside"),
        F.sum("inside").alias("if_inside"),
    )
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    unpaired = F.sum("odd").over(Window.partitionBy("file")) % 2
    begins = F.when(F.col("opened") == 0, F.col("if_outside")).otherwise(F.col("if_inside"))
    last = F.when(F.col("begins") > 0, F.struct(F.col("range").alias("at"), F.col("begins").alias("no")))
    return (
        ranges.withColumn("opened", opened)
        .withColumn("unpaired", unpaired)
        .withColumn("begins", begins)
        .withColumn("last", F.last(last, ignorenulls=True).over(before))
        .select(*_PLACE, "opened", "unpaired", "last")
    )


def _header_or_fail(header: str) -> Column:
    """False for a file's first line if it is the header; any other first line stops the read."""
    first = (F.col("range") == 0) & (F.col("line") == 1)
    same = F.lower(F.rtrim(F.col("value"), F.lit("\r"))) == F.lit(header.rstrip("\r").lower())
    wrong = F.raise_error(F.concat(F.lit("CSV header of "), F.col("file"), F.lit(" differs from the first file's")))
    return F.when(first, F.when(same, F.lit(False)).otherwise(wrong.cast("boolean"))).otherwise(F.lit(True))


def quoted_records(spark: SparkSession, path: str, header: str) -> DataFrame:
    """One row per record (``file``, ``record``), the header lines taken off."""
    states = _line_states(text_lines(spark, path))
    known = states.join(_range_states(states), list(_PLACE))
    paired = F.when(
        F.col("unpaired") == 1,
        F.raise_error(F.concat(F.lit("a quoted field in "), F.col("file"), F.lit(" does not end"))).cast("boolean"),
    ).otherwise(F.lit(True))
    known = known.where(paired).where(_header_or_fail(header))
    number = F.when(F.col("opened") == 0, F.col("begun")).otherwise(F.col("line") - F.col("begun"))
    begins = (F.col("inside") + F.col("opened")) % 2 == 0
    known = known.select(
        "value",
        *_PLACE,
        "id",
        F.when(number > 0, F.struct(F.col("range").alias("at"), number.alias("no"))).otherwise(F.col("last")).alias("key"),
        (begins & (F.col("odd") == 0)).alias("whole"),
    )
    too_long = F.raise_error(F.concat(F.lit("a record of "), F.col("file"), F.lit(f" is longer than {MAX_RECORD_BYTES} bytes")))
    bounded = F.when(F.col("range") - F.col("key.at") > MAX_RECORD_BYTES, too_long.cast("boolean")).otherwise(F.lit(True))
    parts = F.sort_array(F.collect_list(F.struct("range", "id", "value")))
    broken = (
        known.where(~F.col("whole"))
        .where(bounded)
        .groupBy("file", "key")
        .agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("record"))
    )
    whole = known.where("whole").select("file", F.col("value").alias("record"))
    records = whole.unionByName(broken.select("file", "record"))
    if header.endswith("\r"):  # CR LF is one line end, also inside quotes, as for Spark's own reader
        records = records.withColumn("record", F.regexp_replace("record", r"\r(?=\n|\z)", ""))
    return records.where("record <> ''")


def read_quoted(
    spark: SparkSession, path: str, header: str, names: Sequence[str], file_column: str | None = None
) -> DataFrame:
    """The records' fields as text columns; with ``file_column`` also the file of each."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("record", schema, PARSE_OPTIONS)
    fields = quoted_records(spark, path, header).select(parsed.alias("r"), "file")
    return fields.select("r.*", *([F.col("file").alias(file_column)] if file_column else []))
