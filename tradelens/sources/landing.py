"""The landing folder: one CSV file (or folder of files) per dataset contract.

Every column is read as text: types are imposed later by the typed projection,
which can name the column and count the values that do not fit.  What is odd but
no reason to stop, an empty dataset or columns outside the contract, becomes a
row of the quality report (``operators/quality.py``), not a message of the reader.

Reading is strict, so nothing is lost unseen: a record with more or fewer fields
than the header stops the job that meets it, and so does a file of a dataset
whose header differs from the first file's.  All files are split among tasks;
those whose contract says ``multiline`` (free text with quoted line breaks) by
way of ``quoted.py``.  In any other dataset a quoted line break is a record with
too few fields, which stops the read.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.contracts import CONTRACTS, DatasetContract, contract_for
from tradelens.functions.text import strip_ws
from tradelens.sinks.files import Files
from tradelens.sources.quoted import read_quoted

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
# Pruned columns would not be counted, and an enforced schema would skip the headers.
READ_OPTIONS = {**CSV_OPTIONS, "mode": "FAILFAST", "columnPruning": "false", "enforceSchema": "false"}


def column_names(header: Iterable[str]) -> list[str]:
    """Header names in lower case without outer white space; they must stay different."""
    names = [n.strip().lower() for n in header]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"header names are equal once normalised: {', '.join(twice)}")
    return names


class Landing:
    """Datasets below a landing folder, read lazily as text."""

    def __init__(self, spark: SparkSession, folder: str, *, trim: bool = False):
        self.spark, self.folder, self.trim = spark, folder.rstrip("/"), trim

    def path(self, contract: DatasetContract) -> str:
        return f"{self.folder}/{contract.csv_filename}"

    def contracts(self, datasets: Iterable[str] | None = None) -> list[DatasetContract]:
        """Contracts of the datasets (names or files; all by default), which must all have landed.

        An unknown name is a KeyError before the folder is looked at.
        """
        asked = [contract_for(d) for d in (CONTRACTS if datasets is None else datasets)]
        landed = {name for name, _, _ in Files(self.spark, self.folder).listing(self.folder)}
        absent = [c.csv_filename for c in asked if c.csv_filename not in landed]
        if absent:
            raise FileNotFoundError(f"not in {self.folder}: {', '.join(absent)}")
        return asked

    def read(self, dataset: str, file_column: str | None = None) -> DataFrame:
        """One dataset with normalised column names (only its first line is read now).

        ``file_column`` names one more column for the file that a record comes from.
        """
        contract = contract_for(dataset)
        path = self.path(contract)
        first = self.spark.read.option("lineSep", "\n").text(path).limit(1).collect()
        header = next(csv.reader([first[0][0]], quotechar='"', doublequote=True), []) if first else []
        if not header:
            return self.spark.createDataFrame([], T.StructType([]))
        names = column_names(header)
        if contract.multiline:
            df = read_quoted(self.spark, path, first[0][0], names, file_column)
        else:
            # Text schema named as the first header; Spark holds every file's header against it.
            schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
            df = self.spark.read.options(**READ_OPTIONS).schema(schema).csv(path).toDF(*names)
            df = df.withColumn(file_column, F.input_file_name()) if file_column else df
        return df.withColumns({c: strip_ws(F.col(f"`{c}`")) for c in names}) if self.trim else df

    def read_all(self, datasets: Iterable[str] | None = None, file_column: str | None = None) -> dict[str, DataFrame]:
        """Frames by dataset name; nothing is read if a file is absent."""
        return {c.name: self.read(c.name, file_column) for c in self.contracts(datasets)}


# Spark's CSV writer trims values and cuts timestamps to milliseconds unless
# told otherwise; the landing files keep both exactly.
CSV_WRITE_OPTIONS = {
    **CSV_OPTIONS,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
}


def write_csv(df: DataFrame, path: str) -> None:
    """Write a dataset as a headed CSV directory (the landing format of the sources)."""
    df.write.mode("errorifexists").options(**CSV_WRITE_OPTIONS).csv(path)
