"""Names that tell the rows of a table apart and stay the same when it is read again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import materialize


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as a column has that name in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def placed_rows(docs: DataFrame, from_files: bool) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns of longs, and their names.

    With ``from_files`` the caller says that ``docs`` is what
    ``spark.read.parquet`` gave, as it is: a row is known by the hash of its file's
    path and its place there, and nothing is written. Else, or where the table
    does not know its files (as a cached one), rows are numbered and written first. The names are free ones, whatever columns ``docs`` has.
    """
    file, row = free_name(docs.columns, "__file"), free_name(docs.columns, "__row")
    if from_files and "_metadata" not in map(str.lower, docs.columns):
        try:
            return docs.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")}), file, row
        except AnalysisException:  # not from files after all
            pass
    return materialize(docs.withColumns({file: F.lit(0).cast("long"), row: F.monotonically_increasing_id()}), "numbered"), file, row
