"""Writing samples, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str, *, order_by: str = "id", single_file: bool = False) -> None:
    """Ordered CSV with a header. Files are in order by name.

    ``single_file`` is for results of bounded size, such as a stratified sample.
    """
    ordered = df.orderBy(order_by)
    if single_file:
        ordered = ordered.coalesce(1)
    writer = ordered.write.mode("overwrite").option("header", True).option("escape", '"')
    # Line breaks inside quoted text survive a multi-line read; blanks are kept as they are.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """A small result as one JSON file, nulls included."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
