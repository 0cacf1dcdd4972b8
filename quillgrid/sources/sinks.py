"""Writing exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.exports import FORMATS, markdown_cell


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Write a table as ``json``, ``csv``, ``tsv`` or ``markdown`` files; columns in sorted order."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    ordered = df.select(*sorted(df.columns))
    if kind == "json":
        ordered.write.json(path)
    elif kind == "csv":
        ordered.write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    elif kind == "tsv":
        ordered.write.csv(path, header=True, sep="\t", quote='"', escape='"', emptyValue="")
    else:
        markdown_table(ordered).write.text(path)


def markdown_table(df: DataFrame) -> DataFrame:
    """A table as Markdown lines, header first; body rows keep the order of the input's partitions."""
    spark = df.sparkSession
    wrap = lambda cells: "| " + " | ".join(cells) + " |"
    head = [(wrap(c.replace("|", r"\|") for c in df.columns),), (wrap("---" for _ in df.columns),)]
    cells = [markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return spark.createDataFrame(head, "value string").coalesce(1).unionByName(body)
