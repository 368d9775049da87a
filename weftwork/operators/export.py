"""Small results as files: JSON documents, CSV, tables, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(row: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(row: DataFrame, path: str) -> None:
    """A nested result, one object a line; a row of aggregates is one file."""
    to_json(row).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def replace_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table anew, as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def to_markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of ``most`` rows at most, which says so if there are more."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(lines + [f"(the first {most} rows)"] * (len(rows) > most)) + "\n"


def report(title: str, parts: dict[str, DataFrame]) -> str:
    """A Markdown report with a section for each part."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{to_markdown(df)}" for name, df in parts.items())
