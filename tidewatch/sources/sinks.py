"""Sinks: spreadsheets that are safe to open, and nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import names

#: Rows that an export has at most; it is a report for people.
MOST_ROWS = 50_000
BOM = "﻿"


def csv_lines(df: DataFrame, order: Sequence[Column], most: int = MOST_ROWS) -> DataFrame:
    """(line): header and rows as CSV text, quoted where need be; text cannot start a formula, numbers stay bare."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}

    def cell(name: str) -> Column:
        if name not in text:
            return F.coalesce(F.col(name).cast("string"), F.lit(""))
        safe = F.coalesce(names.csv_safe(F.col(name)), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(safe.rlike('[",\r\n]'), quoted).otherwise(safe)

    return df.orderBy(*order).limit(most).select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, order: Sequence[Column], path: str, most: int = MOST_ROWS) -> None:
    """One file with a byte-order mark, a header and CRLF line ends."""
    header = df.sparkSession.createDataFrame([(BOM + ",".join(df.columns),)], "line string")
    lines = header.unionByName(csv_lines(df, order, most))
    lines.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def json_groups(df: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, items): each key's rows as a JSON array ordered by ``order``."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]])
    return df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("items"))
