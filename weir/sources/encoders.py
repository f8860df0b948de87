"""Encoders: rows as JSON items, columns as JSON, templates."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
OPTIONS = {"timestampFormat": STAMP}


def _value(x: Column, omit_nulls: bool) -> Column:
    """One value as JSON text."""
    text = F.to_json(F.array(x), OPTIONS | {"ignoreNullFields": str(omit_nulls).lower()})
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def outputs(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def json_item(df: DataFrame, omit_nulls: bool = True) -> Column:
    """A row as a JSON object, without its null columns unless they are asked for; of a row difference what the mask sends, nulls too."""
    columns = outputs(df)
    if "__mask" not in df.columns:
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), OPTIONS | {"ignoreNullFields": str(omit_nulls).lower()})
    parts = [F.when(F.col("__mask")[i], F.concat(F.lit(json.dumps(c, ensure_ascii=False)), F.lit(":"), F.coalesce(_value(F.col(f"`{c}`"), omit_nulls), F.lit("null")))) for i, c in enumerate(columns)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def encode_json(df: DataFrame, seq: str, batch: str | None = None, omit_nulls: bool = True, template: str | None = None) -> DataFrame:
    """One JSON array a batch (all rows are one, without a batch column), in arrival order."""
    item = render(template, df) if template else json_item(df, omit_nulls)
    keyed = df.select(*([batch] if batch else []), F.struct(F.col(seq).alias("s"), item.alias("j")).alias("__item"))
    items = F.transform(F.array_sort(F.collect_list("__item")), lambda x: x["j"])
    return keyed.groupBy(*([batch] if batch else [])).agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("payload"))


def render(template: str, df: DataFrame) -> Column:
    """A template with {{ column }} and {{ json(column) }} places, filled in for each row."""
    parts = []
    for text, call, name in re.findall(r"([^{]+|\{(?!\{))|\{\{\s*(?:(json)\()?\s*(?:\.?row\.|\.)?([A-Za-z_]\w*)\s*\)?\s*\}\}", template):
        if not name:
            parts.append(F.lit(text))
        elif name not in df.columns:
            raise ValueError(f"the template has an unknown column {name}")
        else:
            parts.append(F.coalesce(_value(F.col(f"`{name}`"), True), F.lit("null")) if call else F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def columnar_json(df: DataFrame, seq: str, batch: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object a batch, with a list for every column."""
    names = list(columns or outputs(df))
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("__s"), *[F.col(f"`{c}`") for c in names])))
    grouped = df.groupBy(*([batch] if batch else [])).agg(rows.alias("__r"))
    return grouped.select(*([batch] if batch else []), F.to_json(F.struct(*[F.col("__r").getField(c).alias(c) for c in names]), OPTIONS | {"ignoreNullFields": "false"}).alias("payload"))


def columnar_csv_json(df: DataFrame, seq: str, batch: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object a batch, with the values of every column joined by commas; nulls are empty."""
    names = list(columns or outputs(df))
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("__s"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])))
    grouped = df.groupBy(*([batch] if batch else [])).agg(rows.alias("__r"))
    return grouped.select(*([batch] if batch else []), F.to_json(F.struct(*[F.array_join(F.col("__r").getField(c), ",").alias(c) for c in names])).alias("payload"))
