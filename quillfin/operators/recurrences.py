"""Exponential averages of long series in parallel: a recurrence y' = (1 - a) y + a x is an affine map of y, and maps compose.

The rows of a key are cut into blocks of about BLOCK_ROWS by whole days, from counts of its days. Each
block gives the map from the average before it to the average after it: its number of values and what it makes of zero (and, for
the first block with values, what it makes of nothing, as the first value seeds the average). The maps of a key's blocks, a row each,
are folded in order; then every block runs from its own start. So a ticker's rows are spread over tasks, and a task holds one block.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BLOCK_ROWS = 65_536
BLOCK = "_block"


def blocked(df: DataFrame, key: str, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with the block of each row: days one after the other, until a block has block_rows."""
    day = F.to_date(order)
    days = df.groupBy(key, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    # A key has a row here for each day.
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_day")) - F.col("_n")
    return df.withColumn("_day", day).join(days.select(key, "_day", F.floor(before / block_rows).cast("int").alias(BLOCK)), [key, "_day"]).drop("_day")


def numbered(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Blocked rows with _i, their number in the key (from 1), and _previous, the value of the row before."""
    facts = df.groupBy(key, BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.max_by(value, order).alias("_last"))
    blocks = Window.partitionBy(key).orderBy(BLOCK)
    facts = facts.select(key, BLOCK, (F.sum("_n").over(blocks) - F.col("_n")).alias("_before"), F.lag("_last").over(blocks).alias("_carried"))
    inside = Window.partitionBy(key, BLOCK).orderBy(order)
    rows = df.join(facts, [key, BLOCK]).withColumn("_i", F.col("_before") + F.row_number().over(inside)).withColumn("_previous", F.coalesce(F.lag(value).over(inside), "_carried"))
    return rows.drop("_before", "_carried")


def _run(values: pd.Series, alpha: float, start: float | None) -> pd.Series:
    """The averages of values, from a start or seeded by the first."""
    if start is None:
        return values.ewm(alpha=alpha, adjust=False).mean()
    return pd.concat([pd.Series([start]), values], ignore_index=True).ewm(alpha=alpha, adjust=False).mean().iloc[1:]


def exponential_averages(df: DataFrame, key: str, order: str, averages: dict[str, tuple[str, float]]) -> DataFrame:
    """Blocked rows with the averages {name: (column, alpha)}, seeded by a key's first value that is not null; where the value is null, so is the average."""
    names = list(averages)
    columns = sorted({c for c, _ in averages.values()})

    def summarised(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out: dict[str, Any] = {key: ids[0], BLOCK: ids[1]}
        for name, (column, alpha) in averages.items():
            values = pdf[column].dropna()
            out[f"{name}_n"] = len(values)
            out[f"{name}_zero"] = float(_run(values, alpha, 0.0).iloc[-1]) if len(values) else None
            out[f"{name}_seeded"] = float(_run(values, alpha, None).iloc[-1]) if len(values) else None
        return pd.DataFrame([out])

    def carried(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now: dict[str, float | None] = dict.fromkeys(names)
        out = []
        for row in pdf.sort_values(BLOCK).to_dict("records"):
            out.append({key: ids[0], BLOCK: row[BLOCK]} | {f"{n}_start": now[n] for n in names})
            for name, (_, alpha) in averages.items():
                if row[f"{name}_n"]:
                    now[name] = row[f"{name}_seeded"] if now[name] is None else (1 - alpha) ** row[f"{name}_n"] * now[name] + row[f"{name}_zero"]
        return pd.DataFrame(out).astype({f"{n}_start": "float64" for n in names})

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        for name, (column, alpha) in averages.items():
            start = pdf[f"{name}_start"].iloc[0]
            some = pdf[column].notna()
            result = pd.Series(float("nan"), index=pdf.index)
            if some.any():
                result[some] = _run(pdf.loc[some, column], alpha, None if pd.isna(start) else float(start)).to_numpy()
            pdf[name] = result.astype(object).where(some, None)
        return pdf.drop(columns=[f"{n}_start" for n in names])

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(key, BLOCK, order, *columns)
    maps = slim.groupBy(key, BLOCK).applyInPandas(summarised, f"{key} {kind}, {BLOCK} int, " + ", ".join(f"{n}_n long, {n}_zero double, {n}_seeded double" for n in names))
    starts = maps.groupBy(key).applyInPandas(carried, f"{key} {kind}, {BLOCK} int, " + ", ".join(f"{n}_start double" for n in names))
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return df.join(starts, [key, BLOCK]).select(*df.columns, *[f"{n}_start" for n in names]).groupBy(key, BLOCK).applyInPandas(made, schema)


def smoothing(periods: int) -> float:
    """The alpha of an average of so many periods."""
    return 2 / (periods + 1)


def wilder(periods: int) -> float:
    return 1 / periods


def gained(move: Column) -> Column:
    """The part of a move above zero; null without a move."""
    return F.when(move.isNotNull(), F.greatest(move, F.lit(0.0)))
