"""Scalar column helpers. All of them are built-in expressions and stay in whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(condition: Column, yes, no) -> Column:
    """Two-way recode in which an unknown condition stays unknown."""
    return F.when(condition, yes).when(~condition, no)


def relative_change(before: str | Column, after: str | Column) -> Column:
    """(after - before) / before; null when the base is null or zero."""
    before, after = col(before), col(after)
    return (after - before) / F.nullif(before, F.lit(0.0))


def percent_text(share: str | Column, digits: int = 1) -> Column:
    """Percent text of a share; null stays null rather than becoming the text 'null%'."""
    share = col(share)
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", share * F.lit(100.0)))


def round_to(x: str | Column, digits: int = 6) -> Column:
    """Half-up rounding of the decimal form. NaN becomes null."""
    return F.round(F.nanvl(col(x), F.lit(None).cast("double")), digits)


def gap_seconds(later: str | Column, earlier: str | Column) -> Column:
    """Seconds from one timestamp to another, to the microsecond."""
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6)


def full_name(first: str | Column, last: str | Column) -> Column:
    return F.concat(col(first), F.lit(" "), col(last))


def in_years(df: DataFrame, column: str, first: int, last: int) -> Column:
    """Calendar-year bounds as a range on the stored column, so that the scan can skip row groups.

    ``year(c) BETWEEN ...`` says the same but is not pushed to Parquet.
    """
    stored = df.schema[column].dataType
    return (F.col(column) >= F.lit(f"{first}-01-01").cast(stored)) & (
        F.col(column) < F.lit(f"{last + 1}-01-01").cast(stored)
    )


def snake_case(name: str) -> str:
    """``pitchData.startSpeed`` -> ``pitch_data_start_speed``, ``PARKID`` -> ``parkid``."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()


# Signs that become words in a cleaned name, and what stands before a leading digit or for an empty name.
SIGNS = {"%": "percent", "#": "number"}
LEADING = "x"


def cleaned_names(names: Sequence[str]) -> dict[str, str]:
    """A clean, distinct name for each name of a table, in order: snake case, signs as words, ``x`` before a leading digit.

    A name that comes out like one before it gets the first free number from 2 on (``a``, ``a_2``); numbers step over names that are there already
    or come later. The names themselves must be distinct.
    """
    plain = []
    for name in names:
        for sign, word in SIGNS.items():
            name = name.replace(sign, f"_{word}_")
        name = snake_case(name)
        plain.append(LEADING + name if not name or name[0].isdigit() else name)
    taken: set[str] = set()
    out = {}
    for name, new in zip(names, plain, strict=True):
        if name in out:
            raise ValueError(f"the column {name} is there twice")
        k, free = 1, new
        while free in taken or (k > 1 and free in plain):
            k += 1
            free = f"{new}_{k}"
        taken.add(free)
        out[name] = free
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """The table under ``cleaned_names`` of its columns."""
    return df.toDF(*cleaned_names(df.columns).values())
