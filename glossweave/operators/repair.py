"""Cell-wise repair of UTF-8 that was read in a one-byte encoding."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One-byte encodings that UTF-8 is commonly read in.
ENCODINGS = ("cp1252", "mac_roman")


def latin1_garble(x: Column) -> Column:
    """What UTF-8 text becomes when it is read as Latin-1."""
    return F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")


def latin1_repair(x: Column) -> Column:
    """The reverse of latin1_garble, native; texts with characters beyond Latin-1 are left alone."""
    return F.when(F.regexp_like(x, F.lit(r"^[\x00-\xFF]*$")), F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")).otherwise(x)


def mojibake_score(value: str, encoding: str) -> int:
    """Neighbouring characters that, as bytes of the encoding, are the start of a UTF-8 sequence and its continuation."""
    raw = value.encode(encoding, "replace")
    return sum(0xC2 <= a <= 0xF4 and 0x80 <= b <= 0xBF for a, b in zip(raw, raw[1:], strict=False))


def _repair(value: str | None) -> str | None:
    if not value or value.isascii():
        return value
    for encoding in ENCODINGS:
        try:
            fixed = value.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        if mojibake_score(fixed, encoding) < mojibake_score(value, encoding):
            return fixed
    return value


@F.pandas_udf(T.StringType())
def repair_cell(values: pd.Series) -> pd.Series:
    """Each cell re-read as UTF-8 if all of it decodes cleanly and looks less garbled then; null, ASCII and other cells stay as they are."""
    return values.map(_repair, na_action="ignore")


def repair_table(df: DataFrame) -> DataFrame:
    """All string columns repaired cell by cell."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return reduce(lambda d, c: d.withColumn(c, repair_cell(F.col(f"`{c}`"))), names, df)
