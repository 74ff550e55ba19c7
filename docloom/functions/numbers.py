"""Numbers in spreadsheet text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: Column | str) -> Column:
    """Thousands separators dropped, a trailing percent sign divides by 100; anything else that is no number is null.

    Spellings such as ``nan``, ``inf`` and ``1_000`` are no numbers here.
    """
    s = F.replace(F.replace(strip(c), F.lit(",")), F.lit("％"), F.lit("%"))
    percent = F.endswith(s, F.lit("%"))
    body = F.when(percent, F.regexp_replace(s, "%$", "")).otherwise(s)
    value = F.when(F.rlike(body, F.lit(NUMBER)), body.try_cast("double"))
    return F.when(percent, value / 100.0).otherwise(value)


def format_number(v: Column) -> Column:
    """Whole numbers without decimals, others with up to four."""
    whole = F.abs(v - F.round(v)) < 1e-9
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), r"0+$", ""), r"\.$", "")
    return F.when(whole, F.round(v).cast("decimal(38,0)").cast("string")).otherwise(short)


def human_size(n: Column) -> Column:
    out = F.format_string("%.1f GB", n / float(1 << 30))
    out = F.when(n < 1 << 30, F.format_string("%.1f MB", n / float(1 << 20))).otherwise(out)
    out = F.when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)
