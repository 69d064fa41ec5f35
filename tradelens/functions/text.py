"""Text cleaning expressions (all JVM-side, codegen-friendly).

Helpers build one SQL expression each (a single JVM call), so composing many of
them into a plan stays cheap on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ref(c: str) -> str:
    """A column name quoted for a SQL expression."""
    return "`" + c.replace("`", "``") + "`"


def clean_id(c: str | Column) -> Column:
    """``nullif(btrim(c), '')``: trim spaces (not tabs) and turn blanks into NULL."""
    if isinstance(c, str):
        return F.expr(f"nullif(trim({_ref(c)}), '')")
    return F.nullif(F.trim(c), F.lit(""))


def strip_ws(c: str | Column) -> Column:
    """Strip every leading and trailing whitespace character (Unicode's, so U+00A0 too)."""
    if isinstance(c, str):
        return F.expr(f"regexp_replace({_ref(c)}, '(?U)^\\\\s+|\\\\s+$', '')")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
