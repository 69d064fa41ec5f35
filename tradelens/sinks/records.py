"""Records as JSON: decimals as strings with their scale, NULL fields kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json_records(df: DataFrame, column: str = "record") -> DataFrame:
    """One JSON object per row; ``235.00`` stays ``"235.00"``, NULL stays ``null``."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        fields.append(c.alias(f.name))
    return df.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column)
    )
