"""Column-expression helpers shared by every model."""

from tradelens.functions.numeric import (
    delay_days,
    exact_avg,
    exact_mean,
    exact_ratio,
    flag_rate,
    mean_of_sums,
    wide_sum,
)
from tradelens.functions.text import clean_id, strip_ws

__all__ = [
    "clean_id",
    "delay_days",
    "exact_avg",
    "exact_mean",
    "exact_ratio",
    "flag_rate",
    "mean_of_sums",
    "strip_ws",
    "wide_sum",
]
