"""Scalar helpers and distribution tail functions."""

from cairn.functions.scalar import (clip, cut, day_diff, month_diff, month_label,
                                    month_name_label, month_start, nan_to_null,
                                    np_round, numeric_columns, safe_div, sql_round)

__all__ = ["clip", "cut", "day_diff", "month_diff", "month_label", "month_name_label",
           "month_start", "nan_to_null", "np_round", "numeric_columns", "safe_div",
           "sql_round"]
