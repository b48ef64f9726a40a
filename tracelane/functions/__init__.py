"""Column-level building blocks (Column in, Column out; no Python UDFs)."""

from tracelane.functions.missing import (
    if_else,
    matches,
    na_text,
    number_text,
    strict_avg,
    strict_max,
    strict_min,
    strict_sum,
)
from tracelane.functions.ordered import (
    any_equal,
    distinct_where,
    first_where,
    last_where,
    ordered_concat,
    ordered_list,
    share_where,
)
from tracelane.functions.scalar import (
    chi_square_p,
    click_side,
    code_values,
    condition_name,
    condition_side,
    elog,
    epoch_ms_to_ts,
    level_code,
    minutes_between,
    move_category,
    mround,
    object_chosen,
    recode,
    to_bin,
)

__all__ = [
    "chi_square_p",
    "any_equal",
    "click_side",
    "code_values",
    "condition_name",
    "condition_side",
    "distinct_where",
    "elog",
    "epoch_ms_to_ts",
    "first_where",
    "if_else",
    "last_where",
    "level_code",
    "matches",
    "minutes_between",
    "move_category",
    "mround",
    "na_text",
    "number_text",
    "object_chosen",
    "ordered_concat",
    "ordered_list",
    "recode",
    "share_where",
    "strict_avg",
    "strict_max",
    "strict_min",
    "strict_sum",
    "to_bin",
]
