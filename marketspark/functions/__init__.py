"""JVM-side column expressions (no UDFs) used across the warehouse."""

from marketspark.functions.expressions import (  # noqa: F401
    capitalize,
    cents,
    clean_text,
    clean_text_or,
    exact_sum,
    exact_total,
    merged_sum,
    money,
    money_from_cents,
    money_mean,
    month_diff,
    month_label,
    month_start,
    not_equal_keep_null,
    nullif,
    pct,
    pct_or_zero,
    pct_rounded,
    round_half_away,
    share_pct,
    to_bool_flag,
    to_double,
    to_int_rounded,
)
