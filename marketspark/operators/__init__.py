"""Reusable DataFrame operators (all built from Spark's own operators)."""

from marketspark.operators.dedupe import dedupe_first  # noqa: F401
from marketspark.operators.distinct import distinct_state, merged_distinct  # noqa: F401
from marketspark.operators.filters import isin_filters  # noqa: F401
from marketspark.operators.joins import left_join_match_flag  # noqa: F401
from marketspark.operators.quality import (  # noqa: F401
    accepted_values_failures,
    column_tests,
    not_null_failures,
    null_counts,
    orphan_count,
    relationships_failures,
    unique_failures,
)
from marketspark.operators.reshape import pivot_sum, top_k, unpivot_long  # noqa: F401
