"""Report (R1-R36) and data-test (Q1-Q5) oracle SQL."""

from __future__ import annotations

from duckdb_oracle.models import cte, msum, total
from duckdb_oracle.selections import (
    CAMPAIGN_SELECTION,
    CUSTOMER_SELECTION,
    EVENT_TYPES,
    NOT_NULL,
    PRODUCT_SELECTION,
    TRAFFIC_SELECTION,
    UNIQUE,
)

REPORT_SQL: dict[str, tuple[list[str], str]] = {}


def report(name: str, sql: str) -> None:
    REPORT_SQL[name] = ([], " ".join(sql.split()))


def _in(col: str, values) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"{col} IN ({quoted})"


def _where(selection: dict) -> str:
    return " AND ".join(_in(c, v) for c, v in selection.items() if v)


def cents(x: str) -> str:
    return f"CAST(ROUND(({x})*100) AS BIGINT)"


def money_total(x: str) -> str:
    return f"COALESCE({msum(x)}, 0.0)"


def money_mean(x: str, cond: str | None = None) -> str:
    v = x if cond is None else f"CASE WHEN {cond} THEN {x} END"
    return f"CAST(SUM({cents(v)}) AS DOUBLE)/COUNT({v})/100"


def share(num: str, den: str) -> str:
    """pandas-order rate num / den * 100 (NULL on zero)."""
    return f"CAST({num} AS DOUBLE)/NULLIF(CAST({den} AS DOUBLE), 0)*100.0"


# Shared report inputs.
cte("customers_named_country", """
SELECT * REPLACE (CASE country WHEN 'au' THEN 'Australia' WHEN 'br' THEN 'Brazil' WHEN 'ca' THEN 'Canada'
 WHEN 'de' THEN 'Germany' WHEN 'in' THEN 'India' WHEN 'uk' THEN 'United Kingdom' WHEN 'us' THEN 'United States'
 ELSE country END AS country)
FROM fct_customer_metrics
""")

cte("campaign_transactions", """
SELECT t.campaign_id, t.gross_revenue, t.is_refunded, c.channel, c.objective, c.target_segment, c.expected_uplift
FROM fct_transactions t LEFT JOIN dim_campaigns c ON t.campaign_id = c.campaign_id
WHERE t.campaign_id IS NOT NULL AND t.gross_revenue > 0
""")

# ------------------------------------------------------------------ landing page

cte("buyers", "SELECT * FROM dim_customers WHERE total_revenue > 0")
report("kpi_overview", f"""
SELECT n.customers AS total_customers, n.purchasers AS total_purchasers,
 round(100.0 * CAST(n.purchasers AS DOUBLE) / n.customers, 1) AS pct_converted,
 (SELECT round({total('total_revenue')} / count(*), 2) FROM buyers) AS avg_ltv,
 (SELECT round(avg(total_orders), 1) FROM dim_customers WHERE total_orders > 0) AS avg_orders,
 n.revenue AS total_revenue
FROM (SELECT count(DISTINCT customer_id) AS customers, CAST(sum(has_purchased) AS BIGINT) AS purchasers,
       {msum('total_revenue')} AS revenue FROM dim_customers) n
""")

# ------------------------------------------------------------- customer overview

report("customers_named_country", "SELECT * FROM customers_named_country")

report("filter_options", """
SELECT DISTINCT filter_name, value FROM (
 SELECT 'loyalty_tier' AS filter_name, loyalty_tier AS value FROM customers_named_country
 UNION ALL SELECT 'country', country FROM customers_named_country
 UNION ALL SELECT 'gender', gender FROM customers_named_country
 UNION ALL SELECT 'traffic_source', traffic_source FROM fct_traffic_conversion
 UNION ALL SELECT 'category', category FROM fct_product_conversion
 UNION ALL SELECT 'brand', brand FROM fct_product_conversion
 UNION ALL SELECT 'channel', channel FROM dim_campaigns
 UNION ALL SELECT 'objective', objective FROM dim_campaigns
 UNION ALL SELECT 'target_segment', target_segment FROM dim_campaigns
) WHERE value IS NOT NULL
""")

report("customers_filtered", f"SELECT * FROM customers_named_country WHERE {_where(CUSTOMER_SELECTION)}")

report("customer_kpis", f"""
SELECT COUNT(*) AS total_customers, CAST(COALESCE(SUM(has_purchased), 0) AS BIGINT) AS total_purchasers,
 COALESCE({share('COALESCE(SUM(has_purchased), 0)', 'COUNT(*)')}, 0.0) AS pct_converted,
 {money_mean('total_revenue', 'total_revenue > 0')} AS avg_ltv,
 AVG(CASE WHEN total_orders > 0 THEN total_orders END) AS avg_orders,
 {money_total('total_revenue')} AS total_revenue
FROM customers_named_country
""")

report("ltv_segment_counts", """
SELECT CASE WHEN lbl IN ('High', 'Mid', 'Low', 'None') THEN lbl END AS ltv_segment, customers,
 CASE lbl WHEN 'High' THEN 0 WHEN 'Mid' THEN 1 WHEN 'Low' THEN 2 WHEN 'None' THEN 3 END AS display_order
FROM (SELECT upper(substr(ltv_segment, 1, 1)) || lower(substr(ltv_segment, 2)) AS lbl, COUNT(*) AS customers
      FROM customers_named_country WHERE ltv_segment IS NOT NULL GROUP BY ltv_segment)
""")

report("loyalty_tier_counts", """
SELECT CASE WHEN loyalty_tier IN ('platinum', 'gold', 'silver', 'bronze') THEN loyalty_tier END AS loyalty_tier,
 customers,
 CASE loyalty_tier WHEN 'platinum' THEN 0 WHEN 'gold' THEN 1 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 3 END
  AS display_order
FROM (SELECT loyalty_tier, COUNT(*) AS customers FROM customers_named_country
      WHERE loyalty_tier IS NOT NULL GROUP BY 1)
""")

report("acquisition_mix", f"""
SELECT acquisition_channel, COUNT(*) AS customers,
 {share('COUNT(*)', '(SELECT COUNT(*) FROM customers_named_country WHERE acquisition_channel IS NOT NULL)')}
  AS share_pct
FROM customers_named_country WHERE acquisition_channel IS NOT NULL GROUP BY 1
""")

report("revenue_by_acquisition", f"""
SELECT acquisition_channel, {money_total('total_revenue')} AS total_revenue
FROM customers_named_country WHERE acquisition_channel IS NOT NULL GROUP BY 1
""")

cte("cohort_cells", """
SELECT strftime(cohort_month, '%Y-%m') AS cohort_month, months_since_signup, total_revenue FROM fct_cohort_retention
WHERE cohort_month IS NOT NULL AND months_since_signup IS NOT NULL
""")
report("cohort_matrix", f"""
SELECT c.cohort_month, m.months_since_signup, {money_total('r.total_revenue')} AS total_revenue
FROM (SELECT DISTINCT cohort_month FROM cohort_cells) c
CROSS JOIN (SELECT DISTINCT months_since_signup FROM cohort_cells) m
LEFT JOIN cohort_cells r ON r.cohort_month = c.cohort_month AND r.months_since_signup = m.months_since_signup
GROUP BY c.cohort_month, m.months_since_signup
""")
report("cohort_matrix_wide", f"""
SELECT * FROM (PIVOT (
 SELECT c.cohort_month, 'M' || m.months_since_signup AS label,
  (SELECT {money_total('r.total_revenue')} FROM cohort_cells r
   WHERE r.cohort_month = c.cohort_month AND r.months_since_signup = m.months_since_signup) AS revenue
 FROM (SELECT DISTINCT cohort_month FROM cohort_cells) c
 CROSS JOIN (SELECT DISTINCT months_since_signup FROM cohort_cells) m
) ON label USING first(revenue) GROUP BY cohort_month)
""")

# ---------------------------------------------------------- traffic & conversion

report("traffic_filtered", f"SELECT * FROM fct_traffic_conversion WHERE {_where(TRAFFIC_SELECTION)}")
report("traffic_monthly_filtered", f"SELECT * FROM fct_traffic_monthly WHERE {_where(TRAFFIC_SELECTION)}")

_purch = "COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN event_count END), 0)"
_bounce = "COALESCE(SUM(CASE WHEN event_type = 'bounce' THEN event_count END), 0)"
_nonb = "COALESCE(SUM(CASE WHEN event_type IS DISTINCT FROM 'bounce' THEN event_count END), 0)"
_all = "COALESCE(SUM(event_count), 0)"
report("traffic_kpis", f"""
SELECT CAST({_all} AS BIGINT) AS total_events,
 (SELECT COUNT(DISTINCT customer_id) FROM stg_events) AS unique_customers,
 COALESCE({share(_purch, _nonb)}, 0.0) AS purchase_rate,
 COALESCE({share(_bounce, _all)}, 0.0) AS bounce_rate
FROM fct_traffic_conversion
""")

report("unique_event_customers", "SELECT COUNT(DISTINCT customer_id) AS unique_customers FROM stg_events")

report("purchase_rate_by_source", f"""
SELECT p.traffic_source, p.event_count, t.total, {share('p.event_count', 't.total')} AS rate
FROM (SELECT traffic_source, event_count FROM fct_traffic_conversion WHERE event_type = 'purchase') p
JOIN (SELECT traffic_source, CAST(SUM(event_count) AS BIGINT) AS total FROM fct_traffic_conversion
      WHERE event_type IS DISTINCT FROM 'bounce' GROUP BY 1) t ON p.traffic_source = t.traffic_source
""")

report("bounce_rate_by_source", f"""
SELECT b.traffic_source, b.event_count, t.total, {share('b.event_count', 't.total')} AS rate
FROM (SELECT traffic_source, event_count FROM fct_traffic_conversion WHERE event_type = 'bounce') b
JOIN (SELECT traffic_source, CAST(SUM(event_count) AS BIGINT) AS total FROM fct_traffic_conversion GROUP BY 1) t
 ON b.traffic_source = t.traffic_source
""")

_event_types = ("add_to_cart", "bounce", "click", "purchase", "view")
_mix_cols = ", ".join(
    f"CAST(COALESCE(SUM(CASE WHEN event_type = '{t}' THEN event_count END), 0) AS BIGINT) AS \"{t}\""
    for t in _event_types)
report("event_mix", f"""
SELECT traffic_source, {_mix_cols} FROM fct_traffic_conversion
WHERE traffic_source IS NOT NULL AND event_type IS NOT NULL GROUP BY 1
""")

report("monthly_volume", """
SELECT strftime(event_month, '%Y-%m') AS event_month, traffic_source, CAST(SUM(event_count) AS BIGINT) AS event_count
FROM fct_traffic_monthly WHERE traffic_source IS NOT NULL AND event_month IS NOT NULL GROUP BY 1, 2
""")

report("experiment_summary", "SELECT * FROM fct_experiment_groups")

report("experiment_lift", """
SELECT experiment_group, purchase_rate,
 (SELECT purchase_rate FROM fct_experiment_groups WHERE experiment_group = 'control') AS control_purchase_rate,
 ROUND(purchase_rate - (SELECT purchase_rate FROM fct_experiment_groups WHERE experiment_group = 'control'), 2)
  AS lift_pp
FROM fct_experiment_groups
""")

report("experiment_rates_long", """
SELECT experiment_group, 'click_rate' AS metric, 'Click Rate' AS label, click_rate AS value FROM fct_experiment_groups
UNION ALL SELECT experiment_group, 'add_to_cart_rate', 'Add to Cart Rate', add_to_cart_rate FROM fct_experiment_groups
UNION ALL SELECT experiment_group, 'purchase_rate', 'Purchase Rate', purchase_rate FROM fct_experiment_groups
UNION ALL SELECT experiment_group, 'bounce_rate', 'Bounce Rate', bounce_rate FROM fct_experiment_groups
""")

# ----------------------------------------------------------- product performance

report("products_filtered", f"SELECT * FROM fct_product_conversion WHERE {_where(PRODUCT_SELECTION)}")

report("product_kpis", f"""
SELECT COUNT(DISTINCT product_id) AS total_products, {money_total('total_revenue')} AS total_revenue,
 CAST(COALESCE(SUM(total_transactions), 0) AS BIGINT) AS total_transactions,
 CAST(COALESCE(SUM(unique_buyers), 0) AS BIGINT) AS total_buyers,
 {money_mean('avg_order_value', 'avg_order_value > 0')} AS avg_order_value,
 {money_total('total_discount')} AS total_discount
FROM fct_product_conversion
""")

report("revenue_by_category", f"""
SELECT category, {money_total('total_revenue')} AS total_revenue FROM fct_product_conversion
WHERE category IS NOT NULL GROUP BY 1
""")

report("aov_by_category", f"""
SELECT category, {money_mean('avg_order_value')} AS avg_order_value FROM fct_product_conversion
WHERE category IS NOT NULL GROUP BY 1
""")

report("top20_products", """
SELECT product_id, category, brand, base_price, total_revenue FROM fct_product_conversion
WHERE total_revenue > 0 ORDER BY total_revenue DESC, product_id ASC LIMIT 20
""")

report("discount_by_category", f"""
SELECT category, {money_total('total_discount')} AS total_discount FROM fct_product_conversion
WHERE category IS NOT NULL GROUP BY 1
""")

report("price_vs_revenue", """
SELECT category, product_id, base_price, total_revenue FROM fct_product_conversion WHERE total_revenue > 0
""")

# --------------------------------------------------------------------- campaigns

report("campaign_list", "SELECT * FROM dim_campaigns")
report("campaign_transactions", "SELECT * FROM campaign_transactions")
report("campaigns_filtered", f"SELECT * FROM dim_campaigns WHERE {_where(CAMPAIGN_SELECTION)}")
report("campaign_transactions_filtered",
       f"SELECT * FROM campaign_transactions WHERE {_where(CAMPAIGN_SELECTION)}")

report("campaign_kpis", f"""
SELECT (SELECT COUNT(DISTINCT campaign_id) FROM dim_campaigns) AS total_campaigns,
 (SELECT COUNT(DISTINCT channel) FROM dim_campaigns) AS total_channels,
 (SELECT coalesce({total('gross_revenue')}, 0.0) FROM campaign_transactions) AS total_attributed_revenue,
 (SELECT COUNT(*) FROM campaign_transactions) AS total_transactions,
 (SELECT {total('expected_uplift')} / count(expected_uplift) FROM dim_campaigns) * 100.0 AS avg_expected_uplift,
 (SELECT COALESCE({share('SUM(CAST(is_refunded AS INTEGER))', 'COUNT(is_refunded)')}, 0.0)
  FROM campaign_transactions) AS refund_rate
""")

report("revenue_by_channel", f"""
SELECT channel, coalesce({total('gross_revenue')}, 0.0) AS gross_revenue FROM campaign_transactions
WHERE channel IS NOT NULL GROUP BY 1
""")

for _name, _key in (("objective_mix", "objective"), ("segment_mix", "target_segment")):
    report(_name, f"""
    SELECT {_key}, COUNT(DISTINCT campaign_id) AS campaigns,
     {share('COUNT(DISTINCT campaign_id)',
            f'(SELECT SUM(n) FROM (SELECT COUNT(DISTINCT campaign_id) AS n FROM dim_campaigns WHERE {_key} IS NOT NULL GROUP BY {_key}))')}
      AS share_pct
    FROM dim_campaigns WHERE {_key} IS NOT NULL GROUP BY 1
    """)

report("transactions_by_channel", """
SELECT channel, COUNT(gross_revenue) AS transactions FROM campaign_transactions WHERE channel IS NOT NULL GROUP BY 1
""")

report("uplift_vs_revenue", f"""
SELECT c.campaign_id, c.channel, c.objective, c.target_segment, c.expected_uplift,
 c.expected_uplift * 100.0 AS uplift_pct, r.attributed_revenue
FROM dim_campaigns c
JOIN (SELECT campaign_id, coalesce({total('gross_revenue')}, 0.0) AS attributed_revenue FROM campaign_transactions
      WHERE campaign_id IS NOT NULL GROUP BY 1) r ON c.campaign_id = r.campaign_id
WHERE c.expected_uplift IS NOT NULL
""")

# -------------------------------------------------------------------- data tests

_nn = " UNION ALL ".join(
    f"SELECT 'not_null' AS test, '{m}' AS model, '{c}' AS column_name, "
    f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS failures FROM {m}"
    for m, cols in NOT_NULL for c in cols)
_un = " UNION ALL ".join(
    f"SELECT 'unique' AS test, '{m}' AS model, '{c}' AS column_name, CAST((SELECT COUNT(*) FROM "
    f"(SELECT {c} FROM {m} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1)) AS BIGINT) AS failures"
    for m, c in UNIQUE)
_av = ("SELECT 'accepted_values' AS test, 'stg_events' AS model, 'event_type' AS column_name, "
       "CAST((SELECT COUNT(DISTINCT event_type) FROM stg_events WHERE event_type IS NOT NULL AND NOT "
       f"{_in('event_type', EVENT_TYPES)}) AS BIGINT) AS failures")
_rel = ("SELECT 'relationships' AS test, 'fct_transactions' AS model, 'customer_id' AS column_name, "
        "CAST((SELECT COUNT(*) FROM fct_transactions t WHERE t.customer_id IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM dim_customers d WHERE d.customer_id = t.customer_id)) AS BIGINT) AS failures")

report("dq_not_null", _nn)
report("dq_unique", _un)
report("dq_accepted_values", _av)
report("dq_relationships", _rel)
report("dq_report", f"""
SELECT *, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status
FROM ({_nn} UNION ALL {_un} UNION ALL {_av} UNION ALL {_rel})
""")
