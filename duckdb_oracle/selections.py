"""Fixed report selections and declared data tests, stated here on their own.

the oracle checks, so a value changed there shows as a difference.
"""

# Selections of the filtered report queries.
CUSTOMER_SELECTION = {
    "loyalty_tier": ("gold", "platinum", "unknown"),
    "country": ("United States", "Germany", "fr"),
    "gender": ("female", "male"),
}
TRAFFIC_SELECTION = {"traffic_source": ("email", "organic", "unknown")}
PRODUCT_SELECTION = {
    "category": ("electronics", "home", "sports"),
    "brand": ("brand#1", "brand#12", "brand#13", "brand#2", "brand#21", "brand#25"),
}
CAMPAIGN_SELECTION = {
    "channel": ("email", "social", "display"),
    "objective": ("acquisition", "retention"),
}

# Declared column tests, (model, columns).
NOT_NULL = [
    ("stg_customers", ["customer_id", "loyalty_tier", "acquisition_channel"]),
    ("stg_campaigns", ["campaign_id"]),
    ("stg_products", ["product_id"]),
    ("stg_events", ["event_id", "session_id"]),
    ("stg_transactions", ["transaction_id"]),
    ("dim_customers", ["customer_id"]),
    ("dim_products", ["product_id"]),
    ("dim_campaigns", ["campaign_id"]),
    ("fct_transactions", ["transaction_id", "customer_id", "product_id"]),
    ("fct_customer_metrics", ["customer_id"]),
    ("fct_product_conversion", ["product_id"]),
    ("fct_cohort_retention", ["cohort_month"]),
    ("fct_traffic_conversion", ["traffic_source", "event_type"]),
    ("fct_traffic_monthly", ["traffic_source", "event_month"]),
    ("fct_experiment_groups", ["experiment_group", "purchase_rate"]),
]
UNIQUE = [
    ("stg_customers", "customer_id"), ("stg_campaigns", "campaign_id"), ("stg_products", "product_id"),
    ("stg_events", "event_id"), ("stg_transactions", "transaction_id"), ("dim_customers", "customer_id"),
    ("dim_products", "product_id"), ("dim_campaigns", "campaign_id"), ("fct_transactions", "transaction_id"),
    ("fct_customer_metrics", "customer_id"), ("fct_product_conversion", "product_id"),
    ("fct_experiment_groups", "experiment_group"),
]
EVENT_TYPES = ("browse", "click", "add_to_cart", "purchase", "view", "bounce")
