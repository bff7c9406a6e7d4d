"""Sources and sinks: raw seed tables in, Parquet marts and SQL views out."""

from marketspark.sources.fixtures import raw_from_driver  # noqa: F401
from marketspark.sources.raw import conform_raw, read_broken, read_raw, read_rejected, rejected_values  # noqa: F401
from marketspark.sources.result_cache import ResultCache  # noqa: F401
from marketspark.sources.schemas import RAW_COLUMNS, RAW_TABLES  # noqa: F401
from marketspark.sources.sinks import (  # noqa: F401
    input_version,
    materialise,
    read_range,
    read_table,
    register_views,
    run_sql,
    save_as_table,
    table_record,
    table_records,
    write_table,
)
