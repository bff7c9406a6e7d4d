import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marketspark.session import get_or_create_session

    warehouse = tempfile.mkdtemp(prefix="marketspark-warehouse-")
    s = get_or_create_session("local[*]", app_name="marketspark-tests", shuffle_partitions=8,
                              extra_conf={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def raw_frames(spark):
    """Builder of conformed raw tables from Python rows (missing columns are NULL)."""
    from pyspark.sql import types as T

    from marketspark.sources.raw import conform_raw
    from marketspark.sources.schemas import RAW_COLUMNS

    def make(table, rows, extra=None):
        cols = dict(RAW_COLUMNS[table])
        cols.update(extra or {})
        schema = T.StructType([T.StructField(c, t, True) for c, t in cols.items()])

        def coerce(v, t):
            if v is None:
                return None
            if isinstance(t, T.DoubleType):
                return float(v)
            if isinstance(t, T.StringType):
                return str(v)
            return v

        data = [tuple(coerce(r.get(c), t) for c, t in cols.items()) for r in rows]
        return conform_raw(table, spark.createDataFrame(data, schema))

    return make
