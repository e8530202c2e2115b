import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sessionscope.session import build_session
    s = build_session("local[4]", app="sessionscope-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ss-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def schemas(spark):
    """Column types of every table, taken from the fixture derivation."""
    from sessionscope.sources.fixtures import derive_tables
    t = derive_tables(spark, SF_SMALL)
    names = ["purchase", "add_to_cart", "page_view", "view_search_results", "no_search_results", "view_item",
             "users", "locations", "branch_email_mappings", "processing_jobs", "email_sending_jobs",
             "email_send_history"]
    from pyspark.sql.types import StructField, StructType
    nullable = lambda sch: StructType([StructField(f.name, f.dataType, True) for f in sch.fields])
    return {n: nullable(getattr(t, n).schema) for n in names}


@pytest.fixture
def make_tables(spark, schemas):
    """Build a Tables object from hand-made rows (dicts; missing columns are NULL)."""
    from sessionscope.sources.fixtures import Tables

    def frame(name, rows):
        sch = schemas[name]
        data = [tuple(r.get(f.name) for f in sch.fields) for r in rows]
        return spark.createDataFrame(data, sch)

    def build(**tables):
        kw = {n: frame(n, tables.get(n, [])) for n in schemas}
        return Tables(**kw)
    return build
