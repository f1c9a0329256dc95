import os

import duckdb
import pytest

from corpusloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def flat(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(flat, v))
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_oracle(spark, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(flat, r)) for r in got.select(*columns).collect())
    if name not in catalogue.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(flat(r[i]) for i in order) for r in want.fetchall()) and sorted(want.columns) == columns


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0


def test_plans_keep_large_rows_apart(spark):
    """No window over all rows of a table, and filters and columns reach the scan."""
    plan = catalogue.queries()["shard_packing"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    plan = catalogue.queries()["mfu_curve"](spark, SF)._jdf.queryExecution().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
