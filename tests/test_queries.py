"""Every registered query of the polyline and voxel operators, against its SQL where it has some."""

import pytest
from compare import rows, sql_rows
from conftest import DATA

from weftline.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    if name in SQL:
        assert rows(df) == sql_rows(duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
