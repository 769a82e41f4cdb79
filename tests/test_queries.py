"""Every core query against its SQL over the smallest tables; those without SQL must run with a stable schema."""

import pytest
from compare import same_rows, tables

from lodestrata.plans import document_queries, reference_queries, sheet_queries, training_data

MODULES = [reference_queries, sheet_queries, document_queries, training_data]
ALL = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(name, spark, tiny):
    df = ALL[name](spark, tiny)
    if name in SQL:
        same_rows(df, tables(tiny), SQL[name])
    else:
        assert df.columns and df.limit(1).count() <= 1


def test_entry(spark, tiny):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(ALL) <= set(e.queries())
    assert e.entry(spark).count() > 0
