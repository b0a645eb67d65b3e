"""Every query of the core against its SQL on the smallest tables; those without SQL must give rows, and the same columns again."""

import pytest

from tributary.queries import composition, expressions, lineage, problems

QUERIES = {n: (f, m.SQL.get(n)) for m in (problems, expressions, lineage, composition) for n, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, same):
    same(name, *QUERIES[name])


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.queries()["p1_report"](spark, data).columns == ["table_name", "field_name", "period", "n_orphans"]
