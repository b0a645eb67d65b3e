import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from tributary.session import build_session

    s = build_session("local[8]", 3, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(data):
    from compare import connect

    return connect(data)


@pytest.fixture
def same(spark, data, duck):
    """Runs a query and its SQL and compares all rows."""
    from collections import Counter

    from compare import norm

    def check(name, query, sql):
        df = query(spark, data)
        cols = sorted(df.columns)
        got = Counter(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        if sql is None:
            assert got and all(t != "void" for _, t in df.dtypes), name
            return got
        rel = duck.sql(f"SELECT * FROM ({sql.strip()})")
        assert sorted(rel.columns) == cols
        want = Counter(tuple(norm(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
        assert got == want, (name, list((got - want))[:3], list((want - got))[:3])
        return got

    return check
