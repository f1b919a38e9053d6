import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from courtflow.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from courtflow.fixtures import Tables

    return Tables(spark, SF)


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of(df, *cols):
    cols = cols or df.columns
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, 6) + 0.0 if isinstance(v, float) else str(v) if isinstance(v, (list, dict)) else v for v in r))
    return sorted(out, key=_key)
