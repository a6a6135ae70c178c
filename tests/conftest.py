import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from traceloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.streaming.stateStore.stateSchemaCheck": "true",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples and a DDL schema, and read one back as tuples."""

    class Rows:
        def __call__(self, data, schema):
            return spark.createDataFrame(data, schema)

        @staticmethod
        def of(df, *columns):
            return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

    return Rows()
