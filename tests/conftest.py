from __future__ import annotations

import os
import uuid

import pytest

from stratafold.session import build_session
from stratafold.sources.layers import Layers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def layers(spark, tmp_path):
    return Layers(spark, str(tmp_path / "lake"), prefix=f"t{uuid.uuid4().hex[:10]}_")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows(df, *columns):
    """Rows as sorted tuples, NULLs first."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])


def texts(df, *columns):
    """Like ``rows`` with every value as text; timestamps without trailing zeros."""
    return [tuple(None if v is None else str(v) for v in r) for r in rows(df, *columns)]
