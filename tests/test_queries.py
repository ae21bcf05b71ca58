"""Every registered query of the engine against its DuckDB SQL."""

import os

import pytest
from compare import connection, same

from lodestone import registry, registry_index, registry_stages, registry_text, registry_writes  # noqa: F401

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        same(df, con, registry.SQL[name])
    else:
        df.collect()
