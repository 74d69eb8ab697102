"""Keys beyond those of the small tables, as a larger copy has them."""

import duckdb
import pytest
from vellum.plans import registry

from .oracle import SMALL, same


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Every part again with a key of seven digits."""
    base = tmp_path_factory.mktemp("large-keys")
    part = f"SELECT * FROM '{SMALL}/part.parquet'"
    duckdb.sql(f"COPY ({part} UNION ALL SELECT * REPLACE (p_partkey + 999950 AS p_partkey) FROM ({part})) TO '{base}/part.parquet' (FORMAT parquet)")
    return str(base)


@pytest.mark.parametrize("name", ["rule_snapshot", "rule_buckets", "rule_halves"])
def test_codes_of_long_keys(spark, parts, name):
    same(registry.QUERIES[name](spark, parts), registry.ORACLES[name], parts)
