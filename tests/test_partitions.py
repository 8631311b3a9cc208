"""Results do not depend on how Spark partitions the work."""

import os

import pytest

from corpusloom.plans.registry import QUERIES
from tests.conftest import SF_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

NAMES = [
    "token_offsets",
    "stream_batches",
    "packed_sequences",
    "render_conversation",
    "debiased_ema",
    "extract_metrics",
    "sample_token",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            results.append(sorted(map(repr, QUERIES[name](spark, SF_DIR).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
