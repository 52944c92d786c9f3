"""Every record contract holds for its valid record and names each known breakage."""

import pytest
from pyspark.sql import functions as F

from factloom.contracts import records  # noqa: F401  registers the contracts
from factloom.contracts.rules import CONTRACTS, violations


@pytest.mark.parametrize("family", sorted(CONTRACTS))
def test_known_breakages(spark, family):
    for name, c in CONTRACTS[family].items():
        rows = [spark.range(1).select(F.lit(k).alias("k"), *[F.expr(change.get(n, v)).alias(n) for n, v in c.valid.items()]) for k, (change, _) in enumerate([({}, ""), *c.broken])]
        for k, made in enumerate(rows):
            want = [("", ""), *c.broken][k][1]
            assert violations(made, c.rules).first()["violations"] == want, (name, k)
