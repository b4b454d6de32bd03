"""Seeded stratified split without a window over a class."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnlake import config as c

_BUCKETS = 1_000_000_000


def stratified_split(df: DataFrame, label: str = c.TARGET, keys: list[str] = (c.ID,), test_share: float = c.TEST_SHARE,
                     seed: int = c.SEED) -> DataFrame:
    """Append ``split`` ('train' / 'test').

    A row is tested when the hash of its key is below its class's cut, the test-share quantile of the
    hashes in the class. The cuts (one number per class) are fixed on the driver, so that every later
    evaluation of the frame gives the same split. A label with more than two values is refused.
    """
    draw = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(_BUCKETS))
    cuts = df.groupBy(label).agg(F.percentile_approx(draw, test_share, 100_000).alias("cut")).limit(4).collect()
    if len(cuts) > 3:
        raise ValueError(f"{label} has more values than 0, 1 and null")
    cut = F.lit(-1)
    for row in cuts:
        cut = F.when(F.col(label).eqNullSafe(row[label]), row["cut"]).otherwise(cut)
    return df.withColumn("split", F.when(draw <= cut, "test").otherwise("train"))
