"""What Python is given at once."""

import pandas as pd
from pyspark.sql import functions as F

from newsweave.session import configure


def test_long_rows_come_in_small_batches(spark):
    """A batch is bounded in bytes and rows, so that the memory of a Python worker does not grow with the table."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    configure(spark)

    @F.pandas_udf("long")
    def together(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([len(text)] * len(text))

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("html"))
    most = rows.select(together("html").alias("n"), count("html").alias("k")).agg(F.max("n"), F.max("k")).first()
    assert most[0] <= 6_000_000 and most[1] <= 1000
    assert spark.range(0, 3000, 1, 1).select(count(F.lit("x")).alias("k")).agg(F.max("k")).first()[0] <= 1000
