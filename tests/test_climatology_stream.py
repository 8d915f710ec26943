"""A climatology by micro-batches equals one pass, however the rows are split and whatever is run again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators.climatology import climatology as whole
from gridspark.streaming import climatology as merged

SCHEMA = "time timestamp_ntz, cell_id int, sst double"


def rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(dt.datetime(rng.choice([2007, 2008]), rng.randrange(1, 3), rng.randrange(1, 29), 6), rng.randrange(3), None if rng.random() < 0.1 else rng.randrange(-9999, 9999) / 100) for _ in range(n)]


def found(df) -> list:
    return sorted(map(tuple, df.select("doy", "cell_id", "clim").collect()))


def test_any_split_and_a_replayed_batch(spark, tmp_path):
    data, path = rows(400, 1), str(tmp_path / "state")
    frame = spark.createDataFrame(data, SCHEMA)
    want = found(whole(frame, "sst", ("cell_id",), scale=2))
    cuts = [0, 50, 51, 200, 330, 400]
    parts = [spark.createDataFrame(data[a:b], SCHEMA) for a, b in zip(cuts, cuts[1:])]
    for k, part in enumerate(parts[:3]):
        merged.merge_batch(part, k, path, "sst", ("cell_id",), scale=2)
    merged.merge_batch(parts[1], 1, path, "sst", ("cell_id",), scale=2)  # again
    assert merged.compact(spark, path) == 2 and merged.compact(spark, path) == 2
    merged.merge_batch(parts[2], 2, path, "sst", ("cell_id",), scale=2)  # again, when it is part of the merged table
    for k in (3, 4):
        merged.merge_batch(parts[k], k, path, "sst", ("cell_id",), scale=2)
    (tmp_path / "state" / "batch=5").mkdir()  # a try that has not ended
    assert found(merged.climatology(spark, path)) == want
    assert merged.compact(spark, path) == 4 and found(merged.climatology(spark, path)) == want
    with pytest.raises(ValueError):
        merged.climatology(spark, str(tmp_path / "none"))


def test_from_a_stream(spark, tmp_path):
    data = rows(120, 2)
    for k in range(3):
        spark.createDataFrame(data[k * 40 : k * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        merged.merge_days(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"), "sst", ("cell_id",), scale=2).awaitTermination()
    frame = spark.createDataFrame(data, SCHEMA)
    assert found(merged.climatology(spark, str(tmp_path / "state"))) == found(whole(frame, "sst", ("cell_id",), scale=2))
    assert frame.where(F.col("sst").isNull()).count() > 0
