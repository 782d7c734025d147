"""The streamed fold gives the same labels as the batch fold, in any arrival order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxlake.operators import prompts as pr
from voxlake.plans.fixtures import Fixtures
from voxlake.streaming import prompts as st

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("own_masks", [False, True])
def test_stream_equals_batch(spark, tmp_path, own_masks):
    """With drawn squares, and with string ids and masks of the prompts' own."""
    fx = Fixtures(spark, SF)
    prompts = fx.prompts.filter("volume_id < 4")
    volumes = fx.volumes
    masks = pr.square_masks(prompts, volumes)
    if own_masks:
        named = F.concat(F.lit("v"), "volume_id")
        prompts, volumes = prompts.withColumn("volume_id", named), volumes.withColumn("volume_id", named)
        cells = F.expr("filter(array(struct(y, x), struct(11 - y as y, x), struct(y, (x + 5) % 12 as x)), (c, i) -> i <= seq % 3)")
        prompts = prompts.withColumn("cells", F.array_distinct(cells))
        masks = prompts.filter(F.col("op").isin(*pr.WRITES)).select("seq", "volume_id", "z", F.explode("cells").alias("c")).select("seq", "volume_id", "z", "c.y", "c.x")
    want = {tuple(r) for r in pr.fold_prompts(prompts, masks).select("volume_id", "z", "y", "x", "label").collect()}
    last = prompts.agg(F.max("ts")).first()[0]
    end = spark.createDataFrame(
        [(10**9, last + dt.timedelta(days=3), "v1" if own_masks else 1, "none", 1, 0, 0, 0, 0.0, *([[]] if own_masks else []))], prompts.schema
    )
    source = str(tmp_path / "in")
    # Two files, the later half first: order of arrival is not the order of the log.
    half = prompts.agg(F.expr("percentile(seq, 0.5)")).first()[0]
    prompts.filter(F.col("seq") > half).coalesce(1).write.mode("append").parquet(source)
    prompts.filter(F.col("seq") <= half).coalesce(1).write.mode("append").parquet(source)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def sink(df, batch):
        df.write.mode("append").parquet(out)

    def run():
        stream = spark.readStream.schema(prompts.schema).parquet(source)
        q = st.fold_stream(stream, volumes, "3650 days").writeStream.outputMode("update").foreachBatch(sink)
        q = q.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination(300)

    run()
    far = end.withColumn("ts", F.col("ts") + F.expr("interval 3700 days"))
    far.coalesce(1).write.mode("append").parquet(source)
    run()
    got = {tuple(r) for r in st.latest_labels(spark.read.parquet(out)).collect()}
    assert want and got == want


def test_stream_goes_on_from_saved_labels(spark, tmp_path):
    """The first half folded in one go and saved, the second half streamed on top of it: the fold of both; in small tiles."""
    fx = Fixtures(spark, SF)
    prompts, volumes = fx.prompts.filter("volume_id < 4"), fx.volumes
    fold = lambda log: pr.fold_prompts(log, pr.square_masks(log, volumes)).select("volume_id", "z", "y", "x", "label")
    want = {tuple(r) for r in fold(prompts).collect()}
    half = prompts.agg(F.expr("percentile(seq, 0.5)")).first()[0]
    saved = str(tmp_path / "saved")
    fold(prompts.filter(F.col("seq") <= half)).write.parquet(saved)
    initial = spark.read.parquet(saved)
    last = prompts.agg(F.max("ts")).first()[0]
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    end = spark.createDataFrame([(10**9, last + dt.timedelta(days=3), 1, "none", 1, 0, 0, 0, 0.0)], prompts.schema)

    def run():
        stream = spark.readStream.schema(prompts.schema).parquet(source)
        q = st.fold_stream(stream, volumes, "1 day", initial=initial, tile=(5, 7)).writeStream.outputMode("update").foreachBatch(lambda df, batch: df.write.mode("append").parquet(out))
        q.option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination(300)

    prompts.filter(F.col("seq") > half).coalesce(1).write.mode("append").parquet(source)
    run()
    end.coalesce(1).write.mode("append").parquet(source)
    run()
    got = {tuple(r) for r in st.latest_labels(spark.read.parquet(out), initial).collect()}
    assert want and got == want
    assert {tuple(r) for r in initial.collect()} != want
