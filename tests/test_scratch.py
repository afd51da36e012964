import time

from orfweave.plans.scratch import Scratch


def shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")
    return {b for b in blocks.split(",") if b.startswith("shuffle_")}


def test_shuffle_files_go(spark):
    """What a table's query shuffled isn't kept once the table is written; the caller's settings stay."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(spark), spark.conf.get(name, None)
    df = spark.range(10_000).repartition(3, "id")
    table = Scratch(spark, "test").write(df, "rows")
    for _ in range(50):
        if not shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert table.count() == df.count() == 10_000
    assert spark.conf.get(name, None) == setting
