from types import SimpleNamespace

import pytest

from sensorcal import runtime
from sensorcal.runtime import materialize, release


def session(conf, context=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf or default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: context, master="local[2]"),
    )


def test_shared_folder_is_the_sessions():
    assert runtime.shared_dir(session("hdfs://shared/x")) == "hdfs://shared/x"
    assert runtime.shared_dir(session(None, "hdfs://set/later")) == "hdfs://set/later"
    own = runtime.shared_dir(session(None))
    assert own == runtime.shared_dir(session(None)) and "sensorcal-" in own
    assert runtime.scratch_path(session("s3://b/"), "n").startswith("s3://b/sensorcal/n-")


def test_written_stage_reads_back_the_same(spark):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS TIMESTAMP_NTZ) AS t")
    back = runtime.materialize(df)
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 10


def test_jobs_keep_their_order(spark):
    assert runtime.run_together(spark, [lambda i=i: spark.range(i).count() for i in range(6)]) == list(range(6))


def test_no_local_folder_on_a_cluster():
    from sensorcal.runtime import fallback_dir

    assert fallback_dir("local[8]", "")
    assert fallback_dir("yarn", "hdfs://nn/warehouse").startswith("hdfs://nn/warehouse")
    for warehouse in ("", "file:/tmp/warehouse", "/tmp/warehouse"):
        with pytest.raises(RuntimeError):
            fallback_dir("spark://host:7077", warehouse)


def test_release_removes_the_table(spark):
    table = materialize(spark.range(3), "gone")
    release(table)
    with pytest.raises(Exception):
        table.collect()
