"""Round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.metrics import metrics_pack
from ..runtime import scratch_path
from ..sources import files
from ..sources.models import load_model, save_model
from .alignment import pack_sql
from .base import big, query, r6, with_views
from .modelling import FIT_ONE, _fitted


@query("csv_roundtrip", with_views(["micro"], {}, f"SELECT event_id, ts, {r6('v', 'v')}, {r6('hum', 'hum')} FROM micro"))
def csv_roundtrip(spark, sf_dir):
    df = fx.micro(spark, sf_dir)
    path = scratch_path(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@query(
    "json_report",
    with_views(
        ["site_readings"],
        {
            "per_type": "SELECT event_type, count(*) AS n, avg(v) AS mean_v, max(v) AS max_v, "
            "arg_max(event_id, v) AS top_event FROM site_readings GROUP BY event_type"
        },
        f"SELECT event_type AS channel, {big('n', 'n')}, {r6('mean_v', 'mean_v')}, {r6('max_v', 'max_v')} FROM per_type",
    ),
)
def json_report(spark, sf_dir):
    """One nested report row per table, written as JSON, read back and unfolded."""
    per_type = (
        fx.site_readings(spark, sf_dir)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.max("v").alias("max_v"))
    )
    entry = F.struct(F.col("event_type").alias("channel"), "n", F.struct("mean_v", "max_v").alias("level"))
    report = per_type.agg(F.array_sort(F.collect_list(entry)).alias("channels")).withColumn("source", F.lit("events"))
    path = scratch_path(spark, "report")
    files.write_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select(F.inline("channels")).select("channel", "n", "level.mean_v", "level.max_v")


@query(
    "multi_file_scan",
    with_views(
        ["importance"],
        {},
        f"SELECT target, feature, {r6('importance_mean', 'importance_mean')}, {r6('importance_std', 'importance_std')} FROM importance",
    ),
)
def multi_file_scan(spark, sf_dir):
    """One folder of CSV files per target; the target comes back from the path."""
    path = scratch_path(spark, "importance")
    df = fx.importance(spark, sf_dir)
    df.write.option("header", True).partitionBy("target").csv(path)
    schema = "feature string, importance_mean double, importance_std double"
    return files.read_keyed_csv(spark, path, "*.csv", r"/target=([^/]+)/", schema, "target")


@query(
    "model_save_load",
    with_views(
        ["pairs"],
        FIT_ONE,
        f"SELECT 'direct' AS method, {big('count(*)', 'n')}, {pack_sql('y_true', 'prediction')} FROM scored WHERE part = 'test'",
    ),
)
def model_save_load(spark, sf_dir):
    fitted, test = _fitted(spark, sf_dir)
    path = scratch_path(spark, "model")
    save_model(spark, fitted, path, target="y_true", method="direct")
    loaded, flags = load_model(spark, path)
    scored = loaded.transform(test).withColumn("method", F.lit(flags["method"]))
    return metrics_pack(scored, "y_true", "prediction", ["method"])
