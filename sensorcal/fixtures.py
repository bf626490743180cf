"""Sensor-shaped views over the generic test tables, each as a DataFrame and as the same view in SQL.

No view filters rows: every query reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.time import hour_floor

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reading():
    """Event values on a scale that keeps means away from rounding ties."""
    return F.col("value") / 0.97


def _hum():
    return F.get_json_object("props", "$.k").cast("double")


def micro(spark, sf_dir) -> DataFrame:
    """Low-cost sensor: all events as irregular readings with humidity."""
    return table(spark, sf_dir, "events").select("event_id", "ts", reading().alias("v"), _hum().alias("hum"))


def station(spark, sf_dir) -> DataFrame:
    """Reference: hourly mean over all events."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(hour_floor(F.col("ts")).alias("hour")).agg(F.avg(reading()).alias("y"))


def micro_wide(spark, sf_dir) -> DataFrame:
    """One channel per event type, mostly missing, plus humidity."""
    ev = table(spark, sf_dir, "events")
    channels = [F.when(F.col("event_type") == t, reading()).alias(t) for t in EVENT_TYPES]
    return ev.select("event_id", "ts", *channels, _hum().alias("hum"))


def station_wide(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    channels = [F.avg(F.when(F.col("event_type") == t, reading())).alias(t) for t in EVENT_TYPES]
    return ev.groupBy(hour_floor(F.col("ts")).alias("hour")).agg(*channels)


def micro_keyed(spark, sf_dir) -> DataFrame:
    """One sensor per user."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sensor"), "event_id", "ts", reading().alias("v"))


def station_keyed(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("sensor"), hour_floor(F.col("ts")).alias("hour")).agg(
        F.avg(reading()).alias("y")
    )


def site_readings(spark, sf_dir) -> DataFrame:
    """Multi-site network: one site per user, two weather columns."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("site_id"),
        "event_type",
        reading().alias("v"),
        _hum().alias("hum"),
        F.minute("ts").cast("double").alias("wind"),
    )


def sites(spark, sf_dir) -> DataFrame:
    """Scattered coordinates for every user that occurs in the events."""
    sid = F.col("site_id")
    sq = (sid * sid).cast("double")
    lat, lon = sq * 0.6180339887498949, sq * 0.7548776662466927
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("site_id"))
        .distinct()
        .select(
            "site_id",
            (F.lit(30.0) + (lat - F.floor(lat)) * 0.1).alias("lat"),
            (F.lit(114.0) + (lon - F.floor(lon)) * 0.1).alias("lon"),
        )
    )


def dirty(spark, sf_dir) -> DataFrame:
    """Text readings with junk numbers, negative values, bad and repeated times, pressure in hPa."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 97 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:00")).alias("time_s"),
        F.when(e % 89 == 0, "bad").when(e % 83 == 0, "-5").otherwise(reading().cast("string")).alias("v_s"),
        (F.lit(950) + _hum().cast("int")).cast("string").alias("pressure_s"),
        F.col("event_type").alias("tag"),
    )


PAIR_ORDER = ("dt", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def pairs(spark, sf_dir) -> DataFrame:
    """Large paired series: truth and raw estimate with time, group and a covariate."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").alias("dt"),
        F.col("l_returnflag").alias("grp"),
        (price / 977.0).alias("y_true"),
        (price * (1 - F.col("l_discount")) / 977.0 + F.col("l_quantity") * 0.3).alias("y_raw"),
        (F.col("l_tax") * 100).alias("hum"),
    )


def importance(spark, sf_dir) -> DataFrame:
    """Importance table: several targets × features."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("target"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("feature"),
        )
        .agg(
            F.round(F.avg("l_discount") - 0.05, 9).alias("importance_mean"),
            F.round(F.stddev_pop("l_discount"), 9).alias("importance_std"),
        )
    )


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"

# The same views in SQL, to be used as common table expressions.
SQL = {
    "micro": f"SELECT event_id, ts, value / 0.97::DOUBLE AS v, {_K} AS hum FROM events",
    "station": "SELECT date_trunc('hour', ts) AS hour, avg(value / 0.97::DOUBLE) AS y FROM events GROUP BY 1",
    "micro_wide": "SELECT event_id, ts, "
    + ", ".join(f"CASE WHEN event_type = '{t}' THEN value / 0.97::DOUBLE END AS \"{t}\"" for t in EVENT_TYPES)
    + f", {_K} AS hum FROM events",
    "station_wide": "SELECT date_trunc('hour', ts) AS hour, "
    + ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN value / 0.97::DOUBLE END) AS \"{t}\"" for t in EVENT_TYPES)
    + " FROM events GROUP BY 1",
    "micro_keyed": "SELECT user_id AS sensor, event_id, ts, value / 0.97::DOUBLE AS v FROM events",
    "station_keyed": "SELECT user_id AS sensor, date_trunc('hour', ts) AS hour, avg(value / 0.97::DOUBLE) AS y FROM events GROUP BY 1, 2",
    "site_readings": f"SELECT event_id, ts, user_id AS site_id, event_type, value / 0.97::DOUBLE AS v, {_K} AS hum, "
    "CAST(minute(ts) AS DOUBLE) AS wind FROM events",
    "sites": "SELECT site_id, 30.0::DOUBLE + (a - floor(a)) * 0.1::DOUBLE AS lat, 114.0::DOUBLE + (b - floor(b)) * 0.1::DOUBLE AS lon "
    "FROM (SELECT user_id AS site_id, CAST(user_id * user_id AS DOUBLE) * 0.6180339887498949::DOUBLE AS a, "
    "CAST(user_id * user_id AS DOUBLE) * 0.7548776662466927::DOUBLE AS b FROM (SELECT DISTINCT user_id FROM events))",
    "dirty": "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:00') END AS time_s, "
    "CASE WHEN event_id % 89 = 0 THEN 'bad' WHEN event_id % 83 = 0 THEN '-5' ELSE CAST(value / 0.97::DOUBLE AS VARCHAR) END AS v_s, "
    f"CAST(950 + CAST({_K} AS INT) AS VARCHAR) AS pressure_s, event_type AS tag FROM events",
    "pairs": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS dt, l_returnflag AS grp, "
    "l_extendedprice / 977.0::DOUBLE AS y_true, "
    "l_extendedprice * (1 - l_discount) / 977.0::DOUBLE + l_quantity * 0.3::DOUBLE AS y_raw, l_tax * 100 AS hum FROM lineitem",
    "importance": "SELECT l_returnflag || l_linestatus AS target, 's' || CAST(l_suppkey AS VARCHAR) AS feature, "
    "round(avg(l_discount) - 0.05::DOUBLE, 9) AS importance_mean, round(stddev_pop(l_discount), 9) AS importance_std "
    "FROM lineitem GROUP BY 1, 2",
}
