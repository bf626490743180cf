"""Scans, contracts and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import clean
from ..schema import PRESSURE_TO_PA, SensorSchema, column_contract, resolve_time, strip_headers
from .base import big, query, r6, with_views

# Hour anchors of a timestamp column in SQL.
ANCHORS = """
SELECT *, date_diff('microsecond', hour_floor, {t}) / 60000000.0::DOUBLE AS delta_floor_min,
  date_diff('microsecond', {t}, hour_ceil) / 60000000.0::DOUBLE AS delta_ceil_min
FROM (SELECT *, date_trunc('hour', {t}) AS hour_floor,
  CASE WHEN {t} = date_trunc('hour', {t}) THEN {t} ELSE date_trunc('hour', {t}) + INTERVAL 1 HOUR END AS hour_ceil FROM {src})
"""
NEAREST = """
SELECT *, CASE WHEN delta_floor_min <= delta_ceil_min THEN hour_floor ELSE hour_ceil END AS hour_nearest,
  least(delta_floor_min, delta_ceil_min) AS delta_nearest_min FROM {src}
"""
DELTAS = ("delta_floor_min", "delta_ceil_min", "delta_nearest_min")
ANCHOR_SQL = "hour_floor, hour_ceil, hour_nearest, " + ", ".join(big(f"round({c} * 60000000)", c) for c in DELTAS)
PARSED = (
    "SELECT event_id, TRY_CAST(time_s AS TIMESTAMP) AS time, TRY_CAST(v_s AS DOUBLE) AS v, "
    "TRY_CAST(pressure_s AS DOUBLE) AS pressure, tag FROM dirty WHERE TRY_CAST(time_s AS TIMESTAMP) IS NOT NULL"
)
DEDUPED = (
    "SELECT time, avg(v) AS v, avg(pressure) AS pressure, arg_min(tag, event_id) AS tag FROM parsed GROUP BY time"
)
TO_PA = (
    "CASE WHEN median(pressure) OVER () BETWEEN 800 AND 1200 THEN 100.0::DOUBLE "
    "WHEN median(pressure) OVER () BETWEEN 80 AND 120 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END"
)


def micros(name):
    """Minutes as whole microseconds: comparable without rounding ties."""
    return F.round(F.col(name) * 60_000_000).cast("long").alias(name)


def anchor_cols():
    return ["hour_floor", "hour_ceil", "hour_nearest", *map(micros, DELTAS)]


def _text(spark, sf_dir):
    return fx.dirty(spark, sf_dir).withColumnsRenamed({"time_s": "time", "v_s": "v", "pressure_s": "pressure"})


def _parsed(spark, sf_dir):
    return clean.coerce_numeric(clean.coerce_time(_text(spark, sf_dir), "time"), ["v", "pressure"])


@query(
    "scan_readings",
    with_views(
        ["micro"], {}, f"SELECT {big('count(*)', 'n')}, min(ts) AS first_ts, max(ts) AS last_ts, {r6('avg(v)', 'v_mean')}, {r6('avg(hum)', 'hum_mean')} FROM micro"
    ),
)
def scan_readings(spark, sf_dir):
    return fx.micro(spark, sf_dir).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.avg("v").alias("v_mean"),
        F.avg("hum").alias("hum_mean"),
    )


@query(
    "column_contract",
    with_views(
        ["micro"],
        {},
        f"SELECT date_trunc('day', ts) AS day, {big('count(*)', 'n')}, {r6('avg(v)', 'v_mean')}, "
        f"{big('count(CAST(NULL AS DOUBLE))', 'n_pressure')} FROM micro GROUP BY 1",
    ),
)
def contract(spark, sf_dir):
    raw = fx.micro(spark, sf_dir).withColumnsRenamed({"ts": " Time ", "v": "v "})
    df = resolve_time(column_contract(strip_headers(raw), ["Time", "v"], {"pressure": "double"}))
    return df.groupBy(F.date_trunc("day", "dt").cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("n"), F.avg("v").alias("v_mean"), F.count("pressure").alias("n_pressure")
    )


@query("coerce_time", with_views(["dirty"], {"parsed": PARSED}, "SELECT event_id, time FROM parsed"))
def coerce_time(spark, sf_dir):
    return clean.coerce_time(_text(spark, sf_dir), "time").select("event_id", "time")


@query(
    "coerce_numeric",
    with_views(
        ["dirty"],
        {},
        f"SELECT event_id, {r6('TRY_CAST(v_s AS DOUBLE)', 'v')}, {r6('TRY_CAST(pressure_s AS DOUBLE)', 'pressure')} FROM dirty",
    ),
)
def coerce_numeric(spark, sf_dir):
    return clean.coerce_numeric(_text(spark, sf_dir), ["v", "pressure"]).select("event_id", "v", "pressure")


@query(
    "normalize_unit",
    with_views(["dirty"], {"parsed": PARSED}, f"SELECT event_id, {r6(f'pressure * {TO_PA}', 'pressure')} FROM parsed"),
)
def normalize_unit(spark, sf_dir):
    return clean.normalize_unit(_parsed(spark, sf_dir), "pressure", PRESSURE_TO_PA).select("event_id", "pressure")


@query(
    "dedupe_time",
    with_views(
        ["dirty"],
        {"parsed": PARSED, "deduped": DEDUPED},
        f"SELECT time, {r6('v', 'v')}, {r6('pressure', 'pressure')}, tag FROM deduped",
    ),
)
def dedupe_time(spark, sf_dir):
    return clean.dedupe_time(_parsed(spark, sf_dir), ["time"], ["v", "pressure"], {"tag": "event_id"})


@query(
    "range_null_out",
    with_views(
        ["dirty"],
        {"parsed": PARSED},
        f"SELECT event_id, {r6('CASE WHEN v >= 0 THEN v END', 'v')}, "
        f"{r6('CASE WHEN pressure BETWEEN 960 AND 1040 THEN pressure END', 'pressure')} FROM parsed",
    ),
)
def range_null_out(spark, sf_dir):
    ranges = {"v": (0.0, None), "pressure": (960.0, 1040.0)}
    return clean.range_null_out(_parsed(spark, sf_dir), ranges).select("event_id", "v", "pressure")


@query(
    "winsorize",
    with_views(
        ["dirty"],
        {
            "parsed": PARSED,
            "lim": "SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM parsed",
        },
        f"SELECT event_id, {r6('CASE WHEN v IS NOT NULL THEN greatest(lo, least(hi, v)) END', 'v')} FROM parsed, lim",
    ),
)
def winsorize(spark, sf_dir):
    return clean.winsorize(_parsed(spark, sf_dir), ["v"]).select("event_id", "v")


@query(
    "drop_all_null",
    with_views(
        ["dirty"],
        {"parsed": PARSED},
        f"SELECT event_id, time, {r6('v', 'v')} FROM parsed WHERE v IS NOT NULL",
    ),
)
def drop_all_null(spark, sf_dir):
    return clean.drop_all_null(_parsed(spark, sf_dir), ["event_id", "time"], ["v", "not_there"])


@query(
    "exclude_bad_days",
    with_views(
        ["site_readings"],
        {},
        f"SELECT event_type AS target, {big('count(*)', 'n')}, {r6('avg(v)', 'v_mean')} FROM site_readings "
        "WHERE NOT ((event_type = 'click' AND CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-06')) "
        "OR (event_type = 'view' AND CAST(ts AS DATE) = DATE '2024-01-19')) GROUP BY 1",
    ),
)
def exclude_bad_days(spark, sf_dir):
    days = {"click": ("2024-01-05", "2024-01-06"), "view": ("2024-01-19",)}
    kept = clean.exclude_days(fx.site_readings(spark, sf_dir), "ts", days, F.col("event_type"))
    return kept.groupBy(F.col("event_type").alias("target")).agg(F.count("*").alias("n"), F.avg("v").alias("v_mean"))


@query(
    "missing_report",
    with_views(
        ["micro_wide"],
        {},
        " UNION ALL ".join(
            f"SELECT 'micro' AS name, {big('count(*)', 'rows')}, CAST(8 AS BIGINT) AS cols, '{c}' AS \"column\", "
            f"""{r6(f'avg(CASE WHEN "{c}" IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM micro_wide"""
            for c in (*fx.EVENT_TYPES, "hum")
        ),
    ),
)
def missing_report(spark, sf_dir):
    return clean.missing_report(fx.micro_wide(spark, sf_dir), "micro", [*fx.EVENT_TYPES, "hum"])


@query(
    "hour_anchors",
    with_views(
        ["micro"],
        {"a": ANCHORS.format(t="ts", src="micro"), "b": NEAREST.format(src="a")},
        f"SELECT event_id, {ANCHOR_SQL} FROM b",
    ),
)
def hour_anchors(spark, sf_dir):
    return clean.hour_anchors(fx.micro(spark, sf_dir), "ts").select("event_id", *anchor_cols())


@query(
    "clean_readings",
    with_views(
        ["dirty"],
        {
            "parsed": PARSED,
            "deduped": DEDUPED,
            "units": f"SELECT time, v, tag, pressure * {TO_PA} AS pressure FROM deduped",
            "ranged": "SELECT time, tag, CASE WHEN v >= 0 THEN v END AS v, "
            "CASE WHEN pressure BETWEEN 80000 AND 110000 THEN pressure END AS pressure FROM units",
            "lim": "SELECT quantile_cont(v, 0.005) AS v0, quantile_cont(v, 0.995) AS v1, "
            "quantile_cont(pressure, 0.005) AS p0, quantile_cont(pressure, 0.995) AS p1 FROM ranged",
            "w": "SELECT time, tag, CASE WHEN v IS NOT NULL THEN greatest(v0, least(v1, v)) END AS v, "
            "CASE WHEN pressure IS NOT NULL THEN greatest(p0, least(p1, pressure)) END AS pressure FROM ranged, lim",
            "a": ANCHORS.format(t="time", src="w"),
            "b": NEAREST.format(src="a"),
        },
        f"SELECT time, tag, {r6('v', 'v')}, {r6('pressure', 'pressure')}, {ANCHOR_SQL} FROM b",
    ),
)
def clean_readings(spark, sf_dir):
    schema = SensorSchema("time", ("v",), ("pressure",))
    return clean.clean_readings(
        _text(spark, sf_dir),
        schema,
        {"v": (0.0, None), "pressure": (8.0e4, 1.1e5)},
        {"pressure": PRESSURE_TO_PA},
        others={"tag": "event_id"},
    ).select("time", "tag", "v", "pressure", *anchor_cols())
