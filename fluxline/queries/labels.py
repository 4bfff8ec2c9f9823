"""Queries on label parsing, source parsing and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions import scalar
from fluxline.queries.catalog import (
    EVENTS_SQL,
    INTERVAL_SQL,
    KP_SQL,
    events,
    interval_rows,
    kp_rows,
    query,
    rounded,
    table,
)
from fluxline.sources import archive, feeds, labels


@query("storm_scale", f"""
SELECT timestamp, kp, CAST(g_scale AS TINYINT) AS g_scale FROM ({KP_SQL})""")
def storm_scale(spark, sf_dir):
    return kp_rows(spark, sf_dir).select(
        "timestamp", "kp", scalar.storm_scale(F.col("kp")).alias("g_scale"))


@query("storm_histogram", f"""
WITH kp AS ({KP_SQL})
SELECT CAST(s.scale AS INTEGER) AS scale, count(kp.kp) AS intervals
FROM generate_series(0, 5) s(scale) LEFT JOIN kp ON kp.g_scale = s.scale GROUP BY 1""")
def storm_histogram(spark, sf_dir):
    return labels.storm_histogram(kp_rows(spark, sf_dir))


@query("index_peak", f"""
WITH kp AS ({KP_SQL})
SELECT count(*) AS intervals, max(kp) AS kp_max,
  min(timestamp) FILTER (WHERE kp = (SELECT max(kp) FROM kp)) AS kp_max_at FROM kp""")
def index_peak(spark, sf_dir):
    return labels.index_peak(kp_rows(spark, sf_dir))


@query("catalog_summary", f"""
WITH c AS ({INTERVAL_SQL})
SELECT count(*) AS intervals, count(*) FILTER (WHERE mc_flag = 2) AS clouds,
  count(*) FILTER (WHERE mc_flag = 1) AS "partial", count(*) FILTER (WHERE mc_flag = 0) AS ejecta,
  count(*) FILTER (WHERE source_row % 3 = 0) AS with_disturbance, min(icme_start) AS first_start,
  max(icme_end) AS last_end, min(dst_min_nt) AS dst_min FROM c""")
def catalog_summary(spark, sf_dir):
    shock = F.when(F.col("source_row") % 3 == 0, F.col("icme_start"))
    return labels.catalog_summary(interval_rows(spark, sf_dir).withColumn("disturbance_time", shock))


@query("kp_join", f"""
SELECT k.ts AS timestamp, k.kp, coalesce(a.ap, -1) AS ap,
  CAST(CASE WHEN round_even(k.kp, 0) < 5 THEN 0 ELSE least(5, round_even(k.kp, 0) - 4) END AS TINYINT) AS g_scale,
  coalesce(s.status, '') AS status
FROM (SELECT date_trunc('hour', ts) AS ts, max(value) AS kp FROM events WHERE event_type = 'signup' GROUP BY 1) k
LEFT JOIN (SELECT date_trunc('hour', ts) AS ts, CAST(max(k) AS INTEGER) AS ap FROM {EVENTS_SQL}
  WHERE event_type = 'click' GROUP BY 1) a ON k.ts = a.ts
LEFT JOIN (SELECT date_trunc('hour', ts) AS ts, min(event_type) AS status FROM events
  WHERE event_type = 'view' GROUP BY 1) s ON k.ts = s.ts
WHERE k.kp <> 2.0""")
def kp_join(spark, sf_dir):
    def hourly(kind, value):
        rows = events(spark, sf_dir, kind)
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return rows.groupBy(hour.alias("timestamp")).agg(value.cast("string").alias("value"))

    kp = hourly("signup", F.max("value"))
    # A value of 2.0 plays the missing marker here.
    kp = kp.withColumn("value", F.when(F.col("value") == "2.0", "-1").otherwise(F.col("value")))
    return labels.join_indices(kp, hourly("click", F.max("k")), hourly("view", F.min("event_type")))


@query("index_documents", f"""
SELECT ts AS timestamp, CAST(k AS VARCHAR) AS value FROM {EVENTS_SQL}
UNION ALL SELECT ts + INTERVAL 1 SECOND, CAST(k + 2 AS VARCHAR) FROM {EVENTS_SQL}""")
def index_documents(spark, sf_dir):
    """Parallel-array documents, one per event; a repeated time keeps its last value."""
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    docs = events(spark, sf_dir).select(F.to_json(F.struct(
        F.array("k", F.col("k") + 1, F.col("k") + 2).alias("Kp"),
        F.array(t, later, later).alias("datetime"))).alias("value"))
    out = labels.parse_index(docs, "Kp")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _catalog_cells(spark, sf_dir):
    """Orders written as catalogue rows, with headers, short rows and noise."""
    o = table(spark, sf_dir, "orders")
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    start = F.date_format(date, "yyyy/MM/dd '0'930")
    month = F.when(key % 37 == 5, "13").otherwise(F.date_format(date, "MM"))
    start = F.concat(F.date_format(date, "yyyy/"), month, F.date_format(date, "/dd"), F.lit(" 930"))
    end = F.date_format(date + F.expr("INTERVAL 1 DAY"), "yyyy/M/d '1815 H'")
    dash = F.lit("...")
    cells = [
        F.when(key % 50 == 3, "Disturbance Y/M/D").otherwise(
            F.concat(F.lit("dg ("), F.date_format(date, "yyyy/MM/dd 0000"), F.lit(")"))),
        start,
        F.when(key % 41 == 7, dash).otherwise(end),
        dash, dash, dash, dash, dash, dash,
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")),
        dash,
        F.concat((key % 900).cast("string"), F.lit(" S")),
        F.lit("...."), F.lit("nan"),
        F.concat((key % 3).cast("string"), F.lit("H")),
        F.concat(F.lit("-"), (key % 300).cast("string")),
        dash, F.lit("none"),
    ]
    row = F.array(*cells)
    return o.select(
        key.alias("row"), F.when(key % 60 == 11, F.slice(row, 1, 12)).otherwise(row).alias("cells"))


@query("catalog_parse", """
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 60 <> 11 AND o_orderkey % 50 <> 3
  AND o_orderkey % 37 <> 5 AND o_orderkey % 41 <> 7)
SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS source_row,
  date_trunc('day', o_orderdate) AS disturbance_time,
  date_trunc('day', o_orderdate) + INTERVAL '9:30' HOUR TO MINUTE AS icme_start,
  date_trunc('day', o_orderdate) + INTERVAL 1 DAY + INTERVAL '18:15' HOUR TO MINUTE AS icme_end,
  o_orderstatus AS quality, CAST(o_orderkey % 900 AS DOUBLE) AS v_icme_km_s,
  CAST(NULL AS DOUBLE) AS v_max_km_s, CAST(o_orderkey % 3 AS TINYINT) AS mc_flag,
  CASE WHEN o_orderkey % 300 = 0 THEN 0 ELSE -CAST(o_orderkey % 300 AS DOUBLE) END AS dst_min_nt,
  CAST(NULL AS TIMESTAMP) AS lasco_cme_time FROM o""".replace(
    "INTERVAL '9:30' HOUR TO MINUTE", "INTERVAL 9 HOUR + INTERVAL 30 MINUTE").replace(
    "INTERVAL '18:15' HOUR TO MINUTE", "INTERVAL 18 HOUR + INTERVAL 15 MINUTE"))
def catalog_parse(spark, sf_dir):
    out = labels.parse_catalog(_catalog_cells(spark, sf_dir))
    times = ("disturbance_time", "icme_start", "icme_end", "lasco_cme_time")
    return out.select(
        "source_row", *[F.col(t).cast("timestamp_ntz").alias(t) for t in times], "quality",
        "v_icme_km_s", "v_max_km_s", "mc_flag", "dst_min_nt")


def _archive_lines(spark, sf_dir, kind):
    """Events as archive lines; some commented out, some cut short."""
    e = events(spark, sf_dir, kind)
    v, k = F.col("value").cast("string"), F.col("k")
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'789Z'")
    one = F.lit("0.1")
    plasma = [t, (k % 2).cast("string"), F.concat(F.lit("-"), v), F.lit("3.0"), F.lit("4.0"),
              one, one, one, F.lit("37.5"), one, v, one, F.lit("bad"), one]
    full = F.concat_ws(",", *plasma)
    short = F.concat_ws(",", *plasma[:9])
    line = F.when(k == 3, F.concat(F.lit("# "), full)).when(k == 5, short).when(
        k == 9, F.concat(full, F.lit(",extra,cells"))).otherwise(full)
    return e.select("event_id", line.alias("value"))


@query("archive_plasma", f"""
SELECT ts AS timestamp, value AS proton_density_n_cc, round(sqrt(value * value + 25.0), 6) AS bulk_speed_km_s,
  0.0::DOUBLE AS ion_temperature_k, CASE WHEN value = 0 THEN 0 ELSE -value END AS vx_gse_km_s,
  37.5::DOUBLE AS thermal_speed_km_s, CAST(k % 2 AS DOUBLE) AS data_quality_flag
FROM {EVENTS_SQL} WHERE event_type = 'purchase' AND k NOT IN (3, 5)""")
def archive_plasma(spark, sf_dir):
    rows = archive.parse_plasma(_archive_lines(spark, sf_dir, "purchase"))
    return rounded(rows.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "proton_density_n_cc",
        "bulk_speed_km_s", "ion_temperature_k", "vx_gse_km_s", "thermal_speed_km_s",
        "data_quality_flag"), "bulk_speed_km_s")


@query("archive_mag", f"""
SELECT ts AS timestamp, CASE WHEN value = 0 THEN 0 ELSE CAST(k % 2 AS DOUBLE) END AS bt_nt, 3.0::DOUBLE AS bx_gse_nt, 4.0::DOUBLE AS by_gse_nt,
  0.1::DOUBLE AS bz_gse_nt FROM {EVENTS_SQL} WHERE event_type = 'view' AND k <> 3""")
def archive_mag(spark, sf_dir):
    rows = archive.parse_mag(_archive_lines(spark, sf_dir, "view"))
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *C.MAG_COLUMNS)


@query("archive_rejects", f"""
SELECT 'short row' AS reject_reason, count(*) AS n FROM {EVENTS_SQL}
WHERE event_type = 'purchase' AND k = 5 HAVING count(*) > 0""")
def archive_rejects(spark, sf_dir):
    bad = archive.rejects(_archive_lines(spark, sf_dir, "purchase"), "plasma")
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("live_mag", """
SELECT ts AS timestamp, value AS bx_gsm_nt, 1.5::DOUBLE AS by_gsm_nt, 0.0::DOUBLE AS bz_gsm_nt,
  0.0::DOUBLE AS bt_nt FROM events
WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""")
def live_mag(spark, sf_dir):
    """Array-of-arrays documents, one per event; unreadable numbers become 0."""
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    docs = events(spark, sf_dir, "view").select(F.to_json(F.array(
        F.array(*[F.lit(x) for x in ("time_tag", "bx", "by", "bz", "bt")]),
        F.array(t, F.col("value").cast("string"), F.lit("1.5"), F.lit("?"), F.lit(None).cast("string")),
        F.array(F.lit("never"), *[F.lit("1")] * 4),
    )).alias("value"))
    rows = feeds.parse_live(docs, feeds.LIVE_MAG, "magnetic", C.APID_MAG,
                            "2024-01-03 00:00:00", "2024-01-20 00:00:00")
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *feeds.LIVE_MAG)


def _aircraft_docs(spark, sf_dir):
    e = events(spark, sf_dir, "click")
    v, k = F.col("value"), F.col("k")
    seen = F.unix_timestamp(F.col("ts").cast("timestamp"))

    def state(name, callsign, lat, ground):
        cells = [name, callsign, F.lit("Nowhere"), seen, seen, F.lit(-100.25) + 0 * v, lat,
                 v * 10, ground, v / 3, F.lit(90.06), F.lit(None).cast("double"), F.lit(None).cast("string"),
                 v * 10 + 0.02, F.lit("7000"), F.lit(False), F.lit(0)]
        return F.array(*[c.cast("string") for c in cells])

    name = F.concat(F.lit("ab"), F.col("event_id").cast("string"))
    return e.select(F.to_json(F.struct(seen.alias("time"), F.array(
        state(name, F.lit("  "), 24.5 + k / 10, F.lit(False)),
        state(F.concat(name, F.lit("x")), F.lit("on ground"), 30 + 0 * v, F.lit(True)),
        state(F.concat(name, F.lit("y")), F.lit("no place"), F.lit(None).cast("double"), F.lit(False)),
    ).alias("states"))).alias("value"))


_AIRCRAFT = f"""SELECT 'AIRCRAFT_AB' || event_id AS spacecraft_id, 'ab' || event_id AS callsign,
  date_trunc('second', ts) AS timestamp, round(24.5 + k / 10, 4) AS latitude_deg,
  round(value * 10, 1) AS baro_altitude_m, round(value * 10 + 0.02, 1) AS geo_altitude_m,
  90.1::DOUBLE AS true_track_deg, 0.0::DOUBLE AS vertical_rate_ms, '7000' AS squawk
FROM {EVENTS_SQL} WHERE event_type = 'click'"""


@query("aircraft_states", _AIRCRAFT)
def aircraft_states(spark, sf_dir):
    rows = feeds.parse_aircraft(_aircraft_docs(spark, sf_dir))
    return rows.select(
        "spacecraft_id", "callsign", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "latitude_deg", "baro_altitude_m", "geo_altitude_m", "true_track_deg", "vertical_rate_ms", "squawk")


@query("aircraft_in_area", f"""
SELECT spacecraft_id, latitude_deg FROM ({_AIRCRAFT}) WHERE latitude_deg <= 28.05""")
def aircraft_in_area(spark, sf_dir):
    """An area that leaves out the northern part."""
    area = (24.0, 28.05, -140.0, -52.0)
    return feeds.parse_aircraft(_aircraft_docs(spark, sf_dir), box=area).select("spacecraft_id", "latitude_deg")


@query("low_aircraft", f"""
SELECT spacecraft_id, baro_altitude_m FROM ({_AIRCRAFT}) WHERE baro_altitude_m > 0 AND baro_altitude_m < 1000""")
def low_aircraft(spark, sf_dir):
    rows = feeds.current_positions(feeds.parse_aircraft(_aircraft_docs(spark, sf_dir)))
    return feeds.low_aircraft(rows).select("spacecraft_id", "baro_altitude_m")


@query("anomaly_positions", f"""
SELECT latitude_deg AS lat, -100.25::DOUBLE AS lon, 'aircraft' AS type, spacecraft_id AS id
FROM ({_AIRCRAFT}) WHERE baro_altitude_m > 0 AND baro_altitude_m < 1000
UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, 'spacecraft', 'craft-' || user_id FROM events
WHERE event_type = 'error' AND value > 100 GROUP BY user_id""")
def anomaly_positions(spark, sf_dir):
    sessions = events(spark, sf_dir, "error").groupBy("user_id").agg(
        F.count_if(F.col("value") > 100).alias("anomaly_count")).withColumn(
        "spacecraft_id", F.concat(F.lit("craft-"), F.col("user_id").cast("string")))
    return feeds.anomaly_positions(feeds.parse_aircraft(_aircraft_docs(spark, sf_dir)), sessions)


@query("satellites", """
SELECT 'SAT_' || upper(replace(p_name, ' ', '_')) || '_'
    || CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '0' END AS spacecraft_id,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '0' END AS catalog_number,
  CAST(p_size AS DOUBLE) AS period_min, 0.0::DOUBLE AS inclination_deg, p_retailprice AS apogee_km,
  0.0::DOUBLE AS perigee_km FROM part""")
def satellites(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    docs = p.select(F.to_json(F.array(F.struct(
        F.col("p_name").alias("OBJECT_NAME"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).alias("NORAD_CAT_ID"),
        F.col("p_size").cast("string").alias("PERIOD"),
        F.col("p_retailprice").cast("string").alias("APOGEE"),
        F.lit("").alias("PERIGEE")))).alias("value"))
    rows = feeds.parse_satellites(docs, F.lit("2024-01-01").cast("timestamp"))
    return rows.select("spacecraft_id", "catalog_number", "period_min", "inclination_deg",
                       "apogee_km", "perigee_km")


@query("iso_times", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS archive_text,
  CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS iso_text, ts AS parsed FROM events""")
def iso_times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    text = scalar.archive_time_text(ts)
    return events(spark, sf_dir).select(
        "event_id", text.alias("archive_text"), scalar.iso_text(ts).alias("iso_text"),
        scalar.archive_time(F.concat(F.trim(F.regexp_replace(text, "Z", "")), F.lit("999Z")))
        .cast("timestamp_ntz").alias("parsed"))


@query("packet_view", """
SELECT event_id, CAST(round(value / 3, 2) AS VARCHAR) AS shown, 'Aircraft State' AS title,
  CAST(1 AS INTEGER) AS parameters FROM events""")
def packet_view(spark, sf_dir):
    raw = F.create_map(F.lit("reading"), (F.col("value") / 3).cast("string"),
                       F.lit("data_type"), F.lit("aircraft_state"))
    view = scalar.tidy_parameters(raw)
    return events(spark, sf_dir).select(
        "event_id", view["reading"].alias("shown"), scalar.title_text(raw["data_type"]).alias("title"),
        F.size(view).alias("parameters"))


@query("packet_union", f"""
SELECT event_type, count(*) AS n, count(speed) AS with_speed, count(bt) AS with_field FROM (
  SELECT event_type, value + 300 AS speed, CAST(NULL AS DOUBLE) AS bt FROM {EVENTS_SQL} WHERE event_type = 'purchase'
  UNION ALL SELECT event_type, NULL, value FROM {EVENTS_SQL} WHERE event_type = 'view') GROUP BY 1""")
def packet_union(spark, sf_dir):
    plasma = events(spark, sf_dir, "purchase").select("event_type", (F.col("value") + 300).alias("speed"))
    field = events(spark, sf_dir, "view").select("event_type", F.col("value").alias("bt"))
    return plasma.unionByName(field, allowMissingColumns=True).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("speed").alias("with_speed"),
        F.count("bt").alias("with_field"))
