"""Live feed files: JSON documents of arrays, aircraft states, satellites.

A file is one saved response and is parsed by one task; files are read in
parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions.scalar import key_id, number_or, tracked_id

# Fixed values -- feed columns by position, time format, defaults.
LIVE_PLASMA = {"proton_density_n_cc": 1, "bulk_speed_km_s": 2, "ion_temperature_k": 3}
LIVE_MAG = {"bx_gsm_nt": 1, "by_gsm_nt": 2, "bz_gsm_nt": 3, "bt_nt": 4}
LIVE_TIME = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"
NORTH_AMERICA = (24.0, 72.0, -140.0, -52.0)  # min lat, max lat, min lon, max lon
APID_AIRCRAFT = 0x80
APID_SATELLITE = 0x90

SATELLITE_RECORD = (
    "array<struct<OBJECT_NAME: string, CCSDS_OMID: string, NORAD_CAT_ID: string, PERIOD: string, "
    "INCLINATION: string, APOGEE: string, PERIGEE: string, ECCENTRICITY: string, "
    "RA_OF_ASC_NODE: string>>"
)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one per row, in ``value``."""
    return spark.read.text(path, wholetext=True)


def parse_live(
    docs: DataFrame,
    columns: dict[str, int],
    data_type: str,
    apid: int,
    start: str,
    end: str,
    spacecraft: str = "DSCOVR",
    source: str = "noaa_dscovr",
    bad: str = "zero",
) -> DataFrame:
    """Packets of an array-of-arrays document; row 0 is the header.

    Keeps [start, end], both ends included. Records that are too short or have
    no readable time are dropped.
    """
    rows = docs.select(
        F.posexplode(F.from_json("value", "array<array<string>>")).alias("at", "cells")
    ).filter(F.col("at") > 0)
    ts = F.try_to_timestamp(F.get("cells", F.lit(0)), F.lit(LIVE_TIME))
    width = max(columns.values()) + 1
    return (
        rows.withColumn("timestamp", ts)
        .filter((F.size("cells") >= width) & F.col("timestamp").between(
            F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
        .select(
            key_id(F.lit(source), F.lit(apid), F.array_join("cells", ",", "")).alias("packet_id"),
            "timestamp",
            F.lit(spacecraft).alias("spacecraft_id"),
            F.lit("TM").alias("packet_type"),
            F.lit(apid).alias("apid"),
            F.lit(source).alias("source"),
            F.lit(data_type).alias("data_type"),
            *[number_or(F.get("cells", F.lit(i)), bad).alias(n) for n, i in columns.items()],
        )
    )


def read_live_plasma(spark: SparkSession, path: str, start: str, end: str,
                     apid: int = C.APID_PLASMA, **kw) -> DataFrame:
    return parse_live(documents(spark, path), LIVE_PLASMA, "plasma", apid, start, end, **kw)


def read_live_mag(spark: SparkSession, path: str, start: str, end: str,
                  apid: int = C.APID_MAG, **kw) -> DataFrame:
    return parse_live(documents(spark, path), LIVE_MAG, "magnetic", apid, start, end, **kw)


def live_packets(plasma: DataFrame, mag: DataFrame, start: str, end: str, second: bool = False) -> DataFrame:
    """Plasma then magnetic packets of two tables of documents; ``second`` says
    they are the other craft's."""
    kw = {"spacecraft": "ACE", "source": "ace_spacecraft"} if second else {}
    first = parse_live(plasma, LIVE_PLASMA, "plasma", C.APID_PLASMA_SECOND if second else C.APID_PLASMA, start, end, **kw)
    rest = parse_live(mag, LIVE_MAG, "magnetic", C.APID_MAG_SECOND if second else C.APID_MAG, start, end, **kw)
    return first.unionByName(rest, allowMissingColumns=True)


def read_live(spark: SparkSession, plasma_path: str, mag_path: str, start: str, end: str,
              second: bool = False) -> DataFrame:
    """Plasma then magnetic packets in one table; ``second`` is the other craft."""
    return live_packets(documents(spark, plasma_path), documents(spark, mag_path), start, end, second)


def parse_aircraft(docs: DataFrame, limit: int | None = None,
                   box: Sequence[float] | None = None,
                   source: str = "opensky_network") -> DataFrame:
    """Airborne aircraft with a position from state-vector documents.

    All states count unless ``limit`` takes the first of each document, before
    any filter, or ``box`` (such as ``NORTH_AMERICA``) those in an area.
    ``timestamp`` is the last contact; the time of reading is the reader's.
    """
    doc = F.from_json("value", "struct<time: bigint, states: array<array<string>>>")
    rows = docs.withColumn("__d", doc).select(
        F.col("__d.time").alias("time"), F.posexplode("__d.states").alias("at", "s"))
    if limit is not None:
        rows = rows.filter(F.col("at") < limit)

    def text(i: int, default: str | None = None) -> Column:
        c = F.nullif(F.trim(F.get("s", F.lit(i))), F.lit(""))
        return c if default is None else F.coalesce(c, F.lit(default))

    def number(i: int) -> Column:
        return F.get("s", F.lit(i)).try_cast("double")

    icao = text(0, "unknown")
    lat, lon = number(6), number(5)
    aloft = ~F.coalesce(F.get("s", F.lit(8)).try_cast("boolean"), F.lit(False))
    seen = F.coalesce(F.nullif(number(4), F.lit(0.0)), F.col("time").cast("double"))
    out = rows.filter(lat.isNotNull() & lon.isNotNull() & aloft)
    if box is not None:
        out = out.filter(lat.between(box[0], box[1]) & lon.between(box[2], box[3]))

    def rounded(i: int, digits: int) -> Column:
        return F.round(F.coalesce(number(i), F.lit(0.0)), digits)

    return out.select(
        key_id(F.lit(source), icao, seen).alias("packet_id"),
        F.timestamp_seconds(seen).alias("timestamp"),
        tracked_id("AIRCRAFT", icao).alias("spacecraft_id"),
        F.lit("TM").alias("packet_type"),
        F.lit(APID_AIRCRAFT).alias("apid"),
        F.pmod("at", F.lit(C.SEQUENCE_MODULO)).cast("int").alias("sequence_count"),
        F.lit(source).alias("source"),
        F.lit("aircraft_state").alias("data_type"),
        icao.alias("icao24"),
        F.coalesce(text(1), icao).alias("callsign"),
        text(2, "unknown").alias("country"),
        F.round(lat, 4).alias("latitude_deg"),
        F.round(lon, 4).alias("longitude_deg"),
        rounded(7, 1).alias("baro_altitude_m"),
        rounded(13, 1).alias("geo_altitude_m"),
        rounded(9, 1).alias("velocity_ms"),
        rounded(10, 1).alias("true_track_deg"),
        rounded(11, 2).alias("vertical_rate_ms"),
        F.coalesce(text(14), F.lit("")).alias("squawk"),
    )


def read_aircraft(spark: SparkSession, path: str, **kw) -> DataFrame:
    return parse_aircraft(documents(spark, path), **kw)


def parse_satellites(docs: DataFrame, as_of: Column, group: str = "ISS",
                     limit: int | None = None) -> DataFrame:
    """Satellites from catalogue documents; missing numbers are 0."""
    rows = docs.select(F.posexplode(F.from_json("value", SATELLITE_RECORD)).alias("at", "r"))
    if limit is not None:
        rows = rows.filter(F.col("at") < limit)
    name = F.coalesce("r.OBJECT_NAME", F.lit("UNKNOWN"))
    number = F.coalesce("r.CCSDS_OMID", "r.NORAD_CAT_ID", F.col("at").cast("string"))
    # Fixed values -- output name by record field.
    fields = {
        "period_min": "PERIOD",
        "inclination_deg": "INCLINATION",
        "apogee_km": "APOGEE",
        "perigee_km": "PERIGEE",
        "eccentricity": "ECCENTRICITY",
        "raan_deg": "RA_OF_ASC_NODE",
    }
    return rows.select(
        key_id(F.lit(group), number, as_of).alias("packet_id"),
        as_of.alias("timestamp"),
        tracked_id("SAT", F.concat_ws("_", name, number)).alias("spacecraft_id"),
        F.lit("TM").alias("packet_type"),
        F.lit(APID_SATELLITE).alias("apid"),
        F.pmod("at", F.lit(C.SEQUENCE_MODULO)).cast("int").alias("sequence_count"),
        F.lit(f"celestrak_{group.lower()}").alias("source"),
        F.lit("orbital_elements").alias("data_type"),
        name.alias("satellite_name"),
        number.alias("catalog_number"),
        F.lit(group).alias("group"),
        *[number_or(F.col(f"r.{f}")).alias(n) for n, f in fields.items()],
    )


def read_satellites(spark: SparkSession, path: str, as_of: Column, **kw) -> DataFrame:
    return parse_satellites(documents(spark, path), as_of, **kw)


def low_aircraft(aircraft: DataFrame) -> DataFrame:
    """Aircraft above ground and below 1000 m."""
    alt = F.col("baro_altitude_m")
    return aircraft.filter((alt > 0) & (alt < 1000))


def current_positions(packets: DataFrame, kind: str = "aircraft_state") -> DataFrame:
    """Packets of one type; aircraft only with both coordinates non-zero."""
    out = packets.filter(F.col("data_type") == kind)
    if kind == "aircraft_state":
        out = out.filter((F.col("latitude_deg") != 0) & (F.col("longitude_deg") != 0))
    return out


def anomaly_positions(aircraft: DataFrame, sessions: DataFrame) -> DataFrame:
    """Low aircraft at their place and spacecraft with flags at the origin."""
    planes = low_aircraft(current_positions(aircraft)).select(
        F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"),
        F.lit("aircraft").alias("type"), F.col("spacecraft_id").alias("id"))
    craft = sessions.filter(F.col("anomaly_count") > 0).select(
        F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
        F.lit("spacecraft").alias("type"), F.col("spacecraft_id").alias("id"))
    return planes.unionByName(craft)
