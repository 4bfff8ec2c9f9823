"""Readers and label parsers on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fluxline.functions import scalar
from fluxline.sources import archive, feeds, labels, registry


def write(path, text):
    path.write_text(text)
    return str(path)


PLASMA_LINES = """# a comment

2018-03-15T00:00:00.000000000Z,0,-391.0,8.25,-14.5,1,1,1,44.0,1,7.9,1,61250.0,1
2018-03-15T00:01:00.123456789Z,2,-392.5,8.25,-14.5,1,1,1,44.0,1,bad,1,,1,extra
2018-03-15T00:02:00Z,0,-391.0
not a time,0,-391.0,8.25,-14.5,1,1,1,44.0,1,7.9,1,61250.0,1
"""


def test_archive_plasma(spark, tmp_path):
    path = write(tmp_path / "p.csv", PLASMA_LINES)
    rows = archive.read_plasma(spark, path).orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [datetime(2018, 3, 15), datetime(2018, 3, 15, 0, 1, 0, 123456)]
    first, second = rows
    assert first.bulk_speed_km_s == pytest.approx((391**2 + 8.25**2 + 14.5**2) ** 0.5)
    assert (first.proton_density_n_cc, first.ion_temperature_k, first.apid) == (7.9, 61250.0, 100)
    assert (second.proton_density_n_cc, second.ion_temperature_k, second.data_quality_flag) == (0.0, 0.0, 2.0)
    assert archive.read_plasma(spark, path, bad="null").filter("proton_density_n_cc IS NULL").count() == 1
    bad = {r.reject_reason for r in archive.rejects(spark.read.text(path), "plasma").collect()}
    assert bad == {"short row", "bad time"}


def test_archive_mag_and_window(spark, tmp_path):
    mag = write(tmp_path / "m.csv", "".join(
        f"{t},3.3,0.1,-1.7,2.4,-1.5" + ",0.1" * 9 + "\n"
        for t in ("2016-07-26T23:59:59Z", "2016-07-27T00:00:00Z", "2019-07-01T00:00:00.5Z")))
    plasma = write(tmp_path / "p.csv", "".join(
        f"{t},0,-391.0,8.25,-14.5,1,1,1,44.0,1,7.9,1,61250.0,1\n"
        for t in ("2019-06-27T23:59:00Z", "2019-06-28T00:00:00Z")))
    both = archive.read_archive(spark, mag, plasma, "2016-01-01 00:00:00", "2020-01-01 00:00:00")
    got = sorted((r.instrument, str(r.timestamp)) for r in both.collect())
    assert got == [("mag", "2016-07-27 00:00:00"), ("mag", "2019-07-01 00:00:00.500000"),
                   ("plasma", "2019-06-27 23:59:00")]
    one = archive.read_mag(spark, mag).first()
    assert (one.bt_nt, one.bx_gse_nt, one.by_gse_nt, one.bz_gse_nt) == (3.3, -1.7, 2.4, -1.5)
    empty = write(tmp_path / "e.csv", "")
    assert archive.read_mag(spark, empty).count() == 0
    numbered = archive.with_sequence(archive.read_mag(spark, mag))
    assert [r.sequence_count for r in numbered.collect()] == [0, 0, 0]  # one row per day


def test_times_round_trip(spark):
    df = spark.createDataFrame(
        [("2018-03-15T00:00:00Z",), ("2018-03-15T01:02:03.5Z",), ("2018-03-15T01:02:03.999999999Z",)], "t string")
    at = scalar.archive_time(F.col("t"))
    rows = df.select(at.alias("at"), scalar.archive_time_text(at).alias("text"), scalar.iso_text(at).alias("iso")).collect()
    assert [r.text for r in rows] == ["2018-03-15T00:00:00.000000Z", "2018-03-15T01:02:03.500000Z", "2018-03-15T01:02:03.999999Z"]
    assert [r.iso for r in rows][:2] == ["2018-03-15T00:00:00+00:00", "2018-03-15T01:02:03.500000+00:00"]


def test_live_feeds(spark, tmp_path):
    plasma = write(tmp_path / "p.json", json.dumps([
        ["time_tag", "density", "speed", "temperature"],
        ["2024-01-15 12:00:00.000", "5.1", "450.0", "90000"],
        ["2024-01-15 12:01:00.000", None, "", "90000"],
        ["2024-01-15 13:00:00.000", "5.1", "450.0", "90000"],
        ["bad", "1", "2", "3"], ["2024-01-15 12:02:00.000", "1"]]))
    mag = write(tmp_path / "m.json", json.dumps([
        ["time_tag", "bx", "by", "bz", "bt"], ["2024-01-15 12:00:00.000", "1", "2", "-3", "4"]]))
    window = ("2024-01-15 12:00:00", "2024-01-15 12:30:00")
    rows = feeds.read_live(spark, plasma, mag, *window).collect()
    assert sorted((r.data_type, r.apid) for r in rows) == [("magnetic", 101), ("plasma", 100), ("plasma", 100)]
    assert sorted(r.proton_density_n_cc for r in rows if r.data_type == "plasma") == [0.0, 5.1]
    second = feeds.read_live(spark, plasma, mag, *window, second=True)
    assert {(r.spacecraft_id, r.apid) for r in second.collect()} == {("ACE", 0x70), ("ACE", 0x71)}
    assert "live_mag" in registry.sources()
    assert registry.read_source(spark, "live_mag", mag, *window).first().bz_gsm_nt == -3.0
    with pytest.raises(ValueError, match="unknown"):
        registry.read_source(spark, "nope", mag, *window)


def test_aircraft_and_satellites(spark, tmp_path):
    def state(icao, call, lon, lat, ground=False, alt=800.04):
        return [icao, call, "US", 1, 1705320000, lon, lat, alt, ground, 250.26, 90.04, -0.126, None, 900.06, "1200", False, 0]

    path = write(tmp_path / "a.json", json.dumps({"time": 1705320000, "states": [
        state("abc123", " UAL1 ", -100.12345, 40.98765), state("def456", "", -100, 41, True),
        state("aaa111", None, None, 41), state("fff000", "  ", -90, 80), state("bbb222", None, -90, 30, alt=None)]}))
    rows = {r.icao24: r for r in feeds.read_aircraft(spark, path, box=feeds.NORTH_AMERICA).collect()}
    assert set(rows) == {"abc123", "bbb222"}
    everywhere = {r.icao24 for r in feeds.read_aircraft(spark, path).collect()}
    assert everywhere == {"abc123", "bbb222", "fff000"}
    r = rows["abc123"]
    assert (r.spacecraft_id, r.callsign, r.latitude_deg, r.longitude_deg) == ("AIRCRAFT_ABC123", "UAL1", 40.9877, -100.1235)
    assert (r.baro_altitude_m, r.velocity_ms, r.vertical_rate_ms) == (800.0, 250.3, -0.13)
    assert rows["bbb222"].callsign == "bbb222" and rows["bbb222"].baro_altitude_m == 0.0
    assert feeds.read_aircraft(spark, path, limit=1).count() == 1
    assert feeds.low_aircraft(feeds.read_aircraft(spark, path, box=feeds.NORTH_AMERICA)).count() == 1

    sats = write(tmp_path / "s.json", json.dumps([
        {"OBJECT_NAME": "ISS (ZARYA)", "NORAD_CAT_ID": 25544, "PERIOD": "92.9", "APOGEE": None},
        {"OBJECT_NAME": "A VERY LONG SATELLITE NAME", "CCSDS_OMID": "X1"}, {}]))
    got = feeds.read_satellites(spark, sats, F.lit("2024-01-01").cast("timestamp")).orderBy("sequence_count").collect()
    assert [g.spacecraft_id for g in got] == [
        "SAT_ISS_(ZARYA)_25544", "SAT_A_VERY_LONG_SATELLITE_NAME_X1", "SAT_UNKNOWN_2"]
    assert [g.catalog_number for g in got] == ["25544", "X1", "2"]
    assert (got[0].period_min, got[0].apogee_km) == (92.9, 0.0)


def test_inputs_are_taken_whole(spark, tmp_path):
    states = [[f"p{i:03d}", "", "", 1, 1705320000 + i, 20.0, 10.0, 5000.0, False] for i in range(120)]
    planes = write(tmp_path / "a.json", json.dumps({"time": 1705320000, "states": states}))
    assert feeds.read_aircraft(spark, planes).count() == 120
    window = ("2024-01-15 12:00:10", "2024-01-15 12:00:19")
    assert registry.read_source(spark, "aircraft", planes, *window).count() == 10
    sats = write(tmp_path / "s.json", json.dumps([{"OBJECT_NAME": "ONE LONG COMMON NAME FOR ALL", "NORAD_CAT_ID": i} for i in range(45)]))
    got = registry.read_source(spark, "satellites", sats, *window)
    assert got.select("spacecraft_id").distinct().count() == 45


def test_index_documents_in_order_of_name(spark):
    at = ["2024-01-01T00:00:00Z", "2024-01-01T03:00:00Z"]
    docs = [("b.json", json.dumps({"Kp": [9.0], "datetime": at[:1]})), ("a.json", json.dumps({"Kp": [1.0, 2.0], "datetime": at}))]
    for rows in (docs, docs[::-1]):
        got = labels.parse_index(spark.createDataFrame(rows, "document string, value string"), "Kp").collect()
        assert sorted(float(r.value) for r in got) == [2.0, 9.0]


@pytest.mark.parametrize("kp,scale", [
    (0.0, 0), (3.667, 0), (4.333, 0), (4.5, 0), (4.667, 1), (5.0, 1), (5.333, 1), (5.5, 2), (5.667, 2), (6.0, 2),
    (7.0, 3), (8.0, 4), (8.333, 4), (8.667, 5), (9.0, 5), (10.0, 5)])
def test_storm_scale(spark, kp, scale):
    assert spark.range(1).select(scalar.storm_scale(F.lit(kp)).alias("g")).first().g == scale


def docs(spark, payload):
    return spark.createDataFrame([(json.dumps(payload),)], "value string")


def test_index_documents(spark):
    times = ["2017-09-08T00:00:00Z", "2017-09-08T03:00:00Z", "2017-09-08T06:00:00Z", "2017-09-08T09:00:00Z"]
    kp = labels.parse_index(docs(spark, {"Kp": [2.0, 4.667, 8.0, -1], "datetime": times}), "Kp")
    ap = labels.parse_index(docs(spark, {"ap": [7, 39, -1], "datetime": times[:3]}), "ap")
    st = labels.parse_index(docs(spark, {"status": ["def"], "datetime": times[:1]}), "status")
    rows = labels.join_indices(kp, ap, st).orderBy("timestamp").collect()
    assert [(r.kp, r.ap, r.g_scale, r.status) for r in rows] == [
        (2.0, 7, 0, "def"), (4.667, 39, 1, ""), (8.0, -1, 4, "")]
    assert labels.join_indices(kp, ap).filter("status = ''").count() == 3
    twice = labels.parse_index(docs(spark, {"Kp": [1, 5], "datetime": [times[0]] * 2}), "Kp")
    assert [r.value for r in twice.collect()] == ["5"]
    hist = {r.scale: r.intervals for r in labels.storm_histogram(labels.join_indices(kp, ap)).collect()}
    assert hist == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    peak = labels.index_peak(labels.join_indices(kp, ap)).first()
    assert (peak.kp_max, peak.kp_max_at) == (8.0, datetime(2017, 9, 8, 6))
    for bad in ({"datetime": times}, {"Kp": [1.0]}, {"Kp": [1.0], "datetime": times}):
        with pytest.raises(Exception, match="array|length"):
            labels.parse_index(docs(spark, bad), "Kp").collect()


def cells(start="2017/09/07 1200", end="2017/09/08 600", **change):
    row = ["2017/09/06 2343 (A)", start, end] + ["..."] * 6 + [" 1 ", "110", "570", "817 S", "27.4", "2H", "-142", "...",
           "dg (1997/11/19 1700)"]
    for k, v in change.items():
        row[int(k[1:])] = v
    return row


def test_catalog(spark):
    table = [
        ["Disturbance Y/M/D (UT)"] + ["x"] * 17, cells(), cells(start="..."), cells(end="1996/13/45 9999"),
        cells()[:12], cells(start="1996/12/19 1630 H", end="1996/12/20 5") + ["nan"], ["a", "b"],
        cells(c15="....", c14="nan", c9="")]
    df = spark.createDataFrame(list(enumerate(table)), "row int, cells array<string>")
    rows = labels.parse_catalog(df).orderBy("source_row").collect()
    assert [r.source_row for r in rows] == [1, 2, 3]
    a, b, c = rows
    assert (a.icme_start, a.icme_end) == (datetime(2017, 9, 7, 12), datetime(2017, 9, 8, 6))
    assert (a.quality, a.v_icme_km_s, a.v_max_km_s, a.b_nt, a.mc_flag, a.dst_min_nt) == ("1", 570.0, 817.0, 27.4, 2, -142.0)
    assert a.v_transit_km_s is None and a.lasco_cme_time == datetime(1997, 11, 19, 17)
    assert (b.icme_start, b.icme_end) == (datetime(1996, 12, 19, 16, 30), datetime(1996, 12, 20, 0, 5))
    assert c.dst_min_nt is None and c.mc_flag is None and c.quality == ""
    s = labels.catalog_summary(labels.parse_catalog(df)).first()
    assert (s.intervals, s.clouds, s.dst_min) == (3, 2, -142.0)
