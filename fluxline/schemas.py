"""Fixed table layouts."""

from __future__ import annotations

from fluxline import constants as C

BASE_FIELDS = (
    "timestamp timestamp, packet_id string, spacecraft_id string, apid int, "
    "sequence_count int, source string, archive_dataset string, data_level string"
)


def _doubles(names) -> str:
    return ", ".join(f"{n} double" for n in names)


TABLES = {
    "mag": f"{BASE_FIELDS}, {_doubles(C.MAG_COLUMNS)}",
    "plasma": f"{BASE_FIELDS}, {_doubles(C.PLASMA_COLUMNS)}",
}

PACKETS = (
    "packet_id string, timestamp timestamp, spacecraft_id string, packet_type string, "
    "apid int, sequence_count int, raw_bytes binary, parameters map<string,string>, source string"
)

KP = "timestamp timestamp, kp double, ap int, g_scale tinyint, status string"

CATALOG = (
    "source_row int, disturbance_time timestamp, icme_start timestamp, icme_end timestamp, "
    "quality string, v_icme_km_s double, v_max_km_s double, b_nt double, mc_flag tinyint, "
    "dst_min_nt double, v_transit_km_s double, lasco_cme_time timestamp"
)

EDGES = "source string, target string, lag int, strength double, p_value double"

OPERATIONAL_EVENTS = (
    "event_id string, event_type string, timestamp timestamp, source string, "
    "details map<string,string>"
)
