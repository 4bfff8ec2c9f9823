"""Formats, bounds, thresholds and code numbers of the domain."""

from __future__ import annotations

# Fixed values -- archive files.
FILL_VALUE = -1.0e31
OPERATIONAL_START = "2016-07-27 00:00:00"
PLASMA_END = "2019-06-28 00:00:00"  # exclusive
MAG_DATASET = "DSCOVR_H0_MAG"
PLASMA_DATASET = "DSCOVR_H1_FC"

# Fixed values -- packet envelope limits and stream numbers.
APID_MAX = 2047
SEQUENCE_MAX = 16383
SEQUENCE_MODULO = 16384
APID_PLASMA = 0x64
APID_MAG = 0x65
APID_PLASMA_SECOND = 0x70
APID_MAG_SECOND = 0x71

# Fixed values -- instrument columns.
MAG_COLUMNS = ("bx_gse_nt", "by_gse_nt", "bz_gse_nt", "bt_nt")
PLASMA_COLUMNS = (
    "proton_density_n_cc",
    "bulk_speed_km_s",
    "ion_temperature_k",
    "vx_gse_km_s",
    "vy_gse_km_s",
    "vz_gse_km_s",
    "thermal_speed_km_s",
    "data_quality_flag",
)

# Fixed values -- inclusive bounds of the write gate.
GATE_BOUNDS = {
    "bt_nt": (0.0, 500.0),
    "bx_gse_nt": (-500.0, 500.0),
    "by_gse_nt": (-500.0, 500.0),
    "bz_gse_nt": (-500.0, 500.0),
    "proton_density_n_cc": (0.0, 200.0),
    "bulk_speed_km_s": (150.0, 1500.0),
    "ion_temperature_k": (0.0, 1.0e8),
}

# Fixed values -- inclusive bounds of the read-side check (not those of the gate).
CHECK_BOUNDS = {
    "bt_nt": (0.0, 200.0, "nT"),
    "bx_gse_nt": (-200.0, 200.0, "nT"),
    "by_gse_nt": (-200.0, 200.0, "nT"),
    "bz_gse_nt": (-200.0, 200.0, "nT"),
    "proton_density_n_cc": (0.0, 500.0, "cm^-3"),
    "bulk_speed_km_s": (150.0, 1500.0, "km/s"),
    "ion_temperature_k": (0.0, 1.0e8, "K"),
}

# Fixed values -- nominal cadence and magnitude tolerance of the checks.
ROWS_PER_DAY = {"mag": 86_400, "plasma": 1_440}
CADENCE_SECONDS = {"mag": 1, "plasma": 60}
FIELD_ABS_TOL = 0.5
FIELD_REL_TOL = 0.02
FIELD_FAIL_FRACTION = 0.01

# Fixed values -- labels.
INDEX_MISSING = -1

# Fixed values -- detection and audit limits.
CONFIDENCE_FLOOR = 0.75
CONFIDENCE_CAP = 0.99
EXPLANATION_CAP = 0.95

# Fixed values -- source staleness in seconds and trust (3 best, 1 stale).
STALE_AFTER = {
    "noaa_dscovr": 7200,
    "ace_spacecraft": 7200,
    "opensky_network": 600,
    "celestrak_iss": 86400,
    "authoritative": 300,
}
STALE_AFTER_DEFAULT = 3600
TRUST = {
    "noaa_dscovr": 2,
    "ace_spacecraft": 2,
    "opensky_network": 2,
    "celestrak_iss": 2,
    "authoritative": 3,
}
TRUST_DEFAULT = 2
TRUST_STALE = 1
