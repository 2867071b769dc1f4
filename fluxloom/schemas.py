"""The eight stored tables, their keys, and the landed feeds' raw schemas."""

from __future__ import annotations

XRAY_FLUX = """timestamp TIMESTAMP_NTZ NOT NULL, flux_short DOUBLE, flux_long DOUBLE, satellite STRING,
    data_quality STRING, ingested_at TIMESTAMP_NTZ"""
SOLAR_REGIONS = """timestamp TIMESTAMP_NTZ NOT NULL, region_number INT NOT NULL, latitude DOUBLE, longitude DOUBLE,
    mcintosh_class STRING, mount_wilson_class STRING, area INT, num_sunspots INT, magnetic_type STRING,
    ingested_at TIMESTAMP_NTZ"""
FLARE_EVENTS = """start_time TIMESTAMP_NTZ NOT NULL, peak_time TIMESTAMP_NTZ NOT NULL, end_time TIMESTAMP_NTZ,
    flare_class STRING NOT NULL, class_category STRING NOT NULL, class_magnitude DOUBLE NOT NULL, active_region INT,
    location STRING, source STRING, verified BOOLEAN, ingested_at TIMESTAMP_NTZ"""
MAGNETOGRAM = """timestamp TIMESTAMP_NTZ NOT NULL, region_number INT NOT NULL, magnetic_field_strength DOUBLE,
    magnetic_field_polarity STRING, magnetic_complexity STRING, latitude DOUBLE, longitude DOUBLE,
    solar_radius DOUBLE, source STRING, data_quality STRING, ingested_at TIMESTAMP_NTZ"""
INGESTION_LOG = """run_timestamp TIMESTAMP_NTZ, source_name STRING NOT NULL, status STRING NOT NULL, records_fetched INT,
    records_inserted INT, records_updated INT, data_start_time TIMESTAMP_NTZ, data_end_time TIMESTAMP_NTZ,
    error_message STRING, duration_seconds DOUBLE"""
PREDICTION_LOG = """prediction_timestamp TIMESTAMP_NTZ NOT NULL, observation_timestamp TIMESTAMP_NTZ NOT NULL,
    prediction_type STRING NOT NULL, region_number INT, model_type STRING, window_hours INT, predicted_class STRING,
    class_probabilities STRING, probability_distribution STRING, hazard_score DOUBLE, actual_flare_class STRING,
    actual_flare_time TIMESTAMP_NTZ, outcome_recorded_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"""
VALIDATION_LOG = """run_timestamp TIMESTAMP_NTZ, validation_type STRING NOT NULL, status STRING NOT NULL,
    guardrail_triggered BOOLEAN NOT NULL, guardrail_reason STRING, details STRING, initiated_by STRING"""
EVENT_CATALOG = """external_id STRING NOT NULL, source STRING NOT NULL, begin_time TIMESTAMP_NTZ,
    peak_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, class_type STRING, source_location STRING, active_region_num INT,
    instruments STRING, linked_events STRING, raw_payload STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""

TABLES = {
    "xray_flux": XRAY_FLUX,
    "solar_regions": SOLAR_REGIONS,
    "flare_events": FLARE_EVENTS,
    "magnetogram": MAGNETOGRAM,
    "ingestion_log": INGESTION_LOG,
    "prediction_log": PREDICTION_LOG,
    "validation_log": VALIDATION_LOG,
    "solar_flare_events": EVENT_CATALOG,
}
KEYS = {
    "xray_flux": ["timestamp"],
    "solar_regions": ["region_number", "timestamp"],
    "magnetogram": ["region_number", "timestamp"],
    "solar_flare_events": ["external_id", "source"],
}

# Landed feeds: scalars arrive as text or number, so they are read as text and cast with care.
XRAY_FEED = "time_tag STRING, energy STRING, flux STRING, satellite STRING, A_FLUX STRING, B_FLUX STRING"
REGION_FEED = """region STRING, latitude STRING, longitude STRING, location STRING, area STRING, spot_class STRING,
    mag_class STRING, number_spots STRING, observed_date STRING"""
CATALOG_FEED = """flrID STRING, id STRING, activityID STRING, beginTime STRING, peakTime STRING, endTime STRING,
    classType STRING, sourceLocation STRING, activeRegionNum STRING, instruments ARRAY<STRUCT<displayName: STRING>>,
    linkedEvents ARRAY<STRUCT<activityID: STRING>>"""
