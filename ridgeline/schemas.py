"""Explicit schemas of the inputs."""

RAW_TERRAIN = ("longitude DOUBLE, latitude DOUBLE, elevation STRING, slope_deg STRING, "
               "tree_density STRING, tree_height STRING")
LABELLED_TERRAIN = ("latitude DOUBLE, longitude DOUBLE, elevation DOUBLE, slope_deg INT, "
                    "tree_density INT, tree_height INT, land_type INT")
INCIDENT = "latitude DOUBLE, longitude DOUBLE"
HAZARD = "park STRING, hazard_id STRING, name STRING, kind STRING, position STRING"
EVENT = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
         "value DOUBLE, props STRING")
