"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

REQUEST = "remote_ip STRING, host STRING, uri STRING, method STRING, headers STRUCT<`User-Agent`: ARRAY<STRING>>"
ACCESS_LOG_JSON = f"request STRUCT<{REQUEST}>, status INT, size BIGINT, duration DOUBLE, ts DOUBLE"
HTTP = "request_rate DOUBLE, error_rate_4xx DOUBLE, error_rate_5xx DOUBLE, path_diversity INT, avg_payload_bytes BIGINT, method_diversity INT"
EPOCH = "STRUCT<secs_since_epoch: BIGINT, nanos_since_epoch: BIGINT>"
OBSERVATION_JSON = f"source STRING, connection_rate DOUBLE, traffic_volume BIGINT, ports_accessed ARRAY<INT>, timestamp {EPOCH}, http STRUCT<{HTTP}>"
OBSERVATION = f"source STRING, connection_rate DOUBLE, traffic_volume BIGINT, ports_accessed ARRAY<INT>, ts TIMESTAMP, http STRUCT<{HTTP}>"
#: One nullable struct for each kind of threat: the sum type of the wire format.
THREAT_DETAIL = (
    "GeneticViolation STRUCT<peer_id: STRING, expected_lineage: STRING>, BehavioralAnomaly STRUCT<baseline_behavior: STRING, observed_behavior: STRING, deviation: DOUBLE>, "
    "IntrusionAttempt STRUCT<attack_pattern: STRING, indicators: ARRAY<STRING>>, DenialOfService STRUCT<current_load: DOUBLE, threshold: DOUBLE>, "
    "TopologyViolation STRUCT<expected_path: ARRAY<INT>, actual_path: ARRAY<INT>, bypassed_layers: ARRAY<INT>>, ProcessSpawnAnomaly STRUCT<rate: DOUBLE, threshold: DOUBLE>, "
    "HttpBehavioralAnomaly STRUCT<source_ip: STRING, dimension: STRING, observed: DOUBLE, mean: DOUBLE, std_dev: DOUBLE>, "
    "ConnectivityAnomaly STRUCT<failure_rate: DOUBLE, failures: INT, total: INT>, ConfigurationDrift STRUCT<field: STRING, expected: STRING, observed: STRING>"
)
THREAT_JSON = f"id STRING, threat_type STRUCT<{THREAT_DETAIL}>, severity STRING, source STRING, target STRING, detected_at {EPOCH}, description STRING, confidence DOUBLE"
QUARANTINE = "source STRING, started_at TIMESTAMP, reason STRING, threat_id STRING"
HOST_METRICS = "host STRING, ts TIMESTAMP, load1 DOUBLE, cpus INT, forks_total BIGINT"
PROBES = "channel STRING, ts TIMESTAMP, success BOOLEAN"
AUDIT = "seq BIGINT, ts TIMESTAMP, source STRING, severity STRING, severity_rank INT, kind STRING, subject STRING, detail STRING, correlation_id STRING"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
