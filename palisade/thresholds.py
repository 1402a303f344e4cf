"""Tunable limits of the detectors, passed to operators as plain literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values: the defaults below
    sigma: float = 2.5
    high_deviation: float = 5.0
    medium_deviation: float = 3.0
    load: float = 0.9
    load_confidence: float = 0.8
    lineage_confidence: float = 0.95
    degraded_lineage_confidence: float = 0.5
    sensitive_ports: tuple[int, ...] = (22, 23, 3389, 445, 135)
    port_scan_confidence: float = 0.75
    exfil_volume: int = 100_000
    exfil_ratio: float = 10_000.0
    exfil_confidence: float = 0.6
    topology_confidence: float = 0.9
    drift_confidence: float = 0.85
    quarantine_critical_confidence: float = 0.9
    quarantine_high_confidence: float = 0.7
    spawn_rate: float = 50.0
    spawn_confidence: float = 0.85
    failure_rate: float = 0.5
    failure_critical: float = 0.8
    failure_min_probes: int = 3
    failure_confidence: float = 0.8
    failure_window: int = 20
    window: int = 100
    min_observations: int = 10
    audit_capacity: int = 1024
    expected_path: tuple[int, ...] = (0, 1, 2, 3)


DEFAULTS = Thresholds()
