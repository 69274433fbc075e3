"""Tunables with defaults and range checks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Read by the operators; a stream takes a fresh copy per micro-batch via ``updated``."""

    threat_threshold: float = 75.0       # alert cut, changeable at run time
    band_threshold: float = 75.0         # risk bands, fixed at start
    anomaly_threshold: float = 0.6       # optional filter only
    use_boosting: bool = False
    sequence_window: int = 10
    packet_sample_size: int = 15
    flow_timeout_s: int = 60
    flow_window_s: int = 60
    min_flow_packets: int = 2
    mac_flood_window_s: int = 10
    mac_flood_new_macs: int = 40
    cdp_flood_window_s: int = 10
    cdp_flood_count: int = 20
    stp_tc_window_s: int = 10
    stp_tc_count: int = 5
    dtp_cooldown_s: int = 30
    vtp_revision_jump: int = 50
    # time slot by which hot keys are split; must divide the flow window and not exceed the timeout
    slot_s: int = 10
    # sum packets of equal time before ordering them: one more shuffle, but no burst or group of
    # copies can overfill a slot; turn off for traces whose busiest 5-tuple is known to fit
    combine_ties: bool = True
    # time slot of the Layer-2 ordered scans; at least the widest rolling window
    l2_slot_s: int = 60

    def __post_init__(self) -> None:
        if not 0 <= self.threat_threshold <= 100:
            raise ValueError("threat_threshold must lie in 0..100")
        if not 0 <= self.anomaly_threshold <= 1:
            raise ValueError("anomaly_threshold must lie in 0..1")
        if self.flow_window_s % self.slot_s or self.slot_s > self.flow_timeout_s:
            raise ValueError("slot_s must divide flow_window_s and not exceed flow_timeout_s")
        if self.l2_slot_s < max(self.cdp_flood_window_s, self.stp_tc_window_s):
            raise ValueError("l2_slot_s must cover the rolling windows")
        counts = ("sequence_window", "packet_sample_size", "mac_flood_new_macs",
                  "cdp_flood_count", "stp_tc_count", "min_flow_packets")
        for name in counts:
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def updated(self, **changes: Any) -> "Settings":
        """Copy with the given non-null values; unknown names are rejected."""
        known = {f.name for f in fields(self)}
        unknown = set(changes) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


DEFAULTS = Settings()
