"""Every threshold of the engine, in one place. Pass a changed copy to re-tune; ``None`` is no limit."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # physical: upper bound of rows per (key, segment)
    segment_rows: int = 100_000
    fold_rows: int = 200_000

    # row assembly
    max_continuation_lines: int = 200
    max_line_chars: int | None = None
    backfill_bytes: int = 10 * 1024 * 1024

    # templates
    similarity: float = 0.5
    max_children: int = 100

    # trace linking
    idle_timeout_s: float = 300.0
    max_synthetic_events: int = 60

    # baselines
    min_samples: int = 10
    max_samples: int = 200
    spike_ratio: float = 3.0
    min_samples_per_half: int = 10
    drift_ratio: float = 1.5

    # detectors
    clock_jump_s: int = 60
    window_s: int = 60
    min_history_s: int = 300
    rate_spike_ratio: float = 8.0
    rate_clear_ratio: float = 2.0
    rate_min_events: int = 5
    rate_floor_per_min: float = 0.1
    drop_factor: float = 5.0
    drop_min_rate: float = 0.5
    drop_min_events: int = 10
    drop_min_active_min: float = 5.0
    drop_min_gap_s: float = 60.0
    novelty_warmup_events: int = 100
    silence_gaps: int = 200
    silence_min_gaps: int = 50
    silence_factor: float = 10.0
    silence_min_s: float = 120.0
    silence_record: float = 1.05
    latency_cooldown_s: float = 60.0
    cost_min_samples: int = 8
    cost_ratio: float = 2.5
    cost_cooldown_s: float = 120.0
    error_min_history: int = 100
    error_min_window: int = 8
    error_ratio: float = 4.0
    error_floor: float = 0.30
    error_clear_floor: float = 0.05
    error_clear_ratio: float = 1.5
    sustain_s: float = 20.0
    clear_sustain_s: float = 60.0

    # runs
    required_presence: float = 0.7
    min_trace_events: int = 4
    slow_factor: float = 1.5
    quiet_s: float = 20.0
    min_judged_events: int = 2
    judged_kept_s: float = 86_400.0
    rank_margin: float = 0.08

    # incidents
    hold_s: float = 45.0
    temporal_s: float = 90.0
    coincident_s: float = 1.0
    resolve_quiet_s: float = 300.0
    forget_s: float | None = None
    evidence_limit: int = 20

    # memory and verification
    min_similarity: float = 0.35
    archive_kept: int | None = None
    verify_min_samples: int = 8
    material_change: float = 0.15
    recur_min_before: int = 3


DEFAULT = Config()
