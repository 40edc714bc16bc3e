"""Thresholds of the two callers. Values that must match the published defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np


def f32(x: float) -> float:
    """A 32-bit threshold as the double it is compared with."""
    return float(np.float32(x))


@dataclass(frozen=True)
class SomaticConfig:
    # fixed values: default thresholds; those kept in 32 bits pass through f32
    initial_tumor_lod: float = f32(4.0)
    tumor_lod: float = f32(6.3)
    fraction_contamination: float = f32(0.02)
    minimum_mutation_cell_fraction: float = f32(0.0)
    normal_lod: float = f32(2.2)
    normal_artifact_lod: float = f32(1.0)
    normal_dbsnp_lod: float = f32(5.5)
    strand_artifact_lod: float = f32(2.0)
    strand_artifact_power: float = f32(0.9)
    minimum_normal_allele_fraction: float = f32(0.0)
    tumor_f_pretest: float = f32(0.005)
    min_qscore: int = 5
    min_qsum_qscore: int = 13
    gap_events_threshold: int = 3
    gap_event_proximity: int = 5
    heavily_clipped_read_fraction: float = f32(0.30)
    max_read_mismatch_quality_sum: int = 100
    reference_half_window: int = 150
    fraction_mapq0_threshold: float = f32(0.5)
    pir_median_threshold: float = 10.0
    pir_mad_threshold: float = 3.0
    required_max_alt_mapq: int = 20
    max_alt_in_normal_count: int = 2
    max_alt_in_normal_qsum: int = 20
    max_alt_in_normal_fraction: float = 0.03
    power_qscore: int = 30
    power_af: float = 0.3
    tumor_covered_depth: int = 14
    normal_covered_depth: int = 18
    normal_covered_depth_dbsnp: int = 19
    has_normal: bool = True
    force_output: bool = False
    force_alleles: bool = False
    only_passing_calls: bool = False
    artifact_detection_mode: bool = False
    interval_padding: int = 0
    downsample_to: int | None = None

    @property
    def eps(self) -> float:
        """Base error of the power model: the score is divided as an integer."""
        return 10.0 ** -(self.power_qscore // 10)

    def effective(self) -> SomaticConfig:
        """Without a normal its thresholds never reject; forced output accepts any first score."""
        out = self
        if not self.has_normal:
            out = replace(out, normal_lod=-float(np.finfo(np.float32).max), normal_dbsnp_lod=-float(np.finfo(np.float32).max), normal_covered_depth=0, normal_covered_depth_dbsnp=0)
        if self.force_output:
            out = replace(out, initial_tumor_lod=-float(np.finfo(np.float32).max))
        return out


@dataclass(frozen=True)
class GermlineConfig:
    # fixed values: default thresholds
    min_mapq: int = 0
    min_baseq: int = 13
    cap_mapq: int = 60
    max_depth: int = 250
    max_depth_total: int = 8000
    max_indel_depth: int = 250
    min_indel_support: int = 1
    min_indel_fraction: float = 0.002
    exclude_flags: int = 0x4 | 0x100 | 0x200 | 0x400
    require_flags: int = 0
    keep_orphans: bool = False
    illumina13: bool = False
    open_q: int = 40
    ext_q: int = 20
    tandem_q: int = 100
    theta: float = 1.1e-3
    call: bool = True
    variants_only: bool = True
    pval_threshold: float = 0.5


def from_options(cls, argv: list[str]):
    """A config from ``--name value`` / ``--name=value`` / bare ``--flag`` options; unknown names are errors."""
    known = {f.name: f for f in fields(cls)}
    out, rest = {}, list(argv)
    while rest:
        head = rest.pop(0)
        if not head.startswith("--"):
            raise ValueError(f"not an option: {head}")
        name, eq, value = head[2:].partition("=")
        name = name.replace("-", "_")
        if name not in known:
            raise ValueError(f"unknown option: --{name}")
        kind = type(known[name].default)
        if kind is bool:
            out[name] = value.lower() in ("1", "true", "yes") if eq else True
        else:
            if not eq:
                if not rest:
                    raise ValueError(f"--{name} needs a value")
                value = rest.pop(0)
            out[name] = (int if kind in (int, type(None)) else kind)(value)
    return cls(**out)
