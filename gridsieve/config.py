"""Argument checks and patch geometry."""

from __future__ import annotations

from dataclasses import dataclass

# Channel order of a patch and the columns of the score matrices.
CHANNELS = ("dtm", "slope", "roughness", "ndvi", "ndwi", "flow_acc", "flow_dir")
UNIFIED_COLUMNS = (
    "prob_autoencoder",
    "prob_iforest",
    "prob_kmeans",
    "arch_similarity",
    "gate_prediction",
)
MATRIX_COLUMNS = ("prob_autoencoder", "prob_iforest", "prob_template", "sim_score")


@dataclass(frozen=True)
class PatchGrid:
    """Square patches of ``patch`` pixels whose corners lie ``stride`` apart."""

    patch: int = 64
    stride: int = 32

    def __post_init__(self):
        if self.patch < 1 or self.stride < 1 or self.stride > self.patch:
            raise ValueError("need 1 <= stride <= patch")

    @property
    def aligned(self) -> bool:
        """True when a patch is a whole number of stride-sized blocks."""
        return self.patch % self.stride == 0

    @property
    def pixels(self) -> int:
        return self.patch * self.patch


@dataclass(frozen=True)
class PreprocessingConfig:
    """Request-level settings, range-checked on construction."""

    patch_size: int = 64
    stride: int = 32
    target_patches: int = 50
    min_valid_ratio: float = 0.7
    clip_percentile: tuple = (0.5, 99.5)

    def __post_init__(self):
        size = self.patch_size
        if not 32 <= size <= 512 or size & (size - 1):
            raise ValueError("patch_size must be a power of two in 32..512")
        if not 8 <= self.stride <= 256 or self.stride > size:
            raise ValueError("stride must lie in 8..256 and not exceed patch_size")
        if self.target_patches < 1:
            raise ValueError("target_patches must be positive")
        if not 0.0 <= self.min_valid_ratio <= 1.0:
            raise ValueError("min_valid_ratio must lie in [0, 1]")
        low, high = self.clip_percentile
        if not 0 <= low < high <= 100:
            raise ValueError("clip_percentile needs 0 <= low < high <= 100")

    @property
    def grid(self) -> PatchGrid:
        return PatchGrid(self.patch_size, self.stride)


@dataclass(frozen=True)
class ScoringRequest:
    """Threshold, batch size and report length of one scoring run."""

    threshold: float = 0.5
    batch_size: int = 32
    top_n: int = 20

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must lie in [0, 1]")
        if not 1 <= self.batch_size <= 512:
            raise ValueError("batch_size must lie in 1..512")
        if not 1 <= self.top_n <= 20:
            raise ValueError("top_n must lie in 1..20")
