"""All tunables, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Defect:
    """A fault: a measurement beyond a limit, its penalty and its wording."""

    column: str
    above: bool
    limit: float
    penalty: float
    text: str


@dataclass(frozen=True)
class Config:
    w_aesthetic: float = 0.60
    w_technical: float = 0.25
    w_subject: float = 0.15
    aesthetic_range: tuple[float, float] = (4.0, 7.5)
    nima_range: tuple[float, float] = (3.8, 6.2)
    bands: tuple[tuple[float, str], ...] = ((78.0, "TOP PICK"), (66.0, "STRONG"), (54.0, "MAYBE"), (0.0, "PASS"))
    defects: tuple[Defect, ...] = (
        Defect("sharpness", False, 60.0, 18.0, "out of focus"),
        Defect("clip_hi", True, 0.12, 6.0, "bright areas clipped"),
        Defect("clip_lo", True, 0.35, 4.0, "dark areas clipped"),
    )
    hamming: int = 5
    secondary_discount: float = 0.80
    frame_penalty: float = 6.0
    sample_every: float = 3.0
    sample_cap: int = 400
    extract_min: float = 66.0
    extract_per_clip: int = 12
    min_edge: int = 500
    band_quantiles: tuple[float, ...] = (0.95, 0.80, 0.50)
    range_quantiles: tuple[float, float] = (0.02, 0.99)
    min_span: float = 0.25
    min_keepers: int = 30
    keeper_growth: float = 0.10
    tag_length: int = 40
    heart_limit: int = 60
    heart_window: int = 3600
    hide_folder: str = "_hidden"
    skip_folders: tuple[str, ...] = ("thumbs", "previews", "_extracted", ".trash")
    keeper_count: int = 0

    @property
    def shortlist(self) -> tuple[str, ...]:
        """The two best verdicts."""
        return tuple(label for _, label in self.bands[:2])

    def with_values(self, values: dict[str, Any]) -> Config:
        """Known names only; the rest is ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known})
