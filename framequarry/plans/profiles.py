"""Behaviour profiles: the same plan with different strides, thresholds, scores and outputs."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    name: str
    #: (upper bound of the duration, stride in seconds), ascending; the last bound is None.
    strides: tuple[tuple[float | None, float], ...]
    threshold: float = 0.6
    inclusive: bool = False
    composite_score: bool = False
    detector_size: int = 640
    pad_frames: bool = False
    representative_frames: bool = True
    transcript: bool = True
    transcript_errors_fail: bool = False
    archive: bool = True
    reject_empty_video: bool = False
    two_pass_from: float | None = None
    key_prefix: str = "dated"
    round_scores: bool = True
    inference_fps: bool = False
    price_per_second: float = 0.000416

    def with_(self, **changes) -> "Profile":
        return replace(self, **changes)


CANONICAL = Profile("canonical", ((600, 1.0), (None, 2.0)))
ORGANIZED = Profile("organized", ((600, 1.0), (1800, 2.0), (None, 5.0)), inclusive=True, composite_score=True, detector_size=320, pad_frames=True, archive=False, key_prefix="account")
JOB = Profile("job", ((30, 0.5), (None, 1.0)), pad_frames=True, transcript_errors_fail=True, reject_empty_video=True, inference_fps=True)
LEGACY = Profile("legacy", ((None, 1.0),), inclusive=True, composite_score=True, representative_frames=False, transcript=False, archive=False, two_pass_from=300, key_prefix="account", round_scores=False)

PROFILES = {p.name: p for p in (CANONICAL, ORGANIZED, JOB, LEGACY)}
