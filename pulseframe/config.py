"""Settings of waveform analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SpikeConfig:
    """Lengths in milliseconds unless said otherwise; two-sided lengths are (before, after)."""

    window_ms: tuple[float, float] = (10.0, 10.0)
    threshold: float = -10.0
    refractory_ms: float = 1.0
    pre_peak_ms: tuple[float, float] = (-4.0, -1.0)
    pre_inflection_ms: float = 1.0
    smooth_frac: float = 0.008
    poly_order: int = 1
    #: The decay fit starts 1 ms / exp_shift_divisor after the peak and lasts exp_duration_ms.
    exp_shift_divisor: float = 2.0
    exp_duration_ms: float = 5.0
    #: Windows whose mean correlation with the others is lower are dropped; None keeps all.
    corr_threshold: float | None = None
    flip: bool = False

    def samples(self, fs: float) -> tuple[int, int]:
        """Samples before and after the peak in a window."""
        return int(self.window_ms[0] * fs / 1000), int(self.window_ms[1] * fs / 1000)

    def distance(self, fs: float) -> int:
        return max(1, int(self.refractory_ms * fs / 1000))
