"""Adam on a dict of float32 arrays."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def __call__(self, slopes: dict[str, np.ndarray], scale: float = 1.0) -> None:
        """One step along the slopes; ``scale`` multiplies the rate. Slopes are clipped to a norm of 1."""
        self.step += 1
        norm = max(1.0, float(np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))))
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in slopes.items():
            g = g / norm
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.weights[k] -= (rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(np.float32)
