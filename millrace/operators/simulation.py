"""A seeded run source for exercising the controller.

Throughput follows the universal scalability law: each worker adds ``rate``
rows a second, contention (``serial``) and coherence costs (set so that the curve
peaks at ``peak_workers``) take away from it. Runs vary by log-normal noise of the given
spread; a run's time is dealt to its chunks by gamma-distributed shares, whose
shape is the smaller the more uneven chunks are to be.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Workload:
    rows: int = 8_000_000
    rate: float = 90_000.0
    peak_workers: int = 4
    serial: float = 0.05
    spread: float = 0.05
    evenness: float = 50.0
    seed: int = 1

    def mean_throughput(self, workers: int) -> float:
        coherence = (1 - self.serial) / self.peak_workers**2
        return self.rate * workers / (1 + self.serial * (workers - 1) + coherence * workers * (workers - 1))

    def run(self, number: int, workers: int, chunks: int = 10) -> dict:
        """Run number of that many workers; the same number gives the same run, whatever ran before."""
        rng = random.Random(f"{self.seed}/{number}")
        throughput = self.mean_throughput(workers) * rng.lognormvariate(0.0, self.spread)
        seconds = self.rows / throughput
        shares = [rng.gammavariate(self.evenness, 1.0) for _ in range(chunks)]
        whole = sum(shares)
        return {"run": number, "workers": workers, "rows": self.rows, "throughput": throughput, "seconds": seconds, "durations": [seconds * workers * s / whole for s in shares]}

    def history(self, workers: list[int]) -> Iterator[dict]:
        """One run after another under the given worker counts."""
        return (self.run(i, w) for i, w in enumerate(workers))
