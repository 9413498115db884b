"""Calls of remote models from Arrow batches: bounded batches, paced starts, retries that wait longer each time."""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd

#: Seconds between the starts of two calls of one worker.
INTERVAL = 4.0


class Pacer:
    """Keeps the starts of a worker's calls at least ``interval`` seconds apart."""

    def __init__(self, interval: float = INTERVAL, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.free_at = interval, clock, sleep, float("-inf")

    def wait(self) -> None:
        while (left := self.free_at - self.clock()) > 0:
            self.sleep(left)
        self.free_at = self.clock() + self.interval


class Retryable(Exception):
    """A call that may be repeated; ``after`` is the server's Retry-After value, if it gave one."""

    def __init__(self, message: str = "", after: str | None = None):
        super().__init__(message)
        self.after = after


def pause(attempt: int, after: str | None = None, base: float = 1.0, most: float = 60.0, draw: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: what the server asks for, else doubled each time with up to a quarter more at random."""
    try:
        return max(0.0, float(after))
    except (TypeError, ValueError):
        return min(most, base * 2**attempt) * (1 + draw() / 4)


def batches(values: pd.Series, size: int) -> Iterator[pd.Series]:
    """Consecutive slices of at most ``size`` values."""
    if size < 1:
        raise ValueError("a batch holds one value at least")
    return (values.iloc[k : k + size] for k in range(0, len(values), size))


def polite(model: Callable[[pd.Series], pd.Series], size: int = 32, attempts: int = 5, pacer: Pacer | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[pd.Series], pd.Series]:
    """The model over batches of bounded size, each start paced and each ``Retryable`` failure tried again.

    The wrapped function goes where a model goes (a corrector, an embedder). Each task has its own pacer, so the rate of
    a job is the number of tasks that run at once over the interval.
    """
    pace = pacer or Pacer()

    def call(batch: pd.Series) -> list:
        for attempt in range(attempts):
            pace.wait()
            try:
                done = list(model(batch))
            except Retryable as error:
                if attempt + 1 == attempts:
                    raise
                sleep(pause(attempt, error.after))
            else:
                if len(done) != len(batch):
                    raise ValueError(f"the model gave {len(done)} results for {len(batch)} inputs")
                return done
        raise ValueError("one attempt at least")

    return lambda values: pd.Series([r for b in batches(values, size) for r in call(b)], index=values.index, dtype=object)


def secret(name: str, dotenv: str | None = ".env") -> str | None:
    """A secret by name: the process's environment first, then a file of NAME=value lines. Never put into Spark's settings, which are logged."""
    if os.environ.get(name):
        return os.environ[name]
    if dotenv is None or not Path(dotenv).is_file():
        return None
    pairs = (line.removeprefix("export ").partition("=") for line in map(str.strip, Path(dotenv).read_text(encoding="utf-8").splitlines()) if line and not line.startswith("#"))
    return {key.strip(): value.strip().strip("\"'") for key, _, value in pairs}.get(name) or None
