"""Running things on the driver: values that expire, bounded concurrency, progress of streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Any

from pyspark.sql.streaming import StreamingQueryListener


class Expiring:
    """A value made when it is asked for, and again once it is older than so many seconds."""

    def __init__(self, make: Callable[[], Any], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self._at: float | None = None
        self._value: Any = None

    def __call__(self) -> Any:
        if self._at is None or self.clock() - self._at > self.seconds:
            self._value, self._at = self.make(), self.clock()
        return self._value

    def forget(self) -> None:
        self._at = None


def run_bounded(jobs: Iterable[Callable[[], Any]], parallel: int) -> Iterator[tuple[Any, Exception | None]]:
    """(result, error) of each job in order: so many run at once, and twice so many are taken up together."""
    left = iter(jobs)

    def one(job: Callable[[], Any]) -> tuple[Any, Exception | None]:
        try:
            return job(), None
        except Exception as e:
            return None, e

    with ThreadPoolExecutor(parallel) as pool:
        while group := list(islice(left, parallel * 2)):
            yield from pool.map(one, group)


class Progress(StreamingQueryListener):
    """Tells a callback (rows so far, rows of the last batch) as a stream runs."""

    def __init__(self, told: Callable[[int, int], None]):
        self.told, self.total = told, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += event.progress.numInputRows
        self.told(self.total, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
