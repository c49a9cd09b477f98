"""Independent table writes side by side, as jobs of one Spark session."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

#: Writes that run at a time: most tables are small and leave most of the cores idle.
SIDE_BY_SIDE = 4


def each(items: Iterable, write: Callable) -> None:
    """``write`` for every item; the first error is raised after the writes that had begun."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        for done in [pool.submit(write, item) for item in items]:
            done.result()
