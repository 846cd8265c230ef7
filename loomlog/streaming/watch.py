"""A watcher of the working file: a snapshot whenever its text changes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from loomlog.sources.migrations import CURRENT, meaningful, sha256

INTERVAL = 0.25


@dataclass(frozen=True)
class Snapshot:
    number: int
    text: str
    sha256: str
    meaningful: bool


def watch(root: str | Path, interval: float = INTERVAL, max_snapshots: int | None = None, timeout: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[Snapshot]:
    """Yields the working file as it is, then again after each change, until so many snapshots or seconds; a missing file is empty."""
    path, last, number, began = Path(root) / CURRENT, None, 0, clock()
    while max_snapshots is None or number < max_snapshots:
        text = path.read_text(encoding="utf-8") if path.exists() else ""
        if text != last:
            last, number = text, number + 1
            yield Snapshot(number, text, sha256(text), meaningful(text))
            continue
        if timeout is not None and clock() - began >= timeout:
            return
        sleep(interval)
