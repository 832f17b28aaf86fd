"""Walking sorted rows run by run inside a task, and linking the members of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Those of :func:`every_run` that have two rows or more."""
    return every_run(batches, keys, 2)


def every_run(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Neighbouring rows with equal keys, for runs of at least ``least`` rows. The rows must come sorted by the keys; only the
    run at hand is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = np.asarray(batch.column(key))
            change[1:] |= values[1:] != values[:-1]
            if held and values[0] != np.asarray(held[-1].column(key))[-1]:
                change[0] = True
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        head = batch.slice(0, int(starts[0]))
        yield from _whole([*held, head] if head.num_rows else held, least)
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if end - start >= least:
                yield pa.Table.from_batches([batch.slice(start, end - start)])
        held = [batch.slice(int(starts[-1]))]
    yield from _whole(held, least)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of the batches, sorted by the key, cut between runs only: many runs together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.asarray(batch.column(key))
        if held and values[0] != np.asarray(held[-1].column(key))[-1]:
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(values[1:] != values[:-1])
        if not len(change):
            held.append(batch)
            continue
        last = int(change[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _whole(parts: list[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    if sum(p.num_rows for p in parts) >= least:
        yield pa.Table.from_batches(parts)


def stars(sizes: np.ndarray, ratio: float, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (centre, member) that connect all members of a run that links connect.

    ``linked(x, others)`` tells which others are linked with x; only members whose sizes lie within ``ratio`` of each
    other are asked about. Every member is compared with all that are not yet reached, so that no link between two
    components stays unseen, while members already reached are not compared again.
    """
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    left = np.ones(len(sizes), bool)  # not yet reached, by place in order
    found = []
    for first in range(len(order)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            low = np.searchsorted(ordered, ratio * ordered[x] - 1e-9)
            high = np.searchsorted(ordered, ordered[x] / ratio + 1e-9, side="right")
            others = low + np.flatnonzero(left[low:high])
            if len(others):
                hit = others[linked(order[x], order[others])]
                left[hit] = False
                queue.extend(hit.tolist())
                found += [(int(order[first]), int(order[y])) for y in hit]
    return found
