"""Walking sorted Arrow batches group by group inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the groups' bounds. ``key`` is a column of 64-bit integers by which rows are sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        if held and keys[0] == held[-1].column(key)[-1].as_py() and keys[-1] == keys[0]:
            held.append(b)  # goes on with the same group
            continue
        last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        done = [*held, b.slice(0, last)] if last else held
        if last or (held and keys[0] != held[-1].column(key)[-1].as_py()):
            yield _bounded(pa.Table.from_batches(done), key)
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield _bounded(pa.Table.from_batches(held), key)


def _bounded(table: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    keys = table.column(key).to_numpy()
    return table, np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
