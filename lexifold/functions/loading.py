"""Models that are loaded where they run, once for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

_loaded: dict[str, Any] = {}


class Loader:
    """A model that each Python worker makes for itself when it first calls it, and keeps for all later batches and tasks.

    make: what loads the model; it alone goes to the workers, not the model. name: models of one name are the same, so a new model
    needs a new name. Called, a loader passes all arguments on to its model.
    """

    def __init__(self, make: Callable[[], Callable], name: str) -> None:
        self.make, self.name = make, name

    def __call__(self, *args: Any) -> Any:
        if self.name not in _loaded:
            _loaded[self.name] = self.make()
        return _loaded[self.name](*args)


def batches_of(texts: list[str], rows: int, size: int) -> Iterator[list[str]]:
    """Texts in order, in batches of so many rows and characters at most; a longer text is a batch of its own."""
    batch, room = [], 0
    for t in texts:
        if batch and (len(batch) >= rows or room + len(t or "") > size):
            yield batch
            batch, room = [], 0
        batch.append(t)
        room += len(t or "")
    if batch:
        yield batch


def checked_vectors(vectors: Any, rows: int, dim: int | None) -> np.ndarray:
    """A float matrix with a row for each text, all of one length (dim, if it is known); anything else is an error that says what came."""
    found = np.asarray(vectors, np.float32)
    if found.ndim != 2 or len(found) != rows or (dim is not None and found.shape[1] != dim):
        raise ValueError(f"encoder gave {found.shape} for {rows} texts{'' if dim is None else f' of dimension {dim}'}")
    return found
