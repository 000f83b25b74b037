"""Sliding windows of tokens: how many hold a term, and how many two of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import ship

ship(__name__)

#: Windows that are looked at together.
BLOCK = 1 << 16


def counted(terms: list[str], window: int):
    """A function of Arrow batches with ``tokens``: rows ``a, b, n`` of windows that hold both terms (by number); a = b = -1 counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, k = pa.array(terms, pa.string()), len(terms)
        both, total = np.zeros((k, k)), 0
        for batch in batches:
            tokens = batch.column("tokens")
            for s in range(len(tokens)):
                words = tokens[s].values
                n = len(words) if words is not None else 0
                windows = max(n - window, 0) + 1 if words is not None else 0
                total += windows
                if not n or not k:
                    continue
                found = pc.index_in(words, value_set=wanted)
                at = np.flatnonzero(np.asarray(found.is_valid()))
                if not len(at):
                    continue
                which = np.asarray(found.drop_null())
                own, which = np.unique(which, return_inverse=True)
                # A term at a place is in the windows that start up to ``window`` - 1 before it.
                low, high = np.clip(at - window + 1, 0, windows), np.minimum(at, windows - 1) + 1
                marks = np.zeros((windows + 1, len(own)), "int32")
                np.add.at(marks, (low, which), 1)
                np.add.at(marks, (high, which), -1)
                held = (np.cumsum(marks, 0)[:-1] > 0).astype("float32")
                for at in range(0, windows, BLOCK):
                    both[np.ix_(own, own)] += (held[at : at + BLOCK].T @ held[at : at + BLOCK]).astype(float)
        a, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(a, -1), pa.int32()), pa.array(np.append(b, -1), pa.int32()), pa.array(np.append(both[a, b], total).astype("int64"))], ["a", "b", "n"])

    return run
