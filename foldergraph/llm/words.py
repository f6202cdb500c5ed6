"""Words of many texts at once, as Arrow arrays: shared by the operators that look at word order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in steps of about so many bytes; a longer text is a step of its own.
STEP = 4 << 20


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts have about STEP bytes."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + STEP, "right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of all texts, where each text's words begin and the last one's end): runs of anything but white space of the
    contracts; a null has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    own = np.asarray(pc.list_parent_indices(parts))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # leading and trailing white space gives empty words
    own, words = own[np.asarray(full)], words.filter(full)
    return words, np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int64)


def joined(words: pa.Array, starts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The words where keep is true, joined by one space, of each text."""
    left = np.r_[0, np.cumsum(keep)][starts]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(keep))), " ")
