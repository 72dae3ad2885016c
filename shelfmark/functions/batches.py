"""Batches for Python passes over pages, bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Characters of markup that a pass holds parsed at a time; one page is never cut.
PAGE_CHARACTERS = 4 << 20


def by_size(frames: Iterator[pd.DataFrame], column: str = "html", limit: int = PAGE_CHARACTERS) -> Iterator[pd.DataFrame]:
    """Frames cut so that each has about ``limit`` characters in ``column``, or one longer page."""
    for frame in frames:
        ends = np.cumsum(frame[column].map(len, na_action="ignore").fillna(0).to_numpy(dtype=np.int64)) // limit
        for _, part in frame.groupby(ends, sort=False):
            yield part
