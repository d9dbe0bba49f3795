"""Arrow batches cut by the length of their texts, so that memory follows the texts and not the number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

CHARS = 2_000_000


def sliced(batches: Iterator[pd.DataFrame], column: str = "text", most: int = CHARS) -> Iterator[pd.DataFrame]:
    """The rows of the batches in their order, in frames of about ``most`` characters; a longer text is a frame of its own."""
    for pdf in batches:
        upto = np.cumsum([len(t) if isinstance(t, str) else 0 for t in pdf[column]])
        if not len(upto) or upto[-1] <= most:
            yield pdf
            continue
        part = (upto - 1).clip(0) // most
        for _, rows in pdf.groupby(part, sort=False):
            yield rows.reset_index(drop=True)
