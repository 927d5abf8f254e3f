"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from paragram.llm.textbytes import Words, mix64, range_hashes, window_hashes, window_valid

SIZE = 5


def shingles(w: Words, k: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, in order.  A text of fewer than k words has one, of all its words; none: no shingle."""
    hashes, row, n = w.hashes(), w.row_of(), w.counts()
    at = np.flatnonzero(window_valid(w.first, k))
    rows, found = row[at], window_hashes(hashes, k)[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = range_hashes(hashes, w.first[short], w.first[short + 1])
        place = np.searchsorted(rows, short)
        rows, found = np.insert(rows, place, short), np.insert(found, place, own)
    return rows, found


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts, in order of row."""
    order = np.argsort(mix64(hashes ^ mix64(rows.astype(np.uint64))))
    r, h = rows[order], hashes[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    back = np.argsort(r[at], kind="stable")
    return r[at][back], h[at][back], count[back]
