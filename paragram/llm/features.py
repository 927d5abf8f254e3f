"""Dense numeric features of whole texts, vectorised over batches; texts only, no other column."""

from __future__ import annotations

import numpy as np

from paragram.llm.textbytes import Words, mix64, span_hashes, window_hashes, window_valid, words_of

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII <= 122))
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SIGN = (_ASCII > 32) & (_ASCII < 127) & ~_LETTER & ~_DIGIT
_SYMBOL = np.isin(_ASCII, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_STOP = np.isin(_ASCII, np.frombuffer(b".,;:", dtype=np.uint8))


class Sums:
    """Sums of byte masks over the rows of a batch."""

    def __init__(self, offsets: np.ndarray) -> None:
        self.offsets = offsets

    def __call__(self, mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def upper_and_letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of capital and of all letters: ASCII, and two-byte characters of the Latin-1 block (others as lower case)."""
    upper, letter = _UPPER[raw], _LETTER[raw] | (raw >= 0xC3) & (raw < 0xE0)
    upper = upper.copy()
    upper[:-1] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    return upper, letter


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[back] > 1


def repeated_words(w: Words, hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each row that lie in a k-word window found twice or more in the row."""
    windows, valid = window_hashes(hashes, k), window_valid(w.first, k)
    at = np.flatnonzero(valid)
    if len(at) == 0:
        return np.zeros(w.rows, dtype=np.int64)
    row = w.row_of()
    at = at[_again(mix64(windows[at] ^ mix64(row[at].astype(np.uint64))))]
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + k, -1)
    return np.bincount(row, weights=np.cumsum(change)[:-1] > 0, minlength=w.rows).astype(np.int64)


def duplicate_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each row that hold more than a byte, and how many of them equal an earlier one."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(raw == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(raw)]
    if len(start) == 0:
        return np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    end = np.append(start[1:], len(raw))
    row = np.searchsorted(offsets, start, side="right") - 1
    end = end - (raw[end - 1] == 0x0A)
    full = end - start > 1
    start, end, row = start[full], end[full], row[full]
    keys = mix64(span_hashes(raw, start, end) ^ mix64(row.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(row, minlength=rows)
    return lines, lines - np.bincount(row[first], minlength=rows)


QUALITY = ("symbols", "capitals", "exclamations", "digits", "stops", "signs", "word_length", "log_words", "repeated", "lines_again", "stutter", "distinct", "line_words")


def quality_matrix(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of QUALITY for each text; all zero for a text without words."""
    rows = len(offsets) - 1
    w, sums = words_of(raw, offsets), Sums(offsets)
    n = w.counts()
    per_word, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    upper, letter = upper_and_letters(raw)
    hashes = w.hashes()
    row = w.row_of()
    stutter = np.zeros(len(hashes), dtype=bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    kinds = np.unique(mix64(hashes ^ mix64(row.astype(np.uint64))), return_index=True)[1]
    lines, again = duplicate_lines(raw, offsets)
    distinct = np.bincount(row[kinds], minlength=rows)
    columns = [
        sums(_SYMBOL[raw]) / per_word, sums(upper) / np.maximum(sums(letter), 1), sums(raw == 0x21) / per_word, sums(_DIGIT[raw]) / size,
        sums(_STOP[raw]) / per_word, sums(_SIGN[raw]) / size, sums(letter) / per_word, np.log1p(n), repeated_words(w, hashes) / per_word,
        again / np.maximum(lines, 1), np.bincount(row, weights=stutter, minlength=rows) / per_word,
        distinct / np.maximum(np.minimum(n, 400 + np.sqrt(n)), 1), np.log1p(n / np.maximum(lines, 1)),
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[n == 0] = 0
    return out
