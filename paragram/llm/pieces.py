"""The merge rules of a SentencePiece BPE model, and texts cut where no piece reaches across.

The library starts from single characters and joins, again and again, the
neighbours whose concatenation is the best-scored piece (the leftmost, of
equals).  Two facts make exact shortest cuts possible: a row of pieces is the
model's encoding if and only if every two neighbours are (``follows``), and
hence every prefix of a text has exactly one last piece.
"""

from __future__ import annotations

import numpy as np

MARK = "▁"
#: Unknown characters get numbers from here on, instead of piece ids.
UNKNOWN = 1 << 20


class Pieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: dict[int, str] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id[piece], self.text[i] = model.get_score(i), i, piece
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a BPE model with byte fallback and marks at the start of pieces only is needed")
        self.longest = max(map(len, self.id))
        self.alphabet = sorted({c for p in self.id for c in p})
        self.barrier = np.array([chr(b) not in self.alphabet and b < 0x80 and b != 0x20 for b in range(256)])
        #: Pieces that merging reaches at all.
        self.reached = {p for p in self.id if self.merge(p) == [p]}
        self._follows: dict[int, dict[int, bool]] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def number(self, piece: str) -> int:
        """A piece's id; for a character that is no piece, a number that stands for it."""
        i = self.id.get(piece)
        if i is None:
            i = UNKNOWN + ord(piece)
            self.text[i] = piece
        return i

    def follows(self, a: int, b: int) -> bool:
        """Whether b may come right after a in an encoding."""
        row = self._follows.get(a)
        if row is None:
            row = self._follows[a] = {}
        known = row.get(b)
        if known is None:
            if len(self._follows) > 200_000:
                self._follows = {a: {}}
                row = self._follows[a]
            x, y = self.text[a], self.text[b]
            known = row[b] = self.merge(x + y) == [x, y]
        return known

    def ids_of(self, number: int) -> list[int]:
        """Token ids of a piece, or of an unknown character by its bytes."""
        return [number] if number < UNKNOWN else [self.bytes[b] for b in chr(number - UNKNOWN).encode()]

    def cost(self, number: int) -> int:
        return 1 if number < UNKNOWN else len(chr(number - UNKNOWN).encode())


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def marked(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each that isn't empty (the library's dummy prefix)."""
    size = np.diff(offsets)
    full = size > 0
    at = offsets[:-1][full]
    out = np.insert(raw, at, 0x20)
    grown = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(size + full, out=grown[1:])
    return out, grown


def piece_chunk_starts(raw: np.ndarray, offsets: np.ndarray, barrier: np.ndarray) -> np.ndarray:
    """Row starts, spaces after another sign, and both sides of characters in no piece.  No piece reaches across."""
    n = len(raw)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    cut = cut[:n]
    space = raw == 0x20
    blank = space.copy()  # a literal mark in the text is like a space
    blank[2:] |= (raw[2:] == 0x81) & (raw[1:-1] == 0x96) & (raw[:-2] == 0xE2)
    cut[1:] |= space[1:] & ~blank[:-1]
    odd = barrier[raw]
    cut |= odd
    cut[1:] |= odd[:-1] & (raw[1:] & 0xC0 != 0x80)
    return np.flatnonzero(cut)
