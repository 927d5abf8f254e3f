"""Gradient-boosted trees over dense features of toxicity, with isotonic calibration.

Features of a text: densities of words of a lexicon (as written, and with
look-alike signs put back to letters), of words that begin like words typical
of toxic texts, the share of lexicon words near a second person, capitals,
punctuation and obfuscated words.  The lexicon is a short fixed list joined by
words and word beginnings that are significantly more frequent in toxic
training documents (document counts, made on the executors, with groups of
copies counted once; bounded by the sample).  Trees fit the logistic loss on histograms of the features,
which for training come from lexicons of the other folds; at every size alike.
Scores are calibrated by isotonic regression on out-of-fold predictions.

Learns from a bounded sample (labelled.SAMPLE_ROWS).  Null and empty texts
are scored by zero features.  Where the sample lacks one of the labels, every
score is the share of toxic rows.  Whole texts and words of any length are
read.  Other columns are ignored; repeated rows are scored each; an empty
table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.llm import storage, workers
from paragram.llm.chunks import ChunkCache
from paragram.llm.features import _SIGN, Sums, upper_and_letters
from paragram.llm.labelled import SAMPLE_ROWS, distinct_texts, training_rows
from paragram.llm.ranking import matrix_of, scored
from paragram.llm.textbytes import buffers, slices, words_of

CUT = 0.7
NEAR = 5
#: Parts of the sample for cross-fitting and calibration.
FOLDS = 4
#: Fixed lists: common English insults, and words of the second person in four languages.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "trash", "garbage", "scum", "clown", "pathetic", "worthless", "disgusting", "ugly", "fool", "imbecile", "jerk", "hate", "kill", "shut", "freak", "vermin", "filth")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")
_LOOK_ALIKE = str.maketrans("013457@$!|€+", "oieastasiiet")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIXED = re.compile(r"[^\W\d_][^\w\s'’.,\-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|^\d*[$@]+[^\W\d_]|^\d[^\W\d_]{3,}")
_PREFIXES = (3, 4, 5, 6, 7, 8)


def bare(word: str) -> str:
    """Lower case, without signs at the ends."""
    return _EDGE.sub("", word.lower())


def plain(word: str) -> str:
    """Look-alike signs as letters, other signs gone."""
    return re.sub(r"[\W\d_]+", "", word.lower().translate(_LOOK_ALIKE))


@dataclass
class Lexicon:
    words: frozenset[str]
    beginnings: frozenset[str]
    _cache: ChunkCache | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"words": self.words, "beginnings": self.beginnings, "_cache": None}

    def forget(self) -> None:
        """Drops the cache, at the end of a task."""
        self._cache = None

    def flags(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: 1 in the lexicon, 2 begins like it, 4 second person, 8 obfuscated, 16 in the lexicon behind obfuscation."""
        out = np.zeros(len(chunks), dtype=np.int8)
        for i, word in enumerate(chunks):
            own, f = bare(word), 0
            if own in self.words:
                f |= 1
            if any(own[:n] in self.beginnings for n in _PREFIXES if len(own) >= n):
                f |= 2
            if own in SECOND_PERSON:
                f |= 4
            if not word.isalpha() and _MIXED.search(word):
                f |= 8
                if plain(word) in self.words:
                    f |= 16
            out[i] = f
        return out, np.ones(len(chunks), dtype=np.int64)

    def matrix(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of FEATURES for each text; all zero for a text without words."""
        if self._cache is None:
            self._cache = ChunkCache(np.int8, 32 << 20)
        rows, w, sums = len(offsets) - 1, words_of(raw, offsets), Sums(offsets)
        n, row = w.counts(), w.row_of()
        flags = self._cache.rows(w.raw, w.start, w.end, self.flags)[0] if len(w.start) else np.empty(0, dtype=np.int8)
        per_word, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
        count = lambda mask: np.bincount(row, weights=mask, minlength=rows)
        hit = flags & 17 > 0
        close = np.zeros(len(flags), dtype=bool)
        person = np.flatnonzero(flags & 4 > 0)
        for k in range(-NEAR, NEAR + 1):
            at = person + k
            ok = (at >= 0) & (at < len(flags))
            at, base = at[ok], person[ok]
            close[at[row[at] == row[base]]] = True
        hits, begun, upper_letter = count(hit), count(flags & 2 > 0), upper_and_letters(raw)
        columns = [
            hits / per_word, begun / per_word, np.log1p(hits), np.log1p(begun), count(flags & 16 > 0) / per_word, count(hit & close) / np.maximum(hits, 1),
            count(flags & 4 > 0) / per_word, sums(upper_letter[0]) / np.maximum(sums(upper_letter[1]), 1), sums(_SIGN[raw]) / size, sums(raw == 0x21) / per_word,
            count(flags & 8 > 0) / per_word, np.log1p(n),
        ]
        out = np.stack(columns, axis=1).astype(np.float64)
        out[n == 0] = 0
        return out


FEATURES = ("lexicon", "beginnings", "log_lexicon", "log_beginnings", "hidden_lexicon", "near_second_person", "second_person", "capitals", "punctuation", "exclamations", "obfuscated", "log_words")


def learn_lexicons(rows: DataFrame, folds: int) -> list[Lexicon]:
    """Words and beginnings with significantly more toxic documents than their share: of the rows outside each fold (part % folds), then of all."""

    def count(batches):
        seen: dict[tuple[str, int], list[int]] = {}

        def counts():
            return pa.RecordBatch.from_pydict({"term": [t for t, _ in seen], "fold": pa.array([k for _, k in seen], pa.int32()), "toxic": [n[0] for n in seen.values()], "clean": [n[1] for n in seen.values()]})

        few = (batch.slice(k, 200) for batch in batches for k in range(0, batch.num_rows, 200))
        for batch in few:
            for text, label, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = {bare(x) for x in set(re.findall(r"[^\x20\x09-\x0D]+", text or ""))} - {""}
                terms = {"w" + x for x in own} | {f"b{x[:n]}" for x in own for n in _PREFIXES if len(x) > n}
                for t in terms | {""}:
                    seen.setdefault((t, part % folds), [0, 0])[label != 1] += 1
                if len(seen) > 100_000:
                    yield counts()
                    seen.clear()
        if seen:
            yield counts()

    counted = rows.select("text", "label", "part").mapInArrow(workers.task(count), "term string, fold int, toxic long, clean long")
    outside = [F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in range(folds) for c in ("toxic", "clean")]
    counted = counted.groupBy("term").agg(*outside, F.sum("toxic").alias(f"toxic_{folds}"), F.sum("clean").alias(f"clean_{folds}"))
    counted = storage.written(counted.where(f"term = '' OR toxic_{folds} >= 3"), "terms")
    totals = counted.where("term = ''").collect()
    out = []
    for k in range(folds + 1):
        n_toxic, n_clean = (totals[0][f"toxic_{k}"], totals[0][f"clean_{k}"]) if totals else (0, 0)
        if not n_toxic or not n_clean:
            out.append(Lexicon(frozenset(INSULTS), frozenset()))
            continue
        counts = counted.select("term", F.col(f"toxic_{k}").alias("toxic"), F.col(f"clean_{k}").alias("clean"))
        share_t, share_c = (F.col("toxic") + 0.5) / (n_toxic + 1.0), (F.col("clean") + 0.5) / (n_clean + 1.0)
        odds = F.log(share_t / share_c)
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        found = counts.where("term <> '' AND toxic >= 3").withColumn("z", odds / error).where((odds > 1.2) & (F.col("z") > 2.3))
        best = [r["term"] for r in found.collect()]  # of the sample's terms, so bounded with it
        out.append(Lexicon(frozenset(INSULTS) | {t[1:] for t in best if t[0] == "w"}, frozenset(t[1:] for t in best if t[0] == "b")))
    return out


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return self.value[node]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)


@dataclass
class Boosted:
    """Boosted trees of the logistic loss."""

    base: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.apply(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Boosted:
    cuts = [np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1]), np.quantile(x[y == 1, j], np.linspace(0, 1, 12)[1:-1])])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(map(len, cuts)) + 1
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model, score = Boosted(base, []), np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                g, h = gradient[rows].sum(), hessian[rows].sum()
                tree.value[k] = rate * g / (h + ridge)
                if level == depth or len(rows) < 10:
                    continue
                best = (1e-6, -1, 0)
                for j, c in enumerate(cuts):
                    gl = np.cumsum(np.bincount(binned[rows, j], weights=gradient[rows], minlength=width))[: len(c)]
                    hl = np.cumsum(np.bincount(binned[rows, j], weights=hessian[rows], minlength=width))[: len(c)]
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(hl < 0.5) | (h - hl < 0.5)] = 0
                    b = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[b] > best[0]:
                        best = (float(gain[b]), j, b)
                if best[1] >= 0:
                    tree.feature[k], tree.cut[k] = best[1], cuts[best[1]][best[2]]
                    node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
        score += tree.apply(x)
        model.trees.append(tree)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the score and their calibrated values."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least and greatest score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, _, hi = blocks.pop()
            v1, n1, lo, _ = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    return np.array([s for b in blocks for s in (b[2], b[3])]), np.array([v for b in blocks for v in (b[0], b[0])])


@dataclass
class Classifier:
    lexicon: Lexicon
    trees: Boosted
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        level = np.interp(raw, self.knots, self.values) if len(self.knots) else 1 / (1 + np.exp(-raw))
        return 0.998 * level + 0.002 / (1 + np.exp(-raw))  # the last part orders what calibration ties


def fit(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, part: np.ndarray, folds: int = FOLDS) -> Classifier:
    if len(y) == 0 or y.min() == y.max():
        return Classifier(lexicon, Boosted(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), []), np.empty(0), np.empty(0))
    out, fold = np.full(len(y), np.nan), part % folds
    for k in range(folds):
        train, test = fold != k, fold == k
        if test.any() and y[train].any() and not y[train].all():
            out[test] = boost(x[train], y[train]).raw(x[test])
    known = ~np.isnan(out)
    knots, values = isotonic(out[known], y[known])
    return Classifier(lexicon, boost(x, y), knots, values)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, most: int = SAMPLE_ROWS) -> Classifier:
    """Cross-fitted: the features of each of FOLDS parts of the sample come from the lexicon of the other parts, so that the trees see it as on new texts."""
    rows = distinct_texts(training_rows(docs, labels, label, folds, held_out, most))
    *others, lexicon = learn_lexicons(rows, FOLDS)
    each = [matrix_of(rows.where(F.col("part") % FOLDS == k), own.matrix) for k, own in enumerate(others)]
    return fit(lexicon, *(np.concatenate(columns) for columns in zip(*each, strict=True)))


def score(docs: DataFrame, model: Classifier, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return scored(docs, model.lexicon.matrix, model.score, folds, held_out, CUT, model.lexicon.forget)


def accepted(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns; one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(at))
            for a, b in slices(offsets):
                s = model.score(model.lexicon.matrix(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield batch.slice(a, b - a).filter(pa.array(s < CUT))
        model.lexicon.forget()

    return docs.mapInArrow(workers.task(run), docs.schema)
