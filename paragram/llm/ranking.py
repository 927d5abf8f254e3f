"""Bradley-Terry pairwise ranking of documents by quality.

Every labelled document of quality 1 is preferred to every one of quality 0.
The score of a document is linear in its features (quality_matrix, each as a
ladder of steps at its quantiles), and the logistic loss of score differences
over preference pairs is minimised.  The threshold is the quantile of the
training scores at the share of quality 0, and lies at 0.3 of the final scale:
score = logistic(slope * (s - threshold) + logit(0.3)).

Every labelled document outside the held-out fold is learnt from: quantiles
and threshold are exact over all of them, and each is in a pair.  A hash deals
them into blocks of about BLOCK rows; a block draws its pairs with a fixed
seed, PAIRS for each of its documents of the rarer label and one at least for
each other.  A document of a label too rare for all blocks is in several.
Rows stay on the executors; the driver adds up sums, whose size depends on the
number of steps alone.

Null and empty texts are scored by zero features.  Where the labelled rows lack
one of the labels, every score is 0.5; labels but 0 and 1 are left out.  Whole
texts are read, however long.  Other columns are ignored; repeated rows are
scored each; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragram.llm import storage, workers
from paragram.llm.features import QUALITY, quality_matrix
from paragram.llm.labelled import fold, labelled_once
from paragram.llm.textbytes import buffers, mix64, slices
from paragram.llm.totals import order_statistics, over, quantiles, summed

PAIRS = 24
CUT = 0.3
#: Rows of a block, on average, and how many of the rarer label it holds at least, on average (all of them, if there are fewer).
BLOCK = 5_000
LEAST = 64
_STEPS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)
_BASE = np.log(CUT / (1 - CUT))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BradleyTerry:
    steps: list[np.ndarray]
    weights: np.ndarray
    threshold: float
    slope: float

    def places(self, x: np.ndarray) -> np.ndarray:
        """How many steps of its ladder each feature is above."""
        return np.stack([np.searchsorted(s, x[:, j], side="left") for j, s in enumerate(self.steps)], axis=1).astype(np.uint8)

    def unfolded(self, places: np.ndarray) -> np.ndarray:
        return np.concatenate([(places[:, j : j + 1] > np.arange(len(s))[None, :]).astype(np.float64) for j, s in enumerate(self.steps)], axis=1)

    def design(self, x: np.ndarray) -> np.ndarray:
        return self.unfolded(self.places(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * (self.design(x) @ self.weights - self.threshold) + _BASE)


@dataclass
class Block:
    """Rows that are paired with each other: places of their features, labels, and whether the row counts here (copies in other blocks don't)."""

    number: int
    places: np.ndarray
    label: np.ndarray
    own: np.ndarray


def _unlearnt(steps: list[np.ndarray]) -> BradleyTerry:
    return BradleyTerry(steps, np.zeros(sum(map(len, steps))), -_BASE, -1.0)  # 0.5 everywhere


def ladders(total: Callable, width: int) -> tuple[list[np.ndarray], int, int]:
    """Steps of each feature, at quantiles of either label so that the rarer one has its own; rows of quality 1 and 0.  total: over parts (x, label)."""
    counts = total(lambda part: np.array([(part[1] == 1).sum(), (part[1] == 0).sum()], dtype=np.float64))
    good, bad = (0, 0) if counts is None else (int(n) for n in counts)
    if not (good and bad):
        return [np.empty(0)] * width, good, bad
    columns = lambda part: [x[:, j] for x in (part[0][part[1] == 1], part[0][part[1] == 0]) for j in range(width)]
    at = quantiles(total, columns, [good] * width + [bad] * width, np.array(_STEPS))
    return [np.unique(np.concatenate([at[j], at[width + j]])) for j in range(width)], good, bad


def drawn(good: int, bad: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block, by the rows' numbers within their label: every row is in one, each of the rarer label in PAIRS or more."""
    draw = np.random.default_rng(7 + block)
    n = max(PAIRS * min(good, bad), bad) if good and bad else 0
    few = good if n else 0
    i = np.concatenate([np.arange(few), draw.integers(0, max(good, 1), n)])
    return i, np.concatenate([draw.integers(0, max(bad, 1), few), np.resize(np.arange(bad), n)])


def _newton(model: BradleyTerry, block: Block) -> np.ndarray:
    """A block's number of pairs, and gradient and Hessian of their loss."""
    up, down = (model.unfolded(block.places[block.label == k]).astype(np.float32) for k in (1, 0))
    i, j = drawn(len(up), len(down), block.number)
    w = model.weights
    gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for a in range(0, len(i), 20_000):
        d = up[i[a : a + 20_000]] - down[j[a : a + 20_000]]
        p = _logistic(-(d @ w))
        gradient += d.T @ p
        hessian += (d * (p * (1 - p))[:, None].astype(np.float32)).T @ d
    return np.concatenate([[len(i)], gradient, hessian.ravel()])


def _margins(model: BradleyTerry, block: Block) -> np.ndarray:
    return (model.unfolded(block.places) @ model.weights)[block.own]


def _rising(model: BradleyTerry, block: Block, slopes: np.ndarray) -> np.ndarray:
    """The derivative of a block's log-likelihood by the slope, at each of the slopes."""
    z = _margins(model, block) - model.threshold
    return np.array([z @ (block.label[block.own] - _logistic(s * z + _BASE)) for s in slopes])


def fit_blocks(total: Callable, steps: list[np.ndarray], good: int, bad: int, ridge: float = 1e-3, rounds: int = 30) -> BradleyTerry:
    """total(one): the sum of one(block) over all blocks."""
    model = BradleyTerry(steps, np.zeros(sum(map(len, steps))), 0.0, 0.0)
    k = len(model.weights)
    for _ in range(rounds):  # Newton's method
        sums = total(lambda block: _newton(model, block))
        n, gradient, hessian = sums[0], sums[1 : k + 1], sums[k + 1 :].reshape(k, k)
        step = np.linalg.solve(hessian + ridge * n * np.eye(k), gradient - ridge * n * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break
    rank = int(np.ceil((good + bad - 1) * (bad / (good + bad))))
    model.threshold = float(order_statistics(total, lambda block: [_margins(model, block)], [np.array([rank])])[0][0])
    low, high = 1e-3, 50.0
    for _ in range(6):  # the scale, by maximum likelihood: where the derivative, which falls, is zero (of separable rows: rounded to zero in each block)
        slopes = np.linspace(low, high, 66)
        up = int((total(lambda block, slopes=slopes: _rising(model, block, slopes)) > 0).sum())
        low, high = float(slopes[max(up - 1, 0)]), float(slopes[min(up, 65)])
    model.slope = (low + high) / 2
    return model


def fit(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> BradleyTerry:
    """Of rows in memory, as one block."""
    steps, good, bad = ladders(lambda one: over([(x, label)], one), x.shape[1])
    model = _unlearnt(steps)
    if not (good and bad):
        return model
    known = (label == 0) | (label == 1)
    block = Block(0, model.places(x[known]), label[known], np.ones(known.sum(), dtype=bool))
    return fit_blocks(lambda one: over([block], one), steps, good, bad, ridge, rounds)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def dealt(rows: DataFrame, steps: list[np.ndarray], good: int, bad: int) -> DataFrame:
    """The rows (label, h, x) as blocks, a row of the table each, in order of h."""
    ladder, width = _unlearnt(steps), len(steps)
    blocks = -(-(good + bad) // BLOCK)
    copies = min(blocks, -(-LEAST * blocks // min(good, bad)))
    rare = 1 if good <= bad else 0

    def deal(batches):
        for batch in batches:
            label, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places = ladder.places(_matrix(batch.column(2), width))
            base = mix64(h.view(np.uint64)) % np.uint64(blocks)
            for k in range(copies):
                at = np.flatnonzero((label == rare) | (k == 0))
                wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(places[at].tobytes())]).cast(pa.binary())
                block = ((base[at] + np.uint64(k)) % np.uint64(blocks)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(label[at], pa.int32()), pa.array(h[at]), pa.array(np.full(len(at), k == 0)), wide], ["block", "label", "h", "own", "places"])

    def together(group):
        workers.drop_others(None)
        group = group.sort_by("h")
        one = lambda name, kind: np.asarray(group[name].to_numpy(), dtype=kind).tobytes()
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int64()), "label": [one("label", np.uint8)], "own": [one("own", np.uint8)], "places": [b"".join(group["places"].to_pylist())]})

    out = rows.mapInArrow(workers.task(deal), "block long, label int, h long, own boolean, places binary").repartition(min(blocks, storage.partitions(rows)), "block")
    return storage.written(out.groupBy("block").applyInArrow(together, "block long, label binary, own binary, places binary"), "blocks")


def _blocks(batches, width: int):
    for batch in batches:
        for number, *parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            label, own, places = (np.frombuffer(b, dtype=np.uint8) for b in parts)
            yield Block(number, places.reshape(-1, width), label.astype(float), own == 1)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, features x of every row, as a table."""

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            for a, b in slices(offsets):
                x = quality_matrix(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), lists], ["doc_id", "t", "x"])

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return storage.written_by(texts.select("doc_id", F.xxhash64("text").alias("t"), "text"), run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, t long, x array<double>", "features")


def learn(table: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0) -> BradleyTerry:
    """From all labelled rows of a table of ``featured`` outside the held-out fold."""
    width = len(QUALITY)
    rows = storage.written(labelled_once(table, labels, label, folds, held_out).where("label IN (0, 1)").select("label", "h", "x"), "labelled")

    def of_rows(one):
        return summed(rows, lambda batches: over(((_matrix(batch.column(2), width), batch.column(0).to_numpy()) for batch in batches if batch.num_rows), one))

    steps, good, bad = ladders(of_rows, width)
    model = _unlearnt(steps)
    if good and bad:
        blocks = dealt(rows, steps, good, bad)
        model = fit_blocks(lambda one: summed(blocks, lambda batches: over(_blocks(batches, width), one)), steps, good, bad)
        storage.release(blocks)
    storage.release(rows)
    return model


def matrix_of(rows: DataFrame, extract) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and parts of a bounded sample, in order of h; features are made on the executors."""

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for a, b in slices(offsets):
                x = extract(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *(batch.column(k).slice(a, b - a) for k in (1, 2, 3))], ["x", "label", "part", "h"])

    got = rows.select("text", "label", "part", "h").mapInArrow(workers.task(run), "x array<double>, label int, part int, h long").toArrow().sort_by("h")
    if got.num_rows == 0:
        width = len(extract(np.frombuffer(b"a", dtype=np.uint8), np.array([0, 1]))[0])
        return np.zeros((0, width)), np.zeros(0), np.zeros(0)
    flat = got["x"].combine_chunks().flatten().to_numpy()
    return flat.reshape(got.num_rows, -1), got["label"].to_numpy().astype(float), got["part"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0) -> BradleyTerry:
    table = featured(docs)
    model = learn(table, labels, label, folds, held_out)
    storage.release(table)
    return model


def scored(docs: DataFrame, extract, score, folds: int, held_out: int, cut: float, end=lambda: None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; extract and score: of a batch, on the executors; end: called after a task's last batch."""

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                s = score(extract(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s, pa.float64())], ["doc_id", "score"])
        end()

    out = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(workers.task(run), "doc_id long, score double")
    return _verdicts(out, folds, held_out, cut)


def _verdicts(out: DataFrame, folds: int, held_out: int, cut: float) -> DataFrame:
    held = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def rank(docs: DataFrame, model: BradleyTerry, folds: int = 5, held_out: int = 0) -> DataFrame:
    return scored(docs, quality_matrix, model.score, folds, held_out, CUT)


def ranked(table: DataFrame, model: BradleyTerry, folds: int = 5, held_out: int = 0) -> DataFrame:
    """As ``rank``, from a table of ``featured``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1), len(QUALITY))), pa.float64())], ["doc_id", "score"])

    return _verdicts(table.selectExpr("CAST(doc_id AS LONG) AS doc_id", "x").mapInArrow(workers.task(run), "doc_id long, score double"), folds, held_out, CUT)
