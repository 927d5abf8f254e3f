"""Tools and memory of a reused worker."""

import os

import numpy as np
import pyarrow as pa

from paragram.llm import chunks, textbytes, workers


def test_a_worker_holds_one_tool():
    made = []
    make = lambda name: lambda: made.append(name) or name
    assert [workers.tool("a", make("a")), workers.tool("a", make("a")), workers.tool("b", make("b"))] == ["a", "a", "b"]
    assert made == ["a", "b"] and list(workers._TOOL) == ["b"]
    assert list(workers.task(lambda batches: (workers.tool("b", make("again")) for _ in batches), "b")([1])) == ["b"]
    assert list(workers.task(lambda batches: iter(batches))([1, 2])) == [1, 2]  # a task without a tool drops it
    assert not workers._TOOL and made == ["a", "b"]


def test_a_cache_gives_the_same_values_in_any_order():
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("abcé 漢"), int(n))) for n in draw.integers(0, 700, 120)]
    cache = chunks.ChunkCache(np.int32, 200_000)

    def make(parts):
        return np.array([b for x in parts for b in x.encode()], dtype=np.int32), np.array([len(x.encode()) for x in parts], dtype=np.int64)

    for _ in range(4):
        raw, offsets = textbytes.buffers(pa.array([texts[i] for i in draw.permutation(len(texts))]))
        values, at = cache.rows(raw, offsets[:-1], offsets[1:], make)
        assert (values == raw).all() and (at == offsets).all()


def test_reused_workers_drop_their_tool(spark):
    one = spark.range(4, numPartitions=1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [len(workers.held())]})

    def making(batches):
        workers.tool("x", object)
        yield from held(batches)

    schema = "pid long, n long"
    first = one.mapInArrow(workers.task(making, "x"), schema).collect()
    same = one.mapInArrow(workers.task(held, "x"), schema).collect()
    other = one.mapInArrow(workers.task(held), schema).collect()
    assert [r.n for r in (*first, *same, *other)] == [1, 1 if same[0].pid == first[0].pid else 0, 0]
