"""Rows made from rows by a Python function, evaluated once for each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

#: Characters of text that are turned into Python objects at once.
SLICE_CHARS = 2_000_000


def slices(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_CHARS; sizes: characters of each row."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= SLICE_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def sizes(column: pa.Array) -> list[int]:
    """About how many characters each row has."""
    if pa.types.is_list(column.type):
        return [60 * (x or 0) for x in pa.compute.list_value_length(column).to_pylist()]
    return [x or 0 for x in pa.compute.utf8_length(column).to_pylist()]


def made(df: DataFrame, keep: list[str], args: list[str], added: str, function: Callable) -> DataFrame:
    """keep, and the columns `added` (a schema): function(*args) gives the rows (tuples) that a row becomes, none or more.

    args: columns of df, the first one a text or an array of texts, by which work is portioned; a null comes as None.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    df = df.select(*keep, *[df[a].alias(f"_arg{i}") for i, a in enumerate(args)])
    new = _parse_datatype_string(added)
    schema = StructType([df.schema[k] for k in keep] + new.fields)
    n, kinds = len(keep), [to_arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, sizes(whole.column(n))):
                at, out = [], []
                for i, values in enumerate(zip(*[batch.column(n + j).to_pylist() for j in range(len(args))], strict=True)):
                    rows = function(*values)
                    out += rows
                    at += [i] * len(rows)
                index = pa.array(at, pa.int64())
                columns = [batch.column(j).take(index) for j in range(n)]
                columns += [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def where(df: DataFrame, arg: str, test: Callable) -> DataFrame:
    """The rows of df whose arg passes a test in Python."""
    return made(df, df.columns, [arg], "_passed boolean", lambda x: [(True,)] if test(x) else []).drop("_passed")
