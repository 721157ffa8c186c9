"""Extractors that are Python functions on Arrow arrays.

Such a function gets the rows of its own extractor and no others, a batch at a time: `arrow(texts)` or `arrow(texts, raw)`,
arrays of strings and, for content that did not come as text, of bytes (null where there is none). It gives the extracted
texts as an array of the same length, or a pair of arrays, texts and found titles. A null text means that nothing was
found and is stored as such; an exception fails only the row that raises it: a batch that fails is done again row by row.
"""

from __future__ import annotations

import inspect

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

TEXT, TITLE, ERROR = "__arrow_text", "__arrow_title", "__arrow_error"
_ADDED = (TEXT, TITLE, ERROR)


def _wants_bytes(fn) -> bool:
    try:
        kinds = [p for p in inspect.signature(fn).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    except (TypeError, ValueError):
        return False
    return len(kinds) == 2


def _strings(values, n: int) -> list[str | None]:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    found = (values if isinstance(values, pa.Array) else pa.array(values)).cast(pa.string()).to_pylist()
    if len(found) != n:
        raise ValueError(f"{len(found)} values for {n} rows")
    return found


def _call(fn, texts: pa.Array, raw: pa.Array) -> tuple[list, list]:
    n = len(texts)
    out = fn(texts, raw) if _wants_bytes(fn) else fn(texts)
    if isinstance(out, tuple):
        found, titles = out
        return _strings(found, n), _strings(titles, n)
    return _strings(out, n), [None] * n


def run(fn, texts: pa.Array, raw: pa.Array) -> list[tuple[str | None, str | None, str | None]]:
    """(text, title, error) of each row."""
    try:
        return [(t, f, None) for t, f in zip(*_call(fn, texts, raw))]
    except Exception as e:  # noqa: BLE001  whatever an extractor raises is the failure of the rows it had
        if len(texts) == 1:
            return [(None, None, f"{type(e).__name__}: {e}")]
    return [r for i in range(len(texts)) for r in run(fn, texts.slice(i, 1), raw.slice(i, 1))]


def with_extracted(rows: DataFrame, extractors, text: str, raw: str = "content_binary", chosen: str = "extractor") -> DataFrame:
    """`rows` with the columns TEXT, TITLE and ERROR, null for rows of extractors that are no Arrow functions. One pass; rows
    of other extractors go through the worker as they are."""
    functions = {e.name: e.arrow for e in extractors if e.arrow is not None}
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.StringType()) for c in _ADDED)])

    def task(batches):
        for batch in batches:
            names = batch.schema.names
            texts, bytes_, who = (batch.column(names.index(c)) for c in (text, raw, chosen))
            own: dict[str, list[int]] = {}
            for i, name in enumerate(who.to_pylist()):
                if name in functions and (texts[i].is_valid or bytes_[i].is_valid):
                    own.setdefault(name, []).append(i)
            added = [[None] * batch.num_rows for _ in _ADDED]
            for name, places in own.items():
                at = pa.array(places)
                for i, found in zip(places, run(functions[name], texts.take(at), bytes_.take(at))):
                    for column, value in zip(added, found):
                        column[i] = value
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in added)], [*names, *_ADDED])

    return rows.mapInArrow(task, schema)
