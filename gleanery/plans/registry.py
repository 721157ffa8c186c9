"""What a pipeline is made of: sources, fetchers, extractors and a store.

Registration order is priority. The built-in fetchers and extractors come first.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators.routing import EXTRACTORS, FETCHERS, STORE_FETCHER, Extractor, Fetcher


class Store(Protocol):
    """What `write` returns for a batch is handed to `commit` or to `abort`. A batch that is done again is written and
    committed again, and replaces itself."""

    def write(self, items: DataFrame, batch_id: int) -> Any: ...

    def commit(self, written: Any) -> None: ...

    def abort(self, written: Any) -> None: ...


class Registry:
    def __init__(self, builtins: bool = True):
        self.fetchers: list[Fetcher] = [*FETCHERS, STORE_FETCHER] if builtins else []
        self.extractors: list[Extractor] = list(EXTRACTORS) if builtins else []
        self.sources: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self.stores: dict[str, Callable[[DataFrame, int], None] | Store] = {}

    def register_extractor(
        self, name, predicate, preferred=(), fn=None, find_title=None, title=None, members=None, arrow=None
    ):
        """`predicate(url, mime)` and `fn(content)` are Column functions. `arrow`, in place of `fn` and `find_title`, is any
        Python function on Arrow arrays (see `operators.arrow_extract`): it gets its own rows only, and what it
        raises fails one row. A Python UDF as `fn` has to accept the content of all rows: Spark runs it on those of other
        extractors as well, and what it raises fails the job.
        `find_title(content)` looks a title up, `title(given, found)` settles on one: the
        given one first if left out. `members(content)` makes it a container. `fn`, `find_title` and `members`
        may take a second argument, the bytes of content that did not come as text."""
        if arrow is not None and (fn is not None or find_title is not None):
            raise ValueError("arrow stands in place of fn and find_title")
        if (find_title is not None or arrow is not None) and title is None:
            title = lambda given, found: F.coalesce(tx.non_empty(given), found)
        self._fresh(name, [e.name for e in self.extractors])
        self.extractors.append(
            Extractor(name, predicate, tuple(preferred), fn, find_title, title, members, arrow)
        )
        return self

    def register_fetcher(self, name, predicate, reader):
        """`predicate(url)` is a Column function; `reader` maps listed rows to fetched rows."""
        self._fresh(name, [f.name for f in self.fetchers])
        self.fetchers.append(Fetcher(name, predicate, reader))
        return self

    def register_source(self, name, fn):
        """`fn(spark)` returns a listing: at least a source_url column."""
        self._fresh(name, self.sources)
        self.sources[name] = fn
        return self

    def register_store(self, name, store):
        """A Store, such as `sources.commits.ParquetStore`, or a function `store(items, batch_id)` that puts up with being
        called twice for a batch. A batch's stores commit when all of them have written; if one fails, all abort."""
        self._fresh(name, self.stores)
        if not callable(store) and not all(hasattr(store, m) for m in ("write", "commit", "abort")):
            raise TypeError("a store is a function or has write, commit and abort")
        self.stores[name] = store
        return self

    @staticmethod
    def _fresh(name, taken):
        if name in taken:
            raise ValueError(f"{name!r} is registered already")
