"""Rows out to one file each, written by the tasks that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .files import open_filesystem


def export_files(rows: DataFrame, root: str) -> None:
    """Writes `content` (binary) to root/`relative_path`. A retried task writes the same again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_filesystem(root)
        known = set()
        for batch in batches:
            paths = batch.column("relative_path").to_pylist()
            for path, content in zip(paths, batch.column("content")):
                folder = f"{base}/{path.rpartition('/')[0]}"
                if folder not in known:
                    fs.create_dir(folder, recursive=True)
                    known.add(folder)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.as_buffer())
            yield batch.select(["relative_path"])

    (
        rows.select("relative_path", "content")
        .mapInArrow(write, "relative_path string")
        .write.format("noop")
        .mode("overwrite")
        .save()
    )
