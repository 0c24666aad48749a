"""SHA-256 of source files of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buslens.sources.files import chunks, listed, open_stream, streamed


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            state = hashlib.sha256()
            with open_stream(path) as stream:
                for data in chunks(stream):
                    state.update(data)
            found.append(state.hexdigest().upper())
        yield pa.RecordBatch.from_arrays([batch.column("source_file"), batch.column("bytes"), pa.array(found, pa.string())], names=["source_file", "bytes", "sha256"])


def file_digests(spark, path, *, stream: bool | None = None) -> DataFrame:
    """source_file, bytes, sha256 (upper case) of the files as they lie, packed ones included.

    The task that a file is dealt to streams its bytes through the hash: nothing is shuffled, and nothing holds a whole file. In stores that only Spark's readers
    reach (stream=False), the hash is taken of the file as one value, which Spark limits to 2 GB.
    """
    files = listed(spark, path)
    if streamed(files) if stream is None else stream:
        return files.mapInArrow(_digests, "source_file string, bytes long, sha256 string")
    return listed(spark, path, content=True).select("source_file", "bytes", F.upper(F.sha2("content", 256)).alias("sha256"))
