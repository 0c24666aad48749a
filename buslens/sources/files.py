"""Files as bytes: listed by Spark, opened as streams where they lie."""

from __future__ import annotations

import bz2
import codecs
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Stores that workers open themselves. Files elsewhere go through Spark's readers.
STREAMED = ("file", "s3", "s3a", "gs")
#: Bytes read at a time.
CHUNK = 1 << 20


def listed(spark: SparkSession, path, content: bool = False) -> DataFrame:
    """(source_file, path, bytes) for each file, and its content if wanted. Spark lists the files and puts small ones together; without content it opens none. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("source_file"), "path", F.col("length").alias("bytes"), *(["content"] if content else []))


def scheme(path: str) -> str:
    found = re.match(r"([a-z][a-z0-9+.-]*):", path)
    return found.group(1) if found else "file"


def streamed(files: DataFrame) -> bool:
    """Whether workers can open these files themselves."""
    first = files.select("path").first()
    return first is None or scheme(first["path"]) in STREAMED


def open_stream(path: str) -> BinaryIO:
    if scheme(path) == "file":
        return open(re.sub(r"^file:(//)?", "", path), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return store.open_input_stream(name, compression=None)


def chunks(stream: BinaryIO, size: int = CHUNK) -> Iterator[bytes]:
    while data := stream.read(size):
        yield data


def unpacked(name: str, parts: Iterator[bytes]) -> Iterator[bytes]:
    """The text bytes of a file's bytes, unpacked as its name asks for (.gz, .deflate, .bz2). As many packed streams as follow one another."""
    end = name.rsplit(".", 1)[-1].lower()
    fresh = {"gz": lambda: zlib.decompressobj(31), "deflate": zlib.decompressobj, "bz2": bz2.BZ2Decompressor}.get(end)
    if fresh is None:
        yield from parts
        return
    state = fresh()
    for data in parts:
        while data:
            if state.eof:
                state = fresh()
            yield state.decompress(data)
            data = state.unused_data


def first_lines(parts: Iterator[bytes], n: int, most: int) -> list[str]:
    """The first n lines, without reading on; of lines that go on beyond `most` bytes in all, what lies within."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    text, seen, done = "", 0, False
    for data in parts:
        text += decode(data[:most - seen])
        seen += len(data)
        # A return at the end may be followed by a line feed.
        if seen >= most or len(re.findall(r"\r\n|\r(?!$)|\n", text)) >= n:
            done = True
            break
    if not done:
        text += decode(b"", True)
    lines = re.split(r"\r\n|\r|\n", text.removeprefix("﻿"))
    if lines and not lines[-1]:
        lines.pop()
    return lines[:n]
