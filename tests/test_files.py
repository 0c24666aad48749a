import bz2
import gzip
import hashlib
import io

import pytest

from buslens.sources import files
from buslens.sources.detect import PROBE_LINES, detect_format
from buslens.sources.provenance import file_digests

LINE = "(1700000000.{:06d}) can0 123#1122\n"


def test_digests_are_those_of_the_bytes(spark, tmp_path):
    text = "".join(LINE.format(i) for i in range(5000)).encode()
    contents = {"a.log": text, "no_end.log": text[:-1], "empty.log": b"", "crlf.log": text.replace(b"\n", b"\r\n"), "packed.log.gz": gzip.compress(text),
                "with space.log": b"x\n\n", "any.bin": bytes(range(256)) * 9000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {name: (len(data), hashlib.sha256(data).hexdigest().upper()) for name, data in contents.items() if data}
    for stream in (None, False):
        df = file_digests(spark, str(tmp_path), stream=stream)
        assert {r.source_file.rsplit("/", 1)[1].replace("%20", " "): (r.bytes, r.sha256) for r in df.collect()} == want
    plan = file_digests(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "content" not in plan


def test_detection_of_packed_and_odd_files(spark, tmp_path):
    text = "".join(LINE.format(i) for i in range(900)).encode()
    (tmp_path / "a.log.gz").write_bytes(gzip.compress(text[:4000]) + gzip.compress(text[4000:]))
    (tmp_path / "b.log.bz2").write_bytes(bz2.compress(text))
    (tmp_path / "c.log").write_bytes(b"\xef\xbb\xbf" + text.replace(b"\n", b"\r\n"))
    (tmp_path / "d.log").write_bytes(b"nothing known\n" * 500)
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "long.txt").write_bytes(b"z" * (6 << 20))
    keep = ["source_file", "candump", "busmaster", "peak", "css", "format", "status"]
    one, two = (sorted(map(tuple, detect_format(spark, str(tmp_path), stream=s).select(*keep).collect())) for s in (True, False))
    assert one == two and [r[-2] for r in one] == ["candump", "candump", "candump", "busmaster", None]


class Counted(io.BytesIO):
    total = 0

    def read(self, size=-1):
        data = super().read(size)
        self.total += len(data)
        return data


@pytest.mark.parametrize("n", [1_000, 300_000])
def test_bytes_read_do_not_grow_with_the_file(n):
    stream = Counted("".join(LINE.format(i % 1_000_000) for i in range(n)).encode())
    lines = files.first_lines(files.chunks(stream, 1 << 12), PROBE_LINES, 1 << 20)
    assert len(lines) == PROBE_LINES and lines[7] == LINE.format(7).rstrip("\n") and stream.total <= 3 << 12


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_lines_over_chunk_borders(size):
    text = "﻿a\r\nüb\rc\n\nd€"
    assert files.first_lines(files.chunks(io.BytesIO(text.encode()), size), 9, 1 << 20) == ["a", "üb", "c", "", "d€"]
    assert files.first_lines(files.chunks(io.BytesIO(text.encode()), size), 2, 1 << 20) == ["a", "üb"]
    assert files.first_lines(files.chunks(io.BytesIO(b"abc\n" * 9), size), 9, 6) == ["abc", "ab"]
