import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from buslens.operators.frames import filter_frames, page_frames
from buslens.sinks.exports import export_join
from buslens.sinks.frame_store import ranked_count, ranked_page, write_by_id, write_ranked

SHAPE = "source_file string, frame_index long, can_id long, ts_ns long"


def recordings(spark, n=3000):
    rng = random.Random(4)
    data = [(f"log {f}%20.txt", i, rng.choice([5] * 6 + list(range(100, 140))), i * 1_000_000) for f in range(3) for i in range(n // 3)]
    rng.shuffle(data)
    return spark.createDataFrame(data, SHAPE).repartition(5)


def test_ranked_pages_equal_sorted_pages(spark, tmp_path):
    frames, path = recordings(spark), f"{tmp_path}/ranked store"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_ranked(frames, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    index = spark.read.parquet(f"{path}/index").orderBy("before").collect()
    order = page_frames(frames, 0, 3000).collect()
    assert len(index) == 4 and ranked_count(spark, path) == 3000
    for offset, size in ((0, 1), (-3, 10), (997, 7), (index[1].before - 2, 5), (index[1].before, index[1].rows), (0, 3000), (2990, 50), (3000, 5), (10**12, 5), (5, 0)):
        page = ranked_page(spark, path, offset, size)
        assert page.collect() == order[max(0, offset):max(0, offset) + max(1, size)]
        touched = [r for r in index if r.before < max(0, offset) + max(1, size) and r.before + r.rows > max(0, offset)]
        assert not touched or len(page.inputFiles()) == len(touched)
    page = ranked_page(spark, path, index[2].before + 3, 2)
    assert len(page.inputFiles()) == 1
    plan = page._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(__rank" in plan and "LessThanOrEqual(__rank" in plan.split("PushedFilters")[1]


def test_ranked_page_of_no_frames_and_of_frames_without_files(spark, tmp_path):
    write_ranked(recordings(spark).limit(0), f"{tmp_path}/none")
    assert ranked_count(spark, f"{tmp_path}/none") == 0 and ranked_page(spark, f"{tmp_path}/none", 3, 5).columns == ["source_file", "frame_index", "can_id", "ts_ns"]
    one = recordings(spark).where(F.col("source_file").startswith("log 1")).drop("source_file")
    write_ranked(one, f"{tmp_path}/one")
    assert [r.frame_index for r in ranked_page(spark, f"{tmp_path}/one", 400, 3).collect()] == [400, 401, 402]


def test_frames_of_an_id_lie_together(spark, tmp_path):
    frames, path = recordings(spark, 60_000), f"{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_by_id(frames, path, group_bytes=1 << 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = []
    for part in sorted((tmp_path / "ids").glob("part-*")):
        meta = pq.ParquetFile(part).metadata
        names = [meta.schema.column(c).name for c in range(meta.num_columns)]
        groups += [meta.row_group(g).column(names.index("can_id")).statistics for g in range(meta.num_row_groups)]
    holding = [g for g in groups if g.min <= 120 <= g.max]
    assert len(groups) >= 8 and len(holding) <= 2
    assert len([g for g in groups if g.min <= 5 <= g.max]) >= 2  # a frequent id is spread
    stored = spark.read.parquet(path)
    for args in ({"id_text": "120"}, {"id_text": "0x5", "time_start": 3.0, "time_end": 4.5}, {"id_text": "7"}):
        assert sorted(filter_frames(stored, **args).collect()) == sorted(filter_frames(frames, **args).collect())
    plan = filter_frames(stored, id_text="120")._jdf.queryExecution().toString()
    assert "EqualTo(can_id,120)" in plan


def test_export_without_frames(spark):
    samples = spark.createDataFrame([(0, 8, 8), (1, None, 3)], "frame_index long, dlc_code int, payload_length int")
    assert [tuple(r) for r in export_join(samples).orderBy("frame_index").collect()] == [(0, 8, 8), (1, 0, 3)]
    with pytest.raises(ValueError):
        export_join(samples.drop("dlc_code"))
