"""Queries through files over embeddings that fill neither the last section nor the last sub-volume."""

import duckdb
import pytest

from tests.test_queries import SF, rows
from voxlake.plans import catalogue

TABLES = {
    "one row more": "FROM e UNION ALL SELECT vec_id + 500, embedding, label FROM e WHERE vec_id < 1",
    "rows and numbers missing": "SELECT vec_id, CASE WHEN vec_id = 213 THEN NULL WHEN vec_id % 71 = 3 THEN embedding[1:40] ELSE embedding END AS embedding, label FROM e WHERE vec_id % 17 <> 4 AND vec_id NOT BETWEEN 200 AND 212",
}
NAMES = [
    "file_block_pushdown",
    "file_gzip_subvolume_stats",
    "file_header_stats",
    "file_header_tuples",
    "file_pushdown",
    "file_recompressed",
    "file_region",
    "file_slice_stats",
    "file_validation",
]


@pytest.fixture(scope="module", params=TABLES)
def table(request, tmp_path_factory):
    folder, duck = tmp_path_factory.mktemp("sf"), duckdb.connect()
    duck.execute(f"CREATE VIEW e AS FROM '{SF}/embeddings.parquet'")
    duck.execute(f"COPY ({TABLES[request.param]}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    return str(folder), duck


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, table, name):
    folder, duck = table
    ours, sql = catalogue.QUERIES[name](spark, folder).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


def test_statistics_of_blocks_leave_filling_out(spark, tmp_path):
    from voxlake.sources.sink import VolumeBuilder, write_volume
    from voxlake.sources.volume_file import open_volume

    at = [("v", 1, 1, z, 2, 1, 1, [3.0 + z, 5.0 + z]) for z in (1, 4)]
    blocks = spark.createDataFrame(at, "path string, ox int, oy int, oz int, sx int, sy int, sz int, data array<float>")
    for statistics, low, mean in (("blocks", 4.0, 6.5), ("file", 0.0, 26 / 96)):
        write_volume(blocks, str(tmp_path / statistics), VolumeBuilder((4, 4, 6)), statistics=statistics, sections_per_part=4)
        h = open_volume(str(tmp_path / statistics / "v.vol")).header
        assert (h.dmin, h.dmax) == (low, 9.0) and h.dmean == pytest.approx(mean)
