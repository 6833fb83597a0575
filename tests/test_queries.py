"""Every registered volume query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from voxlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "-"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 9) + 0.0)
        return str(bool(v)) if isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, sql = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


def test_half_floats_equal_numpy(spark):
    got = catalogue.QUERIES["f32_to_f16"](spark, SF).toPandas().sort_values("idx")["v"].to_numpy()
    want = duckdb.sql(f"SELECT value FROM '{SF}/events.parquet' ORDER BY event_id").df()["value"].to_numpy()
    assert np.array_equal(got, want.astype(np.float32).astype(np.float16).astype(np.float32))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_filter_reaches_the_scan(spark, tmp_path):
    from tests.volumes import volume
    from voxlake.sources.volumetric import VolumeReader, VolumetricSource
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    p = tmp_path / "v.vol"
    p.write_bytes(volume(4, 4, 8, 2, [float(i) for i in range(128)]))
    source = VolumetricSource({"path": str(p), "content": "voxels"})
    reader = VolumeReader(source.schema(), {"path": str(p), "content": "voxels"})
    kept = list(reader.pushFilters([GreaterThanOrEqual(("z",), 3), LessThan(("z",), 5), EqualTo(("y",), 2)]))
    parts = reader.partitions()
    assert len(kept) == 3 and (parts[0].z0, parts[-1].z1) == (3, 5)
    assert sum(b.num_rows for q in parts for b in reader.read(q)) == 2 * 4


def test_block_filter_reaches_the_scan(tmp_path):
    from tests.volumes import volume
    from voxlake.sources.volumetric import VolumeReader, VolumetricSource
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

    p = tmp_path / "v.vol"
    p.write_bytes(volume(4, 4, 9, 2, [float(i) for i in range(144)]))

    def planned(filters, **options):
        o = {"path": str(p), "content": "blocks", **options}
        reader = VolumeReader(VolumetricSource(o).schema(), o)
        list(reader.pushFilters(filters))
        return sorted(z for q in reader.partitions() for b in reader.read(q) for z in b.column(3).to_pylist())

    assert planned([GreaterThanOrEqual(("oz",), 3), LessThan(("oz",), 5)]) == [3, 4]
    assert planned([GreaterThan(("oz",), 3)], slab="4") == [4, 8] and planned([LessThan(("oz",), 5)], slab="4") == [0, 4]
    assert planned([EqualTo(("ox",), 1)]) == [] and len(planned([EqualTo(("ox",), 0)])) == 9
