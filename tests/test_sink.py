import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake import errors as E
from voxlake.operators.validate import roll_up
from voxlake.operators import tools
from voxlake.sources.sink import VolumeBuilder, encode_volumes, expected_bytes, write_volume
from voxlake.sources.volume_file import open_volume, read_array
from voxlake.sources.volumetric import read_blocks


def planes(spark, array, kind="float", name="v"):
    nz, ny, nx = array.shape
    rows = [(name, 0, 0, z, nx, ny, 1, array[z].ravel().tolist()) for z in range(nz)]
    return spark.createDataFrame(rows, f"path string, ox int, oy int, oz int, sx int, sy int, sz int, data array<{kind}>")


@pytest.mark.parametrize("compression", ["none", "gzip", "bzip2"])
def test_round_trip_and_statistics(spark, tmp_path, compression):
    a = np.arange(16 * 8 * 4, dtype=np.float32).reshape(4, 8, 16)
    write_volume(planes(spark, a), str(tmp_path), VolumeBuilder((16, 8, 4), labels=("made here",)), compression)
    (p,) = [str(x) for x in tmp_path.iterdir() if not x.name.startswith((".", "_"))]
    v = open_volume(p)
    assert v.compression == {"none": "plain"}.get(compression, compression)
    assert np.array_equal(read_array(p), a)
    assert (v.header.dmin, v.header.dmax) == (0, 511) and v.header.dmean == pytest.approx(255.5) and v.header.rms == pytest.approx(a.std(), rel=1e-6)
    assert v.header.row()["labels"] == ["made here"]
    report = tools.validate(spark, p)
    assert roll_up(report).collect()[0].is_valid


@pytest.mark.parametrize(("mode", "values"), [(0, [-300.0, -5.7, 5.7, 300.0]), (1, [-4e4, -1.5, 1.5, 4e4]), (6, [-1.0, 1.9, 65535.0, 7e4]), (12, [0.1, 1.0, 65504.0, -2.5])])
def test_float_blocks_are_converted(spark, tmp_path, mode, values):
    a = np.array(values, np.float32).reshape(1, 2, 2)
    write_volume(planes(spark, a), str(tmp_path), VolumeBuilder((2, 2, 1), mode))
    got = read_array(str(tmp_path / "v.vol")).ravel().tolist()
    want = {0: [-128, -5, 5, 127], 1: [-32768, -1, 1, 32767], 6: [0, 1, 65535, 65535], 12: np.array(values, np.float16).astype(float).tolist()}[mode]
    assert got == want


def test_packed_odd_rows_partial_blocks_and_errors(spark, tmp_path):
    a = (np.arange(30) % 16).reshape(2, 3, 5)
    write_volume(planes(spark, a, "tinyint"), str(tmp_path / "p"), VolumeBuilder((5, 3, 2), 101))
    p = str(tmp_path / "p" / "v.vol")
    assert np.array_equal(read_array(p), a) and len(open(p, "rb").read()) == 1024 + 3 * 6 == expected_bytes(VolumeBuilder((5, 3, 2), 101))
    with pytest.raises(Exception, match="packed voxels"):
        write_volume(planes(spark, a + 1, "tinyint"), str(tmp_path / "q"), VolumeBuilder((5, 3, 2), 101))
    rows = spark.createDataFrame([("v", 1, 1, 0, 2, 1, 2, [1.0, 2.0, 3.0, 4.0])], "path string, ox int, oy int, oz int, sx int, sy int, sz int, data array<float>")
    write_volume(rows, str(tmp_path / "r"), VolumeBuilder((4, 3, 3)))
    got = read_array(str(tmp_path / "r" / "v.vol"))
    assert got.sum() == 10 and got[1, 1].tolist() == [0, 3, 4, 0]
    with pytest.raises(Exception, match="not inside"):
        write_volume(rows, str(tmp_path / "s"), VolumeBuilder((2, 3, 3)))
    with pytest.raises(Exception, match="values for"):
        write_volume(rows.withColumn("sx", F.lit(3)), str(tmp_path / "t"), VolumeBuilder((5, 3, 3)))
    with pytest.raises(E.InvalidHeaderDetailed):
        VolumeBuilder((4, 4, 5)).volume_stack(3).build()


def test_complex_and_stack(spark, tmp_path):
    rows = [("c", 0, 0, z, 2, 1, 1, [(float(z), 1.0), (2.0, -1.0)]) for z in range(4)]
    df = spark.createDataFrame(rows, "path string, ox int, oy int, oz int, sx int, sy int, sz int, data array<struct<re:float,im:float>>")
    write_volume(df, str(tmp_path), VolumeBuilder((2, 1, 4), 4).volume_stack(2))
    p = str(tmp_path / "c.vol")
    h = open_volume(p).header
    assert (h.dmin, h.dmax, h.dmean) == (0, -1, -2) and h.rms > 0 and h.ispg == 401
    assert read_blocks(spark, p, stack="true").count() == 2
    assert roll_up(tools.validate(spark, p)).collect()[0].is_valid
    with pytest.raises(Exception, match="complex voxels"):
        write_volume(df, str(tmp_path / "x"), VolumeBuilder((2, 1, 4), 2))


def test_several_files_in_memory_and_tools(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(3, 2, 4)
    both = planes(spark, a, name="a").unionByName(planes(spark, a * 2, name="b"))
    write_volume(both, str(tmp_path / "in"), VolumeBuilder((4, 2, 3)), mode="overwrite")
    assert {x.name for x in (tmp_path / "in").iterdir()} == {"a.vol", "b.vol"}
    content = {r.path: bytes(r.content) for r in encode_volumes(both, VolumeBuilder((4, 2, 3))).collect()}
    assert content["a"] == (tmp_path / "in" / "a.vol").read_bytes()
    assert np.array_equal(open_volume("b", content=gzip.compress(content["b"])).raw_box((0, 0, 0), (4, 2, 3)), a * 2)
    p = str(tmp_path / "in" / "a.vol")
    tools.crop(spark, p, (1, 0, 1), (2, 2, 2), str(tmp_path / "crop"))
    assert np.array_equal(read_array(str(tmp_path / "crop" / "a.vol")), a[1:3, 0:2, 1:3])
    tools.unstack(spark, p, str(tmp_path / "un"), 4, 2)
    assert np.array_equal(read_array(str(tmp_path / "un" / "a-2.vol"))[0], a[2])
    assert tools.stats(spark, p).collect()[0].dmax == 23
    assert tools.rescale_down(spark, p, 2).count() == 4
    assert tools.info(spark, p).collect()[0].kind == "volume"
    assert tools.one_slice(spark, p, 1).count() == 8


def test_statistics_mismatch_and_nonfinite_are_reported(spark, tmp_path):
    from tests.volumes import volume

    (tmp_path / "m.vol").write_bytes(volume(2, 2, 1, 2, [1.0, 2.0, float("nan"), float("inf")], dmin=5.0, dmax=9.0, dmean=6.0))
    got = {(r.severity, r.category) for r in tools.validate(spark, str(tmp_path)).collect()}
    assert ("Error", "Statistics") in got and ("Warning", "Data integrity") in got
    (tmp_path / "m.vol").write_bytes(volume(2, 2, 1, 2, [1.0, 2.0, 3.0, 4.0], map=b"XYZ_"))
    rows = tools.validate(spark, str(tmp_path)).collect()
    assert any(r.severity == "Error" and r.category == "Header" for r in rows) and any(r.category == "Open" for r in rows)


def test_sections_are_written_by_many_tasks(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(23, 4, 6)).astype(np.float32)
    a[5:9], a[22] = 0, 0  # sections without a block
    rows = planes(spark, a).where("oz not between 5 and 8 and oz < 22").repartition(5)
    for compression, ending in (("none", ""), ("gzip", ".gz"), ("bzip2", ".bz2")):
        folder = tmp_path / compression
        write_volume(rows, str(folder), VolumeBuilder((6, 4, 23)), compression, sections_per_part=4)
        assert [x.name for x in folder.iterdir()] == [f"v.vol{ending}"]
        v = open_volume(str(folder / f"v.vol{ending}"))
        assert np.array_equal(v.raw_box((0, 0, 0), (6, 4, 23)), a)
        assert v.header.dmean == pytest.approx(a.mean(), abs=1e-6) and v.header.rms == pytest.approx(a.std(), rel=1e-6) and v.header.dmin == a.min()
    # blocks of several sections, and boxes beside each other, that go over the parts' edges
    boxes = [("w", 3 * i, 0, 0, 3, 4, 23, a[:, :, 3 * i : 3 * i + 3].ravel().tolist()) for i in (0, 1)]
    df = spark.createDataFrame(boxes, rows.schema)
    write_volume(df, str(tmp_path / "boxes"), VolumeBuilder((6, 4, 23)), sections_per_part=5)
    assert np.array_equal(read_array(str(tmp_path / "boxes" / "w.vol")), a)
    assert bytes(encode_volumes(df, VolumeBuilder((6, 4, 23))).collect()[0].content) == (tmp_path / "boxes" / "w.vol").read_bytes()


def test_parts_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from voxlake.sources.sink import VolumeWriter, by_section

    seen = []
    old = VolumeWriter._join
    monkeypatch.setattr(VolumeWriter, "_join", lambda self, fs, name, parts: (seen.extend(parts), old(self, fs, name, parts)))
    a = np.arange(40 * 6, dtype=np.float32).reshape(40, 2, 3)
    rows = by_section(planes(spark, a)).repartition(4, F.floor(F.col("oz") / 5)).sortWithinPartitions("oz")
    pids = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    rows.write.format("volumetric").options(**VolumeBuilder((3, 2, 40)).options(), sectionsPerPart="5").mode("append").save(str(tmp_path))
    assert pids > 2 and np.array_equal(read_array(str(tmp_path / "v.vol")), a)


@pytest.mark.parametrize(
    ("kind", "mode", "value", "error"),
    [
        ("smallint", 2, 1, "ModeMismatch"), ("int", 1, 70000, "ModeMismatch"), ("int", 6, 70000, "ValueOutOfRange"), ("smallint", 6, 256, "ValueOutOfRange"), ("float", 101, 1.0, "UnsupportedMode"),
        ("float", 4, 1.0, "ModeMismatch"), ("smallint", 0, 1, "ModeMismatch"), ("tinyint", 101, 16, "ValueOutOfRange"),
    ],
)
def test_voxels_of_another_type_are_refused(spark, tmp_path, kind, mode, value, error):
    rows = spark.createDataFrame([("v", 0, 0, 0, 1, 1, 1, [value])], f"path string, ox int, oy int, oz int, sx int, sy int, sz int, data array<{kind}>")
    with pytest.raises(Exception, match=error):
        write_volume(rows, str(tmp_path), VolumeBuilder((1, 1, 1), mode))
    assert not list(tmp_path.glob("*.vol"))


def test_conversion_by_option_and_u8(spark, tmp_path):
    rows = spark.createDataFrame([("v", 0, 0, 0, 2, 1, 1, [70000, -3])], "path string, ox int, oy int, oz int, sx int, sy int, sz int, data array<int>")
    write_volume(rows, str(tmp_path / "c"), VolumeBuilder((2, 1, 1), 1), convert=True)
    assert read_array(str(tmp_path / "c" / "v.vol")).ravel().tolist() == [32767, -3]
    rows = rows.withColumn("data", F.array(F.lit(255), F.lit(0)).cast("array<smallint>"))
    write_volume(rows, str(tmp_path / "u"), VolumeBuilder((2, 1, 1), 6))
    assert read_array(str(tmp_path / "u" / "v.vol"), "ubyte").ravel().tolist() == [255, 0]


def test_header_settings_and_tools(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 2, 2)
    b = VolumeBuilder((2, 2, 3), labels=("one", "two"), extended_header=b"abc").big_endian().header_fields(creatid=7, origin=(1.0, 2.0, 3.0)) if "creatid" in VolumeBuilder((1, 1, 1)).build().values else VolumeBuilder((2, 2, 3), labels=("one", "two"), extended_header=b"abc").big_endian().header_fields(origin=(1.0, 2.0, 3.0))
    write_volume(planes(spark, a), str(tmp_path / "b"), b)
    v = open_volume(str(tmp_path / "b" / "v.vol"))
    assert v.header.endian == "big" and v.header.standard_stamp and v.header.nversion == 20141 and v.extended_header() == b"abc"
    assert v.header.origin == (1.0, 2.0, 3.0) and np.array_equal(read_array(v.path), a)
    with pytest.raises(E.InvalidHeader):
        VolumeBuilder((2, 2, 2)).header_fields(nx=4)
    tools.convert(spark, str(tmp_path / "b"), str(tmp_path / "i"), 1, "gzip")
    w = open_volume(str(tmp_path / "i" / "v.vol.gz"))
    assert w.header.mode == 1 and w.header.origin == (1.0, 2.0, 3.0) and np.array_equal(w.raw_box((0, 0, 0), (2, 2, 3)), a)
    named = {r.field: r.value for r in tools.header(spark, str(tmp_path / "b")).collect()}
    assert named["nx"] == "2" and named["mode"] == "2"
    tools.check_stats(spark, str(tmp_path / "b"))
    from tests.volumes import volume

    (tmp_path / "bad.vol").write_bytes(volume(2, 1, 1, 2, [1.0, 2.0], dmin=5.0, dmax=9.0, dmean=6.0, rms=0.5))
    with pytest.raises(E.StatsMismatch, match="dmin, dmax"):
        tools.check_stats(spark, str(tmp_path / "bad.vol"))


def test_folder_of_several_modes(spark, tmp_path):
    from tests.volumes import volume

    (tmp_path / "a.vol").write_bytes(volume(2, 1, 1, 1, [1, -2]))
    (tmp_path / "b.vol").write_bytes(volume(2, 1, 1, 2, [1.75, 100000.0]))
    (tmp_path / "c.vol").write_bytes(volume(2, 1, 1, 3, [(3, 4), (0, 1)]))
    with pytest.raises(Exception, match="TypeMismatch|name a valueType"):
        read_blocks(spark, str(tmp_path)).collect()
    got = {r.path[-5]: list(r.data) for r in read_blocks(spark, str(tmp_path), valueType="float").collect()}
    assert got == {"a": [1.0, -2.0], "b": [1.75, 100000.0], "c": [5.0, 1.0]}
    assert read_blocks(spark, str(tmp_path), modes="3").collect()[0].data[0].re == 3
    assert read_blocks(spark, str(tmp_path), modes="12").count() == 0
    with pytest.raises(Exception, match="ValueOutOfRange|ModeMismatch"):
        read_blocks(spark, str(tmp_path / "a.vol"), valueType="ubyte").collect()
    (tmp_path / "d.vol").write_bytes(volume(2, 1, 1, 6, [256, 1]))
    with pytest.raises(Exception, match="more than 255"):
        read_blocks(spark, str(tmp_path / "d.vol"), valueType="ubyte").collect()
    report = roll_up(tools.validate(spark, str(tmp_path))).collect()
    assert len(report) == 4 and all(r.n_error == 0 for r in report)
