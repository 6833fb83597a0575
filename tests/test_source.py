import bz2
import gzip

import numpy as np
import pytest

from tests.volumes import header, volume
from voxlake import errors as E
from voxlake.sources.volume_file import open_volume, read_array
from voxlake.sources.volumetric import decode_binary, read_blocks, read_headers, read_voxels

VALUES = {
    0: [i - 16 for i in range(32)],
    1: [i * 7 - 100 for i in range(32)],
    2: [i * 1.25 for i in range(32)],
    3: [(i, -10 * i) for i in range(32)],
    4: [(i * 0.5, i * 1.5) for i in range(32)],
    6: [i * 2000 for i in range(32)],
    12: [i * 1.25 for i in range(32)],
    101: [i % 16 for i in range(32)],
}


def put(tmp_path, name, raw):
    p = tmp_path / name
    p.write_bytes(raw)
    return str(p)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("mode", list(VALUES))
def test_every_mode_and_order(tmp_path, mode, order):
    p = put(tmp_path, "v.vol", volume(4, 4, 2, mode, VALUES[mode], order))
    v = open_volume(p)
    assert v.header.endian == ("little" if order == "<" else "big") and not v.truncated
    box = v.raw_box((0, 0, 0), (4, 4, 2))
    flat = box.reshape(-1, 2).tolist() if mode in (3, 4) else box.reshape(-1).tolist()
    assert flat == [list(x) if isinstance(x, tuple) else x for x in VALUES[mode]]
    # odd offsets as well
    part = v.raw_box((1, 1, 1), (3, 2, 1))
    assert np.array_equal(part, box[1:2, 1:3, 1:4])


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress])
def test_compressed(spark, tmp_path, pack):
    p = put(tmp_path, "v.bin", pack(volume(8, 8, 4, 2, [float(i) for i in range(256)])))
    rows = read_voxels(spark, p).orderBy("z", "y", "x").collect()
    assert [r.value for r in rows] == [float(i) for i in range(256)]
    with pytest.raises(E.VolumeIOError):
        open_volume(p, limit=10)
    with pytest.raises(E.VolumeIOError):
        open_volume("x", content=b"\x1f\x8b\0")


def test_blocks_region_and_pushdown(spark, tmp_path):
    p = put(tmp_path, "v.vol", volume(10, 10, 10, 1, list(range(1000))))
    want = np.arange(1000).reshape(10, 10, 10)
    rows = read_blocks(spark, p, region="2,3,4,5,4,3").collect()
    assert len(rows) == 3 and all((r.ox, r.oy, r.sx, r.sy, r.sz) == (2, 3, 5, 4, 1) for r in rows)
    assert all(r.data == want[r.oz, 3:7, 2:7].ravel().tolist() for r in rows)
    got = read_voxels(spark, p).where("z >= 2 and z < 4 and y = 0 and x > 7").orderBy("z", "x").collect()
    assert [r.value for r in got] == [208, 209, 308, 309]
    assert read_blocks(spark, p, slab=4).orderBy("oz").select("oz", "sz").collect() == [(0, 4), (4, 4), (8, 2)]
    with pytest.raises(Exception, match="BoundsError|not inside"):
        read_blocks(spark, p, region="8,0,0,5,1,1").collect()
    with pytest.raises(Exception, match="ispg"):
        read_blocks(spark, p, stack="true").collect()


def test_value_types(spark, tmp_path):
    p = put(tmp_path, "c.vol", volume(2, 1, 1, 4, [(3.0, 4.0), (0.0, -2.0)]))
    for strategy, want in (("real", [3.0, 0.0]), ("imaginary", [4.0, -2.0]), ("magnitude", [5.0, 2.0])):
        assert [r.value for r in read_voxels(spark, p, valueType="float", complexStrategy=strategy).orderBy("x").collect()] == want
    f = put(tmp_path, "f.vol", volume(6, 1, 1, 2, [1.7, -1.7, 2.5, float("nan"), float("inf"), -1e9]))
    assert [r.value for r in read_voxels(spark, f, valueType="short").orderBy("x").collect()] == [1, -1, 2, 0, 32767, -32768]
    assert [r.value for r in read_voxels(spark, f, valueType="short", rounding="half_even").orderBy("x").collect()] == [2, -2, 2, 0, 32767, -32768]
    u = put(tmp_path, "u.vol", volume(5, 1, 1, 0, [-1, 0, 1, -128, 127]))
    assert [r.value for r in read_voxels(spark, u, m0="unsigned").orderBy("x").collect()] == [255, 0, 1, 128, 127]
    assert [r.value for r in read_voxels(spark, u, m0="unsigned", valueType="byte").orderBy("x").collect()] == [127, 0, 1, 127, 127]
    imod = bytes(56) + b"IMOD" + b"\0"
    s = put(tmp_path, "s.vol", volume(2, 1, 1, 0, [-1, 5], extra=imod))
    assert [r.value for r in read_voxels(spark, s, valueType="float").orderBy("x").collect()] == [255.0, 5.0]
    assert read_array(s, "float").tolist() == [[[255.0, 5.0]]]


def test_wrong_stamp_is_decoded_in_the_order_of_the_mode(tmp_path):
    p = put(tmp_path, "w.vol", volume(2, 2, 1, 2, [1.0, 2.0, 3.0, 4.0], ">", stamp=b"\x44\x44\0\0"))
    v = open_volume(p)
    assert v.header.endian == "big" and v.warnings and v.raw_box((0, 0, 0), (2, 2, 1)).ravel().tolist() == [1, 2, 3, 4]
    assert v.header.nversion == 20141


def test_strict_and_permissive(spark, tmp_path):
    good = volume(8, 8, 4, 2, [0.0] * 256)
    cases = {"zeros": (bytes(1024), E.InvalidHeader), "mode": (header(4, 4, 1, 99) + bytes(64), E.UnsupportedMode), "long": (good + bytes(16), E.FileSizeMismatch), "short": (good[:1124], E.FileSizeMismatch), "map": (volume(8, 8, 4, 2, [0.0] * 256, map=b"XYZ_"), E.InvalidHeaderDetailed), "tiny": (b"abc", E.InvalidHeader)}
    for name, (raw, kind) in cases.items():
        with pytest.raises(kind):
            open_volume(name, content=raw)
    assert open_volume("x", True, content=good[:1124]).truncated
    assert not open_volume("x", True, content=good + bytes(16)).truncated
    assert any("MAP" in w for w in open_volume("x", True, content=cases["map"][0]).warnings)
    assert open_volume("x", True, content=volume(4, 4, 1, 2, [0.0] * 16, nsymbt=-4, map=bytes(4))).warnings
    p = put(tmp_path, "t.vol", good[:1124])
    row = read_headers(spark, p, mode="PERMISSIVE").collect()[0]
    assert row.truncated and row.header.nx == 8 and row.compression == "plain"


def test_many_files_and_binary_column(spark, tmp_path):
    for k in range(3):
        put(tmp_path, f"{k}.vol", volume(2, 2, 2, 1, [k] * 8))
    assert read_voxels(spark, str(tmp_path)).groupBy("path").count().count() == 3
    rows = decode_binary(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(rows) == 6 and all(len(r.data) == 4 for r in rows)


def test_permissive_reports_unusable_files(spark, tmp_path):
    from voxlake.operators import tools
    from voxlake.operators.validate import roll_up

    put(tmp_path, "bad.vol", bytes(1024))
    put(tmp_path, "worse.vol", b"abc")
    put(tmp_path, "good.vol", volume(2, 2, 1, 2, [1.0, 2.0, 3.0, 4.0], dmin=1.0, dmax=4.0, dmean=2.5, rms=1.118))
    rows = {r.path.rsplit("/")[-1]: r for r in read_headers(spark, str(tmp_path), mode="PERMISSIVE").collect()}
    assert rows["bad.vol"].header is None and "InvalidDimensions" in rows["bad.vol"].warnings[0] and rows["good.vol"].header.nx == 2
    got = {r.path.rsplit("/")[-1]: r.is_valid for r in roll_up(tools.validate(spark, str(tmp_path))).collect()}
    assert got == {"bad.vol": False, "worse.vol": False, "good.vol": True}
    with pytest.raises(Exception, match="InvalidDimensions|header"):
        read_headers(spark, str(tmp_path)).collect()


def test_header_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from voxlake.functions import header as H

    imod = bytes(56) + b"IMOD" + bytes(4) + b"\1\0"
    p = put(tmp_path, "v.vol", volume(3, 2, 1, 0, [1, 2, 3, 4, 5, 6], extra=imod))
    h = read_headers(spark, p)
    row = h.select(H.header_tuples(F.col("header")).alias("t"), F.from_json(H.header_json(F.col("header")), H.HEADER_TYPE).alias("j"), "header", "imod", "m0_unsigned").first()
    assert row.t.sampling == [3, 2, 1] and row.j == row.header and row.imod.type == "Tilt" and row.m0_unsigned
