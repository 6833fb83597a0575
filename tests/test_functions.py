import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.volumes import header
from voxlake import errors as E
from voxlake.functions import convert as C
from voxlake.functions import header as H
from voxlake.functions import modes as M
from voxlake.operators import exthdr as X
from voxlake.operators import regions as R
from voxlake.operators import stats as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_fractions_and_nonfinite_values(spark):
    v = [0.5, 1.5, 2.5, -0.5, -1.5, 1.7, -1.7, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    got = df.orderBy("i").select(C.float_to_i16(F.col("v")), C.float_to_i16(F.col("v"), "half_even"), C.float_to_u16(F.col("v")), C.float_to_i8(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 0, -1, 1, -1, 0, 32767, -32768, None]
    assert [r[1] for r in got] == [0, 2, 2, 0, -2, 2, -2, 0, 32767, -32768, None]
    assert [r[2] for r in got][8:10] == [65535, 0] and [r[3] for r in got][8:10] == [127, -128]
    half = df.select(C.float_to_f16(F.col("v").cast("float")).alias("h")).toPandas()["h"].to_numpy()
    assert np.array_equal(half[:7], np.array(v[:7], np.float16).astype(np.float32))


def test_nibbles_complex_bytes(spark):
    assert one(spark, *C.nibbles(F.lit(0x21)), C.pack_nibbles(F.lit(1), F.lit(2)), C.pack_nibbles(F.lit(3), F.lit(None).cast("int"))) == (1, 2, 0x21, 3)
    with pytest.raises(Exception, match="ValueOutOfRange"):
        one(spark, C.pack_nibbles(F.lit(16), F.lit(0)))
    with pytest.raises(Exception, match="ValueOutOfRange"):
        one(spark, C.u16_to_u8(F.lit(256)))
    assert one(spark, C.u16_to_u8(F.lit(256), checked=False)) == (None,)
    got = one(spark, *(C.complex_to_real(F.lit(3), F.lit(4), s) for s in ("real", "imaginary", "magnitude", "phase")))
    assert got[:3] == (3.0, 4.0, 5.0) and got[3] == pytest.approx(0.9272952)
    raw = F.lit(bytearray(struct.pack("<hh", -2, 300)))
    assert one(spark, C.stored_int(raw, F.lit(0), 2, "little", True), C.stored_int(raw, F.lit(1), 2, "little", False)) == (-2, 300)
    df = spark.createDataFrame([(bytearray(b"\1\2\3\4"), 2)], "r binary, w int")
    assert bytes(df.select(C.swap_bytes("r", "w")).first()[0]) == b"\2\1\4\3"
    assert one(spark, C.over_block(F.array(F.lit(1.9), F.lit(-1.9)), C.float_to_i8))[0] == [1, -1]


def test_header_codec_and_labels():
    h = H.decode_header(header(64, 32, 16, 2, labels=b"one".ljust(80) + b"two\0".ljust(80), nlabl=2, exttyp=b"FEI1"))
    assert (h.nx, h.ny, h.nz, h.exttyp, h.nversion) == (64, 32, 16, b"FEI1", 20141) and h.row()["labels"] == ["one", "two\0"]
    assert H.decode_header(H.encode_header(h)).values == h.values
    big = H.decode_header(header(64, 32, 16, 2, ">"))
    assert big.endian == "big" and big.nx == 64 and H.encode_header(big) == header(64, 32, 16, 2, ">")
    assert H.stamp_endian(b"\x44\x41\0\0") == ("little", False)
    n = H.new_header(4, 4, 4)
    for k in range(12):
        n = H.add_label(n, f"label {k}\t")
    assert n.nlabl == 10 and H.label_list(n.labels, 10)[0] == "label 2" and H.label_list(n.labels, 10)[9] == "label 11"


def test_imod():
    extra = bytearray(100)
    extra[56:60], extra[60] = b"IMOD", 1
    extra[64:66], extra[68:70], extra[72:74], extra[74:76] = struct.pack("<h", 1), struct.pack("<h", 9), struct.pack("<h", 150), struct.pack("<h", -6000)
    h = H.decode_header(header(4, 4, 4, 0, extra=bytes(extra)))
    m = H.imod_fields(h)
    assert (m["type"], m["tilt_axis"], m["tilt_increment"], m["start_angle"]) == ("Tilt", 3, 1.5, -60.0) and not h.imod_unsigned()
    assert H.imod_fields(H.new_header()) is None


def test_mode_tables(spark):
    assert M.data_bytes(3, 2, 1, M.mode_of(101)) == 4 and M.data_bytes(-3, 2, 1, M.mode_of(2)) == 0
    with pytest.raises(E.UnsupportedMode):
        M.mode_of(5)
    assert one(spark, M.mode_byte_size(F.lit(5)), M.data_size(F.lit(2**31 - 1), F.lit(2**31 - 1), F.lit(2**31 - 1), F.lit(4))) == (None, None)


def test_geometry_helpers():
    s = R.Shape(10, 8, 6)
    assert s.total == 480 and s.linear(1, 2, 3) == 1 + 20 + 240 and s.linear(10, 0, 0) is None and s.is_full((0, 0, 0), (10, 8, 6))
    with pytest.raises(E.BoundsError):
        s.check((5, 0, 0), (6, 1, 1))
    with pytest.raises(E.BlockShapeMismatch):
        R.check_block((2, 2, 2), 5)
    assert R.region_counts(R.Shape(8, 4, 6), 2, (4, 4, 2), 3) == {"n_slices": 6, "n_slabs": 3, "n_tiles": 6, "n_volumes": 2}


def test_stats_merge_and_empty(spark):
    r = np.random.default_rng(1).normal(size=1000)
    parts = [(len(c), c.min(), c.max(), c.mean(), ((c - c.mean()) ** 2).sum()) for c in np.array_split(r, 7)]
    n, low, high, mean, m2 = S.merge_moments(parts)
    assert (n, low, high) == (1000, r.min(), r.max()) and mean == pytest.approx(r.mean()) and np.sqrt(m2 / n) == pytest.approx(r.std())
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "value double")
    assert tuple(df.agg(*S.density_stats(F.col("value"))).first())[1:] == (1.0, 4.0, 2.5, pytest.approx(1.118034))
    assert one(spark, S.is_close(F.lit(100.0), F.lit(100.5)), S.is_close(F.lit(100.0), F.lit(102.0))) == (True, False)


def fei(kind, **fields):
    raw = bytearray(X.SIZES[kind])
    layout = {n: (k, at) for n, k, at in X.FEI[kind]}
    for n, v in ({"metadata_size": X.SIZES[kind]} | fields).items():
        k, at = layout[n]
        part = v.encode() if k == "s" else struct.pack({"u": ">I", "l": "<I", "i": ">i", "q": ">q", "d": ">d", "b": "?"}[k], v)
        raw[at : at + len(part)] = part
    return bytes(raw)


def test_extended_headers(spark):
    one_ = fei("FEI1", metadata_version=1, bitmask_1=42, timestamp=123456.789, ht=300000.0, alpha_tilt=-35.5, spot_index=7, camera_name="Falcon 4", phase_plate=True, gain=2.5)
    two = fei("FEI2", scan_rotation=90.0, acquisition_time_stamp=1234567890, detector_commercial_name="Falcon 4i")
    rows = [("a", "FEI1", one_ * 2), ("b", "FEI2", two), ("c", "FEI1", fei("FEI1", metadata_size=999)), ("d", "FEI2", one_), ("e", "CCP4", b"X,Y,Z".ljust(80) * 3), ("f", "CCP4", bytes(81)), ("g", "SERI", struct.pack("<f", -35.5) + bytes([99]) + bytes(251)), ("h", "MRCO", bytes([42]) * 80), ("i", "AGAR", bytes([77]) * 1024), ("j", "HDF5", b"x")]
    df = spark.createDataFrame([(p, k, bytearray(r)) for p, k, r in rows], "path string, exttyp string, ext_header binary")
    got = X.extended_records(df, "FEI1").orderBy("section").collect()
    assert [(r.path, r.section, r.bitmask_1, r.timestamp, r.alpha_tilt, r.spot_index, r.camera_name, r.phase_plate) for r in got] == [("a", k, 42, 123456.789, -35.5, 7, "Falcon 4", True) for k in (0, 1)]
    got = X.extended_records(df, "FEI2").collect()
    assert [(r.path, r.scan_rotation, r.acquisition_time_stamp, r.detector_commercial_name) for r in got] == [("b", 90.0, 1234567890, "Falcon 4i")]
    assert [r.text for r in X.extended_records(df, "CCP4").collect()] == ["X,Y,Z"] * 3
    assert X.extended_records(df, "SERI").first().alpha_tilt == -35.5
    assert X.extended_records(df, "MRCO").count() == 1 and X.extended_records(df, "AGAR").count() == 1
    assert X.parse_records(b"x", "HDF5") is None


def test_landing_stream(spark, tmp_path):
    from tests.volumes import volume
    from voxlake.streaming.landing import landing_blocks, run_available, section_means

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vol").write_bytes(volume(2, 2, 2, 2, [1.0] * 4 + [3.0] * 4))
    run_available(section_means(landing_blocks(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in" / "b.vol").write_bytes(volume(2, 2, 1, 2, [7.0] * 4))
    run_available(section_means(landing_blocks(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["mean"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 3.0, 7.0]
