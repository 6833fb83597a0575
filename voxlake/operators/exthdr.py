"""Extended-header records: one row a section. A header with a bad record, or of no whole number of them, has none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.session import ship

SIZES = {"CCP4": 80, "MRCO": 80, "SERI": 256, "AGAR": 1024, "FEI1": 768, "FEI2": 888}

#: Fixed layout of the FEI records (name, type, offset): u/i 32-bit, q 64-bit, d double, b one byte, s 16 characters; big-endian but for bitmask_1.
FEI1_FIELDS = [
    ("metadata_size", "u", 0),
    ("metadata_version", "u", 4),
    ("bitmask_1", "l", 8),
    ("timestamp", "d", 12),
    ("microscope_type", "s", 20),
    ("ht", "d", 84),
    ("dose", "d", 92),
    ("alpha_tilt", "d", 100),
    ("beta_tilt", "d", 108),
    ("x_stage", "d", 116),
    ("y_stage", "d", 124),
    ("z_stage", "d", 132),
    ("tilt_axis_angle", "d", 140),
    ("pixel_size_x", "d", 156),
    ("pixel_size_y", "d", 164),
    ("defocus", "d", 220),
    ("stem_defocus", "d", 228),
    ("applied_defocus", "d", 236),
    ("magnification", "d", 289),
    ("camera_length", "d", 301),
    ("spot_index", "i", 309),
    ("illuminated_area", "d", 313),
    ("intensity", "d", 321),
    ("convergence_angle", "d", 329),
    ("slit_width", "d", 355),
    ("shift_offset_x", "d", 387),
    ("shift_offset_y", "d", 395),
    ("shift_x", "d", 403),
    ("shift_y", "d", 411),
    ("integration_time", "d", 419),
    ("binning_width", "i", 427),
    ("binning_height", "i", 431),
    ("camera_name", "s", 435),
    ("readout_area_left", "i", 451),
    ("readout_area_top", "i", 455),
    ("readout_area_right", "i", 459),
    ("readout_area_bottom", "i", 463),
    ("ceta_frames_summed", "i", 468),
    ("phase_plate", "b", 518),
    ("gain", "d", 535),
    ("offset", "d", 543),
    ("dwell_time", "d", 571),
    ("frame_time", "d", 579),
    ("full_scan_fov_x", "d", 603),
    ("full_scan_fov_y", "d", 611),
    ("is_dose_fraction", "b", 655),
    ("fraction_number", "i", 656),
    ("start_frame", "i", 660),
    ("end_frame", "i", 664),
    ("alpha_tilt_min", "d", 752),
    ("alpha_tilt_max", "d", 760),
]
FEI2_FIELDS = [
    ("scan_rotation", "d", 768),
    ("diffraction_pattern_rotation", "d", 776),
    ("image_rotation", "d", 784),
    ("scan_mode_enumeration", "i", 792),
    ("acquisition_time_stamp", "q", 796),
    ("detector_commercial_name", "s", 804),
    ("start_tilt_angle", "d", 820),
    ("end_tilt_angle", "d", 828),
    ("tilt_per_image", "d", 836),
    ("tilt_speed", "d", 844),
    ("beam_center_x_pixel", "i", 852),
    ("beam_center_y_pixel", "i", 856),
    ("cfeg_flash_timestamp", "q", 860),
    ("phase_plate_position_index", "i", 868),
    ("objective_aperture_name", "s", 872),
]
_NUMPY = {"u": ">u4", "l": "<u4", "i": ">i4", "q": ">i8", "d": ">f8", "b": "u1", "s": "V16"}
_SPARK = {"u": T.LongType(), "l": T.LongType(), "i": T.IntegerType(), "q": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "s": T.StringType()}


FEI = {"FEI1": FEI1_FIELDS, "FEI2": FEI1_FIELDS + FEI2_FIELDS}


def fei_dtype(kind: str) -> np.dtype:
    f = FEI[kind]
    return np.dtype({"names": [n for n, _, _ in f], "formats": [_NUMPY[k] for _, k, _ in f], "offsets": [at for _, _, at in f], "itemsize": SIZES[kind]})


def split_records(raw: bytes | None, kind: str) -> list[bytes] | None:
    """The records of a header of this kind; None for none, or a length that does not fit."""
    size = SIZES.get(kind)
    if not size or not raw or len(raw) % size:
        return None
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def parse_fei(raw: bytes | None, kind: str) -> list[dict] | None:
    """Fields of FEI records; None if any record's own size is not the kind's."""
    if split_records(raw, kind) is None:
        return None
    rows = np.frombuffer(raw, dtype=fei_dtype(kind))
    if np.any(rows["metadata_size"] != SIZES[kind]):
        return None
    out = []
    for r in rows:
        row = {}
        for n, k, _ in FEI[kind]:
            v = r[n]
            row[n] = bytes(v.tobytes()).strip(b"\0 ").decode("utf-8", "replace") if k == "s" else (bool(v) if k == "b" else v.item())
        out.append(row)
    return out


def record_schema(kind: str) -> T.StructType:
    head = [T.StructField("path", T.StringType()), T.StructField("section", T.IntegerType())]
    if kind in FEI:
        return T.StructType(head + [T.StructField(n, _SPARK[k]) for n, k, _ in FEI[kind]])
    extra = {"CCP4": [T.StructField("text", T.StringType())], "SERI": [T.StructField("alpha_tilt", T.FloatType())]}.get(kind, [])
    return T.StructType([*head, *extra, T.StructField("raw", T.BinaryType())])


def parse_records(raw: bytes | None, kind: str) -> list[dict] | None:
    """Records of any known kind as dictionaries of ``record_schema``'s fields; None where the kind is unknown."""
    if kind in FEI:
        return parse_fei(raw, kind)
    records = split_records(raw, kind)
    if records is None:
        return None
    out = []
    for r in records:
        row: dict = {"raw": r}
        if kind == "CCP4":
            row["text"] = r.decode("utf-8", "replace").strip(" ")
        elif kind == "SERI":
            row["alpha_tilt"] = float(np.frombuffer(r, "<f4", 1)[0])
        out.append(row)
    return out


def extended_records(volumes: DataFrame, kind: str, path: str = "path", exttyp: str = "exttyp", raw: str = "ext_header") -> DataFrame:
    """(path, section, fields) of the volumes whose EXTTYP is ``kind``; others give no rows."""
    schema = record_schema(kind)
    ship(volumes.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{"path": p, "section": i} | r for i, r in enumerate(parse_records(data, kind) or [])]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    mine = volumes.where(F.col(exttyp) == kind).select(F.col(path).alias("path"), F.col(raw).alias("raw"))
    return mine.mapInArrow(each, schema)


def with_section_metadata(sections: DataFrame, records: DataFrame, keys: list[str], broadcast_rows: int = 500_000) -> DataFrame:
    """Attach each section's record (left join). Records are broadcast below a checked number, else joined by shuffle."""
    small = records.limit(broadcast_rows + 1).count() <= broadcast_rows
    return sections.join(F.broadcast(records) if small else records, keys, "left")
