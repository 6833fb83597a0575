"""Volume files built by hand with struct, so that reader and writer are not tested against each other alone."""

import struct

import numpy as np


def header(nx, ny, nz, mode, order="<", stamp=None, **words):
    w = {"mx": nx, "my": ny, "mz": nz, "ispg": 1, "nsymbt": 0, "map": b"MAP ", "nversion": 20141, "nlabl": 0, "mapc": 1, "mapr": 2, "maps": 3, "dmin": 0.0, "dmax": -1.0, "dmean": -2.0, "rms": -1.0, "xlen": 1.0, "extra": b"", "labels": b""} | words
    extra = bytearray(w["extra"].ljust(100, b"\0"))
    extra[12:16] = struct.pack(order + "i", w["nversion"])
    if "exttyp" in w:
        extra[8:12] = w["exttyp"]
    raw = struct.pack(order + "10i", nx, ny, nz, mode, 0, 0, 0, w["mx"], w["my"], w["mz"])
    raw += struct.pack(order + "6f", w["xlen"], 1.0, 1.0, 90.0, 90.0, 90.0) + struct.pack(order + "3i", w["mapc"], w["mapr"], w["maps"])
    raw += struct.pack(order + "3f", w["dmin"], w["dmax"], w["dmean"]) + struct.pack(order + "2i", w["ispg"], w["nsymbt"]) + bytes(extra)
    raw += struct.pack(order + "3f", 0, 0, 0) + w["map"] + (stamp or (b"\x44\x44\0\0" if order == "<" else b"\x11\x11\0\0"))
    raw += struct.pack(order + "f", w["rms"]) + struct.pack(order + "i", w["nlabl"]) + w["labels"].ljust(800, b"\0")
    assert len(raw) == 1024
    return raw


FORMATS = {0: "b", 1: "h", 2: "f", 6: "H", 12: "e"}


def volume(nx, ny, nz, mode, values, order="<", ext=b"", **words):
    head = header(nx, ny, nz, mode, order, nsymbt=words.pop("nsymbt", len(ext)), **words)
    if mode == 101:
        rows = np.array(values).reshape(-1, nx)
        body = b"".join(bytes(int(r[i]) | (int(r[i + 1]) << 4 if i + 1 < nx else 0) for i in range(0, nx, 2)) for r in rows)
    elif mode in (3, 4):
        body = b"".join(struct.pack(order + ("2h" if mode == 3 else "2f"), a, b) for a, b in values)
    else:
        body = struct.pack(f"{order}{len(values)}{FORMATS[mode]}", *values)
    return head + ext + body
