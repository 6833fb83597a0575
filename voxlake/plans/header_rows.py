"""Header rows for the header queries: over the events, a valid header with two changes, most of which break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "nx": 64, "ny": 48, "nz": 32, "mode": 2, "mx": 64, "my": 48, "mz": 32, "xlen": 128.0, "ylen": 96.5, "zlen": 64.25, "alpha": 90.0, "beta": 90.0, "gamma": 90.0,
    "mapc": 1, "mapr": 2, "maps": 3, "ispg": 1, "nsymbt": 0, "map": "MAP ", "nversion": 20141, "nlabl": 0, "label_a": "", "label_b": "",
}
CHANGES: list[dict] = [
    {}, {"nx": 0}, {"nz": -1}, {"mode": 99}, {"mode": 12}, {"map": "XYZ_"}, {"ispg": 300}, {"ispg": 400, "mz": 8}, {"ispg": 630, "mz": 16}, {"mapc": 2}, {"mapr": -2}, {"maps": 4},
    {"nsymbt": -5}, {"nsymbt": 768}, {"nlabl": 11}, {"nlabl": -1}, {"nlabl": 2}, {"nlabl": 1, "label_a": "x"}, {"nlabl": 1, "label_b": "y"}, {"nlabl": 2, "label_a": "x", "label_b": "y"},
    {"nversion": 0}, {"nversion": 20139}, {"mx": 0}, {"mz": 0, "ispg": 401}, {"ispg": 401, "mz": 5}, {"ispg": 0, "mz": 1}, {"nz": 1, "mz": 1}, {"alpha": 75.0, "beta": 80.0, "gamma": 110.0}, {"xlen": -1.0}, {"xlen": 0.0, "mx": 3},
]
_TYPES = {int: "INT", float: "DOUBLE", str: "VARCHAR"}
#: Added to what no change sets.
_VARIED = {"nx": "id % 5", "ny": "id % 3", "xlen": "id % 11", "ylen": "id % 7"}


def _literal(v: object) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def _field(name: str, kind: str) -> str:
    """The second change's value, else the first one's, else the base."""
    out = _literal(BASE[name]) + (f" + {_VARIED[name]}" if name in _VARIED else "")
    cases = " ".join(f"WHEN {k} THEN {_literal(c[name])}" for k, c in enumerate(CHANGES) if name in c)
    for change in ("k1", "k2") if cases else ():
        out = f"CASE {change} {cases} ELSE {out} END"
    return f"CAST({out} AS {kind}) AS {name}"


def _fields(text: str) -> list[str]:
    return [_field(n, text if isinstance(v, str) else _TYPES[type(v)]) for n, v in BASE.items()]


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with ``labels``, ten raw labels of 80 characters."""
    n = len(CHANGES)
    numbered = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", f"event_id % {n} AS k1", f"event_id div {n} % {n} AS k2")
    slots = [F.rpad("label_a", 80, " "), F.rpad("label_b", 80, " "), *(F.rpad(F.lit(""), 80, "\0") for _ in range(8))]
    return numbered.selectExpr("id", *_fields("STRING")).withColumn("labels", F.array(*slots))


_N = len(CHANGES)
HEADER_SQL = f"WITH numbered AS (SELECT event_id AS id, event_id % {_N} AS k1, event_id // {_N} % {_N} AS k2 FROM events), hdr AS (SELECT id, {', '.join(_fields('VARCHAR'))} FROM numbered)"
