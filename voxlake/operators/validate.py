"""Header rules and validation reports as column expressions and issue rows (path, severity, category, message)."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions import header as H
from voxlake.functions.modes import MODES, data_size, mode_is_complex, mode_is_float
from voxlake.functions.rules import PERMISSIVE, STRICT
from voxlake.operators.stats import complex_stats, density_stats, is_close, nonfinite_counts


def _c(n: str) -> Column:
    return F.col(n)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts))


def _used_labels() -> Column:
    return F.size(F.filter("labels", lambda x: ~H.label_blank(x)))


def _blank_at() -> Column:
    """Index of the first blank label among the first nlabl; -1 if there is none."""
    among = F.slice("labels", 1, F.greatest(F.least(_c("nlabl"), F.lit(10)), F.lit(0)))
    return F.coalesce(F.array_position(F.transform(among, H.label_blank), True).cast("int"), F.lit(0)) - 1


class _Columns(dict):
    """What the header rules read, as columns; ``labels`` holds ten raw labels."""

    def __missing__(self, name: str) -> Column:
        made = {
            "mode_ok": lambda: _c("mode").isin(list(MODES)),
            "map_ok": lambda: H.accepted_map(_c("map")),
            "labels_used": _used_labels,
            "first_blank": _blank_at,
            "stack_rest": lambda: F.coalesce(F.expr("try_mod(nz, mz)"), F.lit(0)),
        }
        return made[name]() if name in made else _c(name)


def _message(template: str) -> Column:
    v = _Columns()
    return _text(*(x for text, name, _, _ in Formatter().parse(template) for x in ((text,) if text else ()) + ((v[name],) if name else ())))


def strict_rules() -> list[tuple[str, Column, Column]]:
    """(code, holds, message) in the order in which the first failure counts."""
    return [(code, rule(_Columns()), _message(message)) for code, rule, message in STRICT]


def first_error() -> Column:
    """Code of the first strict rule that fails; null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok, _ in strict_rules()))


def first_message() -> Column:
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), message) for _, ok, message in strict_rules()))


def all_errors() -> Column:
    """Codes of all strict rules that fail."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok, _ in strict_rules())), lambda x: x.isNotNull())


def is_valid_header() -> Column:
    return first_error().isNull()


def fatal_error() -> Column:
    """What permissive validation still refuses: dimensions and mode."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok, _ in strict_rules()[:2]))


def permissive_warnings() -> Column:
    """Warnings instead of errors: axes may be negative (mapr -2 is noted), labels are not counted, NVERSION 0 warns."""
    notes = [F.when(~F.coalesce(rule(_Columns()), F.lit(False)), _message(message)) for rule, message in PERMISSIVE]
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def issue(severity: str, category: str, message: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"))


def header_issues(volumes: DataFrame) -> DataFrame:
    """Issues that headers alone show: opening, header, file size, byte order and volume kind.

    ``volumes``: path, endian, standard_stamp, warnings and the header's fields as columns.
    """
    total = F.lit(H.HEADER_BYTES) + F.greatest(_c("nsymbt"), F.lit(0)) + data_size(_c("nx"), _c("ny"), _c("nz"), _c("mode"))
    kind = H.volume_kind(_c("nz"), _c("ispg"))
    found = [
        F.transform("warnings", lambda w: issue("Warning", "Open", w)),
        F.array(F.when(is_valid_header(), issue("Info", "Header", F.lit("Structure is valid"))).otherwise(issue("Error", "Header", first_message()))),
        F.array(F.when(total.isNotNull(), issue("Info", "File size", _text("Expected ", total, " bytes")))),
        F.array(F.when(~F.coalesce(_c("standard_stamp"), F.lit(True)), issue("Warning", "Endianness", F.lit("Non-standard MACHST stamp")))),
        F.array(issue("Info", "Endianness", _text(_c("endian"), "-endian"))),
        F.array(F.when(kind == "volume stack", issue("Info", "Volume", _text("Stack of ", F.expr("coalesce(try_divide(nz, mz), 0)").cast("int"), " volumes of ", _c("mz"), " sections")))),
        F.array(issue("Info", "Volume", _text(_c("nx"), " x ", _c("ny"), " x ", _c("nz"), " voxels, ", kind))),
    ]
    return volumes.select("path", F.explode(F.filter(F.concat(*found), lambda x: x.isNotNull())).alias("i")).select("path", "i.*")


def data_issues(volumes: DataFrame, voxels: DataFrame) -> DataFrame:
    """Issues that need the data: claimed statistics against the actual ones, and values that are no finite numbers.

    ``voxels``: path, re and im (im is null for real modes).
    """
    re, im = _c("re"), _c("im")
    real = {c: density_stats(re)[k] for k, c in enumerate(("n", "dmin", "dmax", "dmean", "rms"))}
    cells = voxels.groupBy("path").agg(
        *(v.alias(f"a_{c}") for c, v in real.items()),
        complex_stats(re, im)[4].alias("c_rms"),
        *(x.alias(f"r_{n}") for x, n in zip(nonfinite_counts(re), ("nan", "pinf", "ninf", "pct"), strict=True)),
        *(x.alias(f"c_{n}") for x, n in zip(nonfinite_counts(re, im), ("nan", "pinf", "ninf", "pct"), strict=True)),
    )
    joined = volumes.join(cells, "path")
    cplx = mode_is_complex(_c("mode"))
    unset, rms_unset = _c("dmin") > _c("dmax"), _c("rms") < 0
    rms = F.when(cplx, _c("c_rms")).otherwise(_c("a_rms"))
    wrong = [(c, ~(cplx | unset | is_close(_c(c).cast("double"), _c(f"a_{c}"))), _c(f"a_{c}")) for c in ("dmin", "dmax", "dmean")]
    wrong.append(("rms", ~(rms_unset | is_close(_c("rms").cast("double"), rms)), rms))
    detail = F.concat_ws("", *(F.when(F.coalesce(bad, F.lit(True)), _text(f" {c} claimed=", _c(c), " actual=", actual)) for c, bad, actual in wrong))
    stats = F.when(unset & rms_unset, F.lit(None)).when(detail != "", issue("Error", "Statistics", _text("Mismatch:", detail)))
    stats = stats.when(unset, issue("Info", "Statistics", F.lit("Statistics are not set"))).otherwise(issue("Info", "Statistics", F.lit("All statistics match the data")))
    counts = [(F.when(cplx, _c(f"c_{k}")).otherwise(_c(f"r_{k}")), name) for k, name in (("nan", "NaN"), ("pinf", "+Inf"), ("ninf", "-Inf"))]
    floats = mode_is_float(_c("mode"))
    bad = [F.when(floats & (n > 0), issue("Warning", "Data integrity", _text(n, f" values are {name}"))) for n, name in counts]
    fine = F.when(floats & (sum((n for n, _ in counts), F.lit(0)) == 0), issue("Info", "Data integrity", F.lit("All values are finite")))
    found = F.filter(F.array(stats, *bad, fine), lambda x: x.isNotNull())
    return joined.select("path", F.explode(found).alias("i")).select("path", "i.*")


def roll_up(issues: DataFrame) -> DataFrame:
    """(path, is_valid, n_error, n_warning): valid without an error."""
    n = lambda s: F.count_if(_c("severity") == s)
    return issues.groupBy("path").agg((n("Error") == 0).alias("is_valid"), n("Error").alias("n_error"), n("Warning").alias("n_warning"))


def by_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.where(_c("severity") == severity)
