"""The header rules, stated once: over plain numbers of one header, or over columns of many.

A rule reads ``v[name]``: header fields, and what is derived from them (``mode_ok``, ``map_ok``,
``labels_used``, ``first_blank`` label among the first NLABL or -1, ``stack_rest`` of nz by mz).
Comparisons joined by & and | give a truth value of either kind. Messages name fields in braces.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

Rule = Callable[[Mapping], object]


def _positive(*names: str) -> Rule:
    a, b, c = names
    return lambda v: (v[a] > 0) & (v[b] > 0) & (v[c] > 0)


def _ispg(v: Mapping) -> object:
    return ((v["ispg"] >= 0) & (v["ispg"] <= 230)) | _stack(v)


def _stack(v: Mapping) -> object:
    return (v["ispg"] >= 400) & (v["ispg"] <= 630)


def _axes(signs: tuple[int, ...]) -> Rule:
    """Whether each of 1, 2, 3, with one of the signs, is the number of some axis."""

    def rule(v: Mapping) -> object:
        found = []
        for k in (1, 2, 3):
            some = v["mapc"] == k * signs[0]
            for axis in ("mapc", "mapr", "maps"):
                for sign in signs:
                    some = some | (v[axis] == k * sign)
            found.append(some)
        return found[0] & found[1] & found[2]

    return rule


def _stack_fits(v: Mapping) -> object:
    return (_stack(v) == False) | (v["mz"] == 0) | (v["stack_rest"] == 0)  # noqa: E712


def _version(*known: int) -> Rule:
    def rule(v: Mapping) -> object:
        some = v["nversion"] == known[0]
        for n in known[1:]:
            some = some | (v["nversion"] == n)
        return some

    return rule


_MESSAGES = {
    "InvalidMap": "MAP field is not the standard one: {map}",
    "InvalidIspg": "ISPG {ispg} is not 0, 1-230 or 400-630",
    "InvalidAxisMapping": "Axes {mapc}, {mapr}, {maps} do not permute 1, 2, 3",
    "InvalidNsymbt": "NSYMBT {nsymbt} is negative",
    "InvalidNlabl": "NLABL {nlabl} is not 0-10",
    "InvalidSampling": "Sampling {mx}, {my}, {mz} must be positive",
    "InvalidVolumeStack": "Stack: nz {nz} is no multiple of mz {mz}",
}

#: (code, rule, message) in the order in which the first failure counts.
STRICT: list[tuple[str, Rule, str]] = [
    ("InvalidDimensions", _positive("nx", "ny", "nz"), "Dimensions {nx} x {ny} x {nz} must all be positive"),
    ("UnsupportedMode", lambda v: v["mode_ok"], "Mode {mode} is not supported"),
    ("InvalidMap", lambda v: v["map_ok"], _MESSAGES["InvalidMap"]),
    ("InvalidIspg", _ispg, _MESSAGES["InvalidIspg"]),
    ("InvalidAxisMapping", _axes((1,)), _MESSAGES["InvalidAxisMapping"]),
    ("InvalidNsymbt", lambda v: v["nsymbt"] >= 0, _MESSAGES["InvalidNsymbt"]),
    ("InvalidNlabl", lambda v: (v["nlabl"] >= 0) & (v["nlabl"] <= 10), _MESSAGES["InvalidNlabl"]),
    ("LabelCountMismatch", lambda v: v["labels_used"] == v["nlabl"], "NLABL {nlabl} but {labels_used} labels are used"),
    ("EmptyLabelBeforeFilled", lambda v: v["first_blank"] < 0, "Label {first_blank} is blank before the last used one"),
    ("InvalidNversion", _version(0, 20140, 20141), "NVERSION {nversion} is not 0, 20140 or 20141"),
    ("InvalidSampling", _positive("mx", "my", "mz"), _MESSAGES["InvalidSampling"]),
    ("InvalidVolumeStack", _stack_fits, _MESSAGES["InvalidVolumeStack"]),
]

_BY_CODE = {code: rule for code, rule, _ in STRICT}

#: (rule, message) of what permissive reading notes where the rule fails: axes may be negative, labels are not counted, NVERSION 0 is noted.
PERMISSIVE: list[tuple[Rule, str]] = [
    (_BY_CODE["InvalidMap"], _MESSAGES["InvalidMap"]),
    (_BY_CODE["InvalidIspg"], _MESSAGES["InvalidIspg"]),
    (_axes((1, -1)), _MESSAGES["InvalidAxisMapping"]),
    (lambda v: (v["mapr"] != -2) | (_axes((1, -1))(v) == False), "mapr -2: rows are inverted"),  # noqa: E712
    (_BY_CODE["InvalidNsymbt"], _MESSAGES["InvalidNsymbt"]),
    (_BY_CODE["InvalidNlabl"], _MESSAGES["InvalidNlabl"]),
    (_version(20140, 20141), "NVERSION {nversion} is not 20140 or 20141"),
    (_BY_CODE["InvalidSampling"], _MESSAGES["InvalidSampling"]),
    (_BY_CODE["InvalidVolumeStack"], _MESSAGES["InvalidVolumeStack"]),
]
