"""Errors of the volume format; ``code`` is what error columns carry."""

from __future__ import annotations


class VolumeError(Exception):
    """Base of all; ``code`` names the kind."""

    code = "Volume"


class VolumeIOError(VolumeError):
    code = "Io"


class InvalidHeader(VolumeError):
    code = "InvalidHeader"


class InvalidHeaderDetailed(InvalidHeader):
    """A failed header rule; ``rule`` is its code in the rules engine."""

    code = "InvalidHeaderDetailed"

    def __init__(self, rule: str, message: str) -> None:
        super().__init__(f"{rule}: {message}")
        self.rule = rule


class UnsupportedMode(VolumeError):
    code = "UnsupportedMode"


class BoundsError(VolumeError):
    code = "BoundsError"


class TypeMismatch(VolumeError):
    code = "TypeMismatch"


class BlockShapeMismatch(VolumeError):
    code = "BlockShapeMismatch"


class ModeMismatch(VolumeError):
    code = "ModeMismatch"


class StatsMismatch(VolumeError):
    code = "StatsMismatch"


class FileSizeMismatch(VolumeError):
    code = "FileSizeMismatch"


class NotAVolumeStack(VolumeError):
    code = "NotAVolumeStack"


class ValueOutOfRange(VolumeError):
    code = "ValueOutOfRange"
