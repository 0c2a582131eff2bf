"""Checks of settings and conversions of loosely typed values."""

from __future__ import annotations

import dataclasses
import importlib
import math
import os
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A setting that can't be used."""


def require(ok: object, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def positive_number(value: float, name: str) -> float:
    require(isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value > 0, f"{name} must be above zero, not {value!r}")
    return value


def fraction(value: float, name: str) -> float:
    require(isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= 1, f"{name} must be from 0 to 1, not {value!r}")
    return value


def choice(value: Any, name: str, allowed: tuple) -> Any:
    require(value in allowed, f"{name} must be one of {', '.join(map(str, allowed))}, not {value!r}")
    return value


def directory(path: str | Path, name: str, create: bool = False) -> Path:
    """path as a folder that exists; made if asked for."""
    path = Path(path).expanduser()
    if create:
        path.mkdir(parents=True, exist_ok=True)
    require(path.is_dir(), f"{name} is no folder: {path}")
    return path


def module(name: str, purpose: str) -> Any:
    """An optional module, or an error that says what needs it."""
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ConfigError(f"{purpose} needs the module {name}") from e


def text_or_none(value: object) -> str | None:
    value = "" if value is None else str(value).strip()
    return value or None


def number_or_none(value: object) -> float | None:
    """A float, or null for null, empty text and what is no finite number."""
    if value is None or isinstance(value, bool) or (isinstance(value, str) and not value.strip()):
        return None
    try:
        out = float(value)
    except (TypeError, ValueError):
        return None
    return out if math.isfinite(out) else None


def whole_or_none(value: object) -> int | None:
    out = number_or_none(value)
    return None if out is None else int(out)


def from_mapping(kind: type, values: dict) -> Any:
    """A dataclass from a mapping; keys that it doesn't have are an error that names them."""
    known = {f.name for f in dataclasses.fields(kind)}
    require(set(values) <= known, f"unknown settings: {', '.join(sorted(set(values) - known))}")
    return kind(**values)


#: Packages that every operator needs, and those that one source or sink needs.
REQUIRED, OPTIONAL = ("python", "java", "pyspark", "numpy", "pandas", "pyarrow"), ("openpyxl", "openslide", "pyvips", "matplotlib")


def diagnostics() -> dict[str, str | None]:
    """Versions of what runs here, None for what is missing; nothing is imported or started for it."""
    import platform
    import shutil
    from importlib import metadata

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    java = os.path.join(os.environ["JAVA_HOME"], "bin", "java") if "JAVA_HOME" in os.environ else "java"
    found = {"python": platform.python_version(), "java": shutil.which(java)}
    return found | {k: version(k) for k in REQUIRED[2:] + OPTIONAL}
