"""Checks before a run: each says what is wrong and what to do; none raises."""

from __future__ import annotations

import importlib.util
import os
import shutil
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from millrace.sources import contract, files

OK, WARN, FAIL = "ok", "warn", "fail"


@dataclass(frozen=True)
class Result:
    name: str
    status: str
    detail: str
    fix: str = ""


def settings(path: str = ".env") -> dict[str, str]:
    """NAME=VALUE lines of a file; comments and other lines are skipped, quotes taken off."""
    out = {}
    if os.path.exists(path):
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                out[name.strip()] = value.strip().strip('"').strip("'")
    return out


def salt(name: str, path: str = ".env") -> str:
    """The salt of pseudonyms, from the environment or the settings file. There is no default: another salt gives other ids."""
    value = os.environ.get(name) or settings(path).get(name)
    if not value:
        raise RuntimeError(f"{name} is not set: put it into the environment or {path}; it never belongs into the repository")
    return value


def check_python(least: tuple[int, int] = (3, 11)) -> Result:
    v = sys.version_info
    return Result("python", OK if v[:2] >= least else FAIL, f"{v[0]}.{v[1]}", "" if v[:2] >= least else f"Python {least[0]}.{least[1]} or newer")


def check_packages(names: list[str]) -> Result:
    missing = [n for n in names if importlib.util.find_spec(n) is None]
    return Result("packages", FAIL if missing else OK, "missing: " + ", ".join(missing) if missing else f"{len(names)} present", "install them" if missing else "")


def check_salt(name: str, path: str = ".env") -> Result:
    try:
        salt(name, path)
    except RuntimeError as e:
        return Result("salt", FAIL, str(e).split(":")[0], "another salt gives other user ids than those already published")
    return Result("salt", OK, f"{name} is set")


def check_export(root: str, role: str) -> Result:
    """The newest file's header and required columns, from its first rows."""
    from itertools import islice

    path = files.newest(f"{root}/{role}")
    if path is None:
        return Result(role, FAIL, files.describe(root, role), f"save the export into {root}/{role}")
    try:
        rows = list(islice(files.sheet_rows(str(path)), contract.HEADER_ROWS + 5))
        at = contract.header_row(rows, role)
        old = contract.RENAMES.get(role, {})
        names = {old.get(c, c) for c in rows[at] if c}
        missing = [c for c in contract.REQUIRED[role] if c not in names]
    except Exception as e:  # noqa: BLE001  whatever is wrong with the file is the result
        return Result(role, FAIL, f"{path.name}: {e}", "export it again")
    return Result(role, FAIL if missing else OK, f"{path.name}: " + ("missing " + ", ".join(missing) if missing else f"header in row {at}"), "export it with these columns" if missing else "")


def check_file(name: str, path: str, needed: bool = False) -> Result:
    """Labels, registries, models: there or not."""
    there = os.path.exists(path)
    return Result(name, OK if there else FAIL if needed else WARN, path if there else f"{path} is missing", "" if there else "what depends on it is withheld")


def check_registry_file(spark, path: str) -> Result:
    try:
        return Result("registry", OK, f"{len(files.read_registry(spark, path))} rows")
    except Exception as e:  # noqa: BLE001
        return Result("registry", FAIL, str(e), "mend the rows named")


def check_device() -> Result:
    there = importlib.util.find_spec("torch") is not None
    return Result("device", OK if there else WARN, "models can run" if there else "no model library", "" if there else "tones and emotions stay null")


def check_disk(path: str, least_gb: float = 4.0) -> Result:
    at = Path(path).absolute()
    while not at.exists():
        at = at.parent
    free = shutil.disk_usage(at).free / 1e9
    return Result("disk", OK if free >= least_gb else FAIL, f"{free:.1f} GB free", "" if free >= least_gb else f"{least_gb} GB are needed")


def check_output(out: str, tables: list[str]) -> Result:
    """An output folder with names of another run is a warning; one that can't be written is a failure."""
    at = Path(out).absolute()
    while not at.exists():
        at = at.parent
    if not os.access(at, os.W_OK):
        return Result("output", FAIL, f"{at} can't be written", "choose another folder")
    old = files.stale(out, tables)
    return Result("output", WARN if old else OK, "left from another run: " + ", ".join(old) if old else out, "remove them" if old else "")


def run(checks: list[Callable[[], Result]]) -> list[Result]:
    return [c() for c in checks]


def render(results: list[Result]) -> str:
    return "\n".join(f"[{r.status:>4}] {r.name}: {r.detail}" + (f"\n       {r.fix}" if r.fix else "") for r in results)


def passed(results: list[Result]) -> bool:
    return not any(r.status == FAIL for r in results)
