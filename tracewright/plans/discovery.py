"""Where a corpus and its configuration are, and which day an answer is for."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Mapping
from pathlib import Path

from tracewright.plans import config
from tracewright.plans.config import ADR_NAME, DAY, Config, ConfigError

#: Folders of decision records by custom, the first that holds one counts (fixed values).
FOLDERS = ("docs/adr", "doc/adr", "docs/decisions", "docs/ADR", "adr")
FILE_NAME = "tracewright.yaml"
DAY_VARIABLE = "TRACEWRIGHT_AS_OF"


def spelt(root: Path, folder: str) -> bool:
    """Whether a folder is there with exactly these letters, on any file system."""
    at = root
    for part in folder.split("/"):
        if not at.is_dir() or part not in os.listdir(at):
            return False
        at /= part
    return at.is_dir()


def discover(root: str | Path) -> str:
    """The first customary folder that holds a document by its name."""
    for folder in FOLDERS:
        if spelt(Path(root), folder) and any(ADR_NAME.match(p.name) for p in (Path(root) / folder).iterdir() if p.is_file()):
            return folder
    raise ConfigError(f"no customary folder of documents below {root}")


def resolve(root: str | Path = ".", path: str | None = None, folder: str | None = None) -> tuple[Config, str]:
    """The configuration that is in effect and the folder that its paths are below.

    What is given here stands before what a file says, and that before its preset.  A named file must be there.
    Folders are read below the file that names them, but for a given one.
    """
    file = Path(root) / (path or FILE_NAME)
    if path and not file.is_file():
        raise ConfigError(f"no configuration {file}")
    raw: Mapping = {}
    base = Path(root)
    if file.is_file():
        import yaml

        raw, base = yaml.safe_load(file.read_text()) or {}, file.parent
    cfg = config.read(raw)
    if cfg.multikind:
        for name, kind in cfg.kinds:
            if name in raw.get("kinds", {}) and kind.dir and not (base / kind.dir).is_dir():
                raise ConfigError(f"kind {name}: no folder {base / kind.dir}")
        return cfg, str(base)
    chosen = folder or raw.get("dir")
    if chosen:
        base = Path(root) if folder else base
        if not (base / chosen).is_dir():
            raise ConfigError(f"no folder {base / chosen}")
    else:
        base, chosen = Path(root), discover(root)
    return config.replace(cfg, dir=chosen), str(base)


def as_of(given: str | None = None, repository=None, committed: bool = False) -> str:
    """The day asked for: what is given, else the environment's, else that of the last commit (if asked for and there is one), else today."""
    day = (given or os.environ.get(DAY_VARIABLE, "")).strip()
    if day:
        try:
            if DAY.match(day):
                return dt.date.fromisoformat(day).isoformat()
        except ValueError:
            pass
        raise ConfigError(f"no day: {day}")
    if committed and repository is not None:
        return repository.committer_day()
    return dt.datetime.now(tz=dt.UTC).date().isoformat()
