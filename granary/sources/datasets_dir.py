"""Where datasets live: an argument, else the environment, else the user's setting, else a default."""

from __future__ import annotations

import json
import os
from pathlib import Path

VARIABLE = "GRANARY_DATASETS"


def config_path() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config")) / "granary" / "config.json"


def _config() -> dict:
    try:
        found = json.loads(config_path().read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def resolve(given: str | None = None) -> tuple[Path, str]:
    """The directory and what decided it: argument, environment, config or default."""
    for value, why in ((given, "argument"), (os.environ.get(VARIABLE), "environment"), (_config().get("datasets_dir"), "config")):
        if value and str(value).strip():
            return Path(str(value).strip()).expanduser(), why
    return Path("datasets"), "default"


def set_dir(value: str | None) -> Path:
    """Remember the user's directory; None forgets it."""
    config, path = _config(), config_path()
    config.pop("datasets_dir", None)
    if value:
        config["datasets_dir"] = str(Path(value).expanduser().resolve())
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(config, indent=2) + "\n", encoding="utf-8")
    part.replace(path)
    return resolve()[0]


def entries(folder: str | None = None) -> list[dict]:
    """Manifests below the directory, with ``problem`` where one cannot be read; other folders are left out."""
    root, out = resolve(folder)[0], []
    for child in sorted(root.iterdir()) if root.is_dir() else []:
        manifest = child / "dataset.json"
        if not manifest.is_file():
            continue
        try:
            m = json.loads(manifest.read_text(encoding="utf-8"))
            out.append({"folder": child.name, "name": m["name"], "dataset_id": m["dataset_id"], "chunk_count": m["chunk_count"], "problem": None})
        except (OSError, ValueError, KeyError, TypeError) as e:
            out.append({"folder": child.name, "name": None, "dataset_id": None, "chunk_count": None, "problem": f"{type(e).__name__}: {e}"})
    return out
