"""The application's configuration file: an object with two folders, missing keys filled in."""

from __future__ import annotations

import json
import os

DEFAULTS = {"library_path": "", "bookmarks_path": ""}


def load_config(path: str, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """Creates the file with defaults where it is missing; anything but an object raises ValueError."""
    defaults = DEFAULTS if defaults is None else defaults
    if not os.path.exists(path):
        save_config(path, defaults)
        return dict(defaults)
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    if not isinstance(config, dict):
        raise ValueError(f"{path}: not an object")
    return {**defaults, **config}


def save_config(path: str, config: dict[str, str]) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(config, file, ensure_ascii=False, indent=2)
