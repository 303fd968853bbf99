"""Settings of the jobs: a small JSON file each, whose fields a command line may override."""

from __future__ import annotations

import argparse
import json
from pathlib import Path
from typing import TypeVar

S = TypeVar("S")


def load(kind: type[S], path: str | None) -> S:
    """The settings of a JSON file, or the defaults; unknown fields are an error."""
    return kind(**json.loads(Path(path).read_text(encoding="utf-8"))) if path else kind()


def command_line(prog: str, about: str, paths: dict[str, str], optional: dict[str, str] | None = None) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog=prog, description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    for name, text in (optional or {}).items():
        parser.add_argument(f"--{name}", default=None, help=text)
    parser.add_argument("--config", default=None, help="JSON file of settings")
    return parser
