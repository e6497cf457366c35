"""Copying the packaged instructions for an assistant into a folder of skills."""

from __future__ import annotations

import shutil
from pathlib import Path

NAME = "notewarp"


def install(folder: str | Path, *, force: bool = False) -> Path:
    """Copy the packaged folder to `folder`; one that is there is only replaced with `force`."""
    target = Path(folder) / NAME
    if target.exists():
        if not force:
            raise FileExistsError(f"{target} exists")
        shutil.rmtree(target)
    return Path(shutil.copytree(Path(__file__).parent / "skill", target))
