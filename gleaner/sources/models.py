"""Where a trained model comes from: explicit path, environment, default path, download; each checked by SHA-256."""

from __future__ import annotations

import hashlib
import os
import urllib.request
from pathlib import Path

BLOCK = 64 << 10


class ModelError(RuntimeError):
    pass


def file_sha256(path: Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            h.update(block)
    return h.hexdigest()


def check_sha256(path: Path, expected: str | None) -> None:
    want = (expected or "").strip().lower()
    if want and file_sha256(path) != want:
        raise ModelError(f"{path} has another SHA-256 than expected")


def download(url: str, target: Path, expected: str | None = None, timeout: float = 60.0) -> Path:
    """Written beside the target, verified, then moved in one step; an existing target is kept."""
    if target.exists():
        check_sha256(target, expected)
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".tmp")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:
            while block := source.read(BLOCK):
                out.write(block)
        if not part.stat().st_size:
            raise ModelError("the download is empty")
        check_sha256(part, expected)
        os.replace(part, target)
    except OSError as e:
        raise ModelError(str(e)) from e
    finally:
        part.unlink(missing_ok=True)
    return target


def resolve(explicit: str | None, variable: str, default: Path, url: str | None = None, expected: str | None = None) -> Path:
    named = explicit or os.environ.get(variable)
    if named:
        path = Path(named)
        if not path.exists():
            raise ModelError(f"{path} does not exist")
    elif default.exists():
        path = default
    elif url:
        return download(url, default, expected)
    else:
        raise ModelError(f"no model: give a path, set {variable}, or name a url")
    check_sha256(path, expected)
    return path
