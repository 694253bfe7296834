"""Arrays in the folder that all workers share: written by tasks, memory-mapped by tasks."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np


class SharedArrays:
    """Named arrays under a URI of a folder that every machine mounts; nothing is copied to a machine's own folder."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        if parsed.scheme not in ("", "file"):
            raise ValueError(f"arrays are memory-mapped, so the shared folder has to be mounted (file:), not {parsed.scheme}:")
        self.folder = parsed.path

    def write(self, name: str, array: np.ndarray) -> None:
        """Whole or not at all: a task that is run again writes the same file again."""
        os.makedirs(self.folder, exist_ok=True)
        temporary = f"{self.folder}/.{name}.npy.{os.getpid()}"
        with open(temporary, "wb") as f:
            np.save(f, array)
        os.replace(temporary, f"{self.folder}/{name}.npy")

    def remove(self, name: str) -> None:
        os.remove(f"{self.folder}/{name}.npy")

    def read(self, name: str) -> np.ndarray:
        """Mapped read-only; small ones are loaded, as maps are limited in number."""
        path = f"{self.folder}/{name}.npy"
        if os.path.getsize(path) <= 4096:
            return np.load(path)
        a = np.load(path, mmap_mode="r").view(np.ndarray)
        return a if len(a) else np.empty(0, a.dtype)
