"""Files that tasks write into the shared folder and read from there."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


class Folder:
    """A folder by URI, on any file system that Arrow opens."""

    def __init__(self, uri: str):
        self.system, self.path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def write(self, name: str, content: bytes) -> None:
        """Under a temporary name first: a task that is lost or runs twice leaves whole files only."""
        self.system.create_dir(self.path, recursive=True)
        temporary = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(temporary, compression=None) as out:
            out.write(content)
        self.system.move(temporary, f"{self.path}/{name}")

    def octets(self, name: str) -> np.ndarray:
        """A file's content: mapped where the file system is mounted, else read."""
        if isinstance(self.system, fs.LocalFileSystem):
            return np.memmap(f"{self.path}/{name}", np.uint8, "r")
        with self.system.open_input_file(f"{self.path}/{name}") as file:
            return np.frombuffer(file.read(), np.uint8)
