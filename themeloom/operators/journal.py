"""A journal of replies: what a model has answered outlives the task that asked.

Each reply is a small file of its own in a folder all machines share, under the key of its prompt. It
is written under another name first and then moved, so a reader sees a whole reply or none, and writing
the same reply twice leaves one file. A task that is run again, or a later run with the same folder,
reads a prompt's reply before it asks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache
from urllib.parse import urlsplit

from pyarrow import fs


@dataclass(frozen=True)
class Reply:
    """A reply and when it was asked for and came."""

    response: str
    started_at: datetime
    ended_at: datetime


@lru_cache(8)
def _open(folder: str) -> tuple[fs.FileSystem, str]:
    parts = urlsplit(folder)
    # Hadoop writes local paths with one slash.
    if parts.scheme == "file":
        folder = parts.path
    return fs.FileSystem.from_uri(folder.rstrip("/"))


@dataclass(frozen=True)
class Journal:
    """Replies below ``folder``: a path or address that pyarrow can open on every machine."""

    folder: str

    def _path(self, key: str) -> tuple[fs.FileSystem, str]:
        system, root = _open(self.folder)
        # Keys are digests; folders of two digits keep listings short.
        return system, f"{root}/{key[:2]}/{key}"

    def read(self, key: str) -> Reply | None:
        """The reply kept under ``key``, or None."""
        system, path = self._path(key)
        try:
            with system.open_input_stream(path) as file:
                kept = json.loads(file.read())
        except FileNotFoundError:
            return None
        return Reply(kept["response"], datetime.fromisoformat(kept["started_at"]), datetime.fromisoformat(kept["ended_at"]))

    def write(self, key: str, reply: Reply) -> None:
        """Keep ``reply`` under ``key``; an earlier one is replaced."""
        system, path = self._path(key)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        made = f"{path}.{uuid.uuid4().hex}"
        kept = {"response": reply.response, "started_at": reply.started_at.isoformat(), "ended_at": reply.ended_at.isoformat()}
        with system.open_output_stream(made) as file:
            file.write(json.dumps(kept).encode())
        system.move(made, path)
