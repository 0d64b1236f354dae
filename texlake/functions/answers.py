"""A log of answers in a shared folder: what is logged is never asked again, whichever task, job or attempt asks."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow.fs as pafs


class AnswerLog:
    """One file for each prompt, named by the prompt's SHA-256 and written under another name first, so it is whole or absent.

    A file costs little beside a request to a model. Of two attempts that ask at the same moment the first to finish
    counts: the other one takes over its answer.
    """

    def __init__(self, root: str):
        self.files, self.base = pafs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (pafs.LocalFileSystem(), root)
        self.made: set[str] = set()  # folders that are there

    def _path(self, prompt: str) -> str:
        name = hashlib.sha256(prompt.encode()).hexdigest()
        return f"{self.base}/{name[:2]}/{name}"

    def get(self, prompt: str) -> str | None:
        try:
            with self.files.open_input_stream(self._path(prompt), compression=None) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, prompt: str, answer: str) -> str:
        """The answer that stands in the log from now on."""
        path = self._path(prompt)
        temporary = f"{self.base}/.{uuid.uuid4().hex}"
        folder = path.rsplit("/", 1)[0]
        if folder not in self.made:
            self.files.create_dir(folder, recursive=True)
            self.made.add(folder)
        with self.files.open_output_stream(temporary, compression=None) as f:
            f.write(answer.encode())
        before = self.get(prompt)
        if before is not None:
            self.files.delete_file(temporary)
            return before
        self.files.move(temporary, path)
        return answer
