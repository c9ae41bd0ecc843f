"""Files that tasks write and read themselves, on any store pyarrow knows by its URI."""

import os
import uuid

from pyarrow import fs


def store(uri):
    """(filesystem, path) of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


class Written:
    """A file that appears under its name once it is complete: attempts do not disturb each other."""

    def __init__(self, uri):
        self.fs, self.path = store(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.at = 0

    def write(self, data):
        self.out.write(data)
        self.at += len(data)

    def close(self):
        self.out.close()
        self.fs.move(self.part, self.path)


def write_file(uri, data):
    f = Written(uri)
    f.write(data)
    f.close()


def read_file(uri):
    at, path = store(uri)
    with at.open_input_stream(path) as f:
        return f.read()
