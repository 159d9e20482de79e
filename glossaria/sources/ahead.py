"""Small files that tasks write before their result is committed: one for each answer that was paid for."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, so that tasks find the same store as Spark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


class Ahead:
    """A folder of texts by name. A name's first letters are its folder, so that no folder holds very many."""

    def __init__(self, uri: str):
        self.system, self.root = fs.FileSystem.from_uri(uri)

    def _place(self, name: str) -> str:
        return f"{self.root}/{name[:3]}/{name}"

    def get(self, name: str) -> str | None:
        try:
            with self.system.open_input_stream(self._place(name)) as source:
                return source.read().decode()
        except FileNotFoundError:
            return None

    def put(self, name: str, text: str) -> None:
        """Written under another name and renamed, so that no half text is ever read."""
        place = self._place(name)
        self.system.create_dir(os.path.dirname(place), recursive=True)
        temporary = f"{place}.{uuid.uuid4().hex}.tmp"
        with self.system.open_output_stream(temporary) as out:
            out.write(text.encode())
        self.system.move(temporary, place)
