"""A streaming source of file events: the offset is a listing, a batch is the difference of two.

``spark.readStream.format("file_events").option("root", ...).option("listings", ...)``
gives path, kind (created, changed, deleted), size_bytes, modified_at and at (when
the listing was made).  A listing holds path, size and time of every file below the
root; each new one that differs from the last is written to the listings folder
under the next number, and that number is the offset.  A batch from one number to
another is made from those two files only, so a batch that is run again after a
restart gives the same rows.  The first listing is the baseline and gives no events.
Listings before a committed offset are deleted.

root and listings may be URIs of any file system that Arrow opens; listings must
survive a restart, as the checkpoint does.
"""

from __future__ import annotations

import json
import posixpath
import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, size_bytes long, modified_at timestamp, at timestamp"
#: Events of a partition.
PART = 10_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Listings:
    """Numbered listings in a folder."""

    def __init__(self, root: str, folder: str):
        self.root, self.folder = root, folder

    def _name(self, number: int) -> str:
        return f"{number:012d}.json"

    def numbers(self) -> list[int]:
        from pyarrow import fs

        files, base = _open(self.folder)
        files.create_dir(base, recursive=True)
        return sorted(int(f.base_name[:-5]) for f in files.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".json"))

    def read(self, number: int) -> dict:
        files, base = _open(self.folder)
        with files.open_input_stream(posixpath.join(base, self._name(number))) as f:
            return json.loads(f.read())

    def write(self, number: int, listing: dict) -> None:
        files, base = _open(self.folder)
        draft = posixpath.join(base, f"{self._name(number)}.draft")
        with files.open_output_stream(draft) as f:
            f.write(json.dumps(listing).encode())
        files.move(draft, posixpath.join(base, self._name(number)))

    def delete_before(self, number: int) -> None:
        files, base = _open(self.folder)
        for n in self.numbers():
            if n < number:
                files.delete_file(posixpath.join(base, self._name(n)))

    def look(self) -> dict:
        """path: [size, time in microseconds] of every file below the root, and when it was looked at."""
        from pyarrow import fs

        files, base = _open(self.root)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
        held = {f.path[len(base) :].lstrip("/"): [f.size, f.mtime_ns // 1000] for f in found if f.type == fs.FileType.File}
        return {"at": time.time_ns() // 1000, "files": held}

    def latest(self) -> int:
        """The number of a listing that equals the tree as it is now."""
        numbers, now = self.numbers(), self.look()
        if not numbers:
            self.write(0, now)
            return 0
        if self.read(numbers[-1])["files"] == now["files"]:
            return numbers[-1]
        self.write(numbers[-1] + 1, now)
        return numbers[-1] + 1


def differences(old: dict, new: dict) -> list[tuple]:
    """(path, kind, size, time) of every file that one listing has otherwise than the other, by path."""
    found = [(p, "created" if p not in old else "changed", *now) for p, now in new.items() if old.get(p) != now]
    return sorted(found + [(p, "deleted", *was) for p, was in old.items() if p not in new])


class _Part(InputPartition):
    def __init__(self, rows: list[tuple], at: int):
        self.rows, self.at = rows, at


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.listings = _Listings(options["root"], options["listings"])

    def initialOffset(self) -> dict:
        numbers = self.listings.numbers()
        return {"listing": numbers[0] if numbers else self.listings.latest()}

    def latestOffset(self) -> dict:
        return {"listing": self.listings.latest()}

    def partitions(self, start: dict, end: dict):
        parts = []
        # listings between the two are told one by one, so a file that was made and removed between is told too
        for number in range(start["listing"], end["listing"]):
            old, new = self.listings.read(number), self.listings.read(number + 1)
            rows = differences(old["files"], new["files"])
            parts += [_Part(rows[i : i + PART], new["at"]) for i in range(0, len(rows), PART)]
        return parts or [_Part([], 0)]

    def read(self, partition: _Part):
        moment = lambda us: datetime.fromtimestamp(us / 1e6, timezone.utc)
        for path, kind, size, modified in partition.rows:
            yield path, kind, size, moment(modified), moment(partition.at)

    def commit(self, end: dict) -> None:
        self.listings.delete_before(end["listing"])


class FileEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def file_events(spark: SparkSession, root: str, listings: str):
    """The events below a tree as a stream."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").option("root", root).option("listings", listings).load()
