"""A sink of one file a page, with a commit.

``df.write.format("page_files").option("folder", ...)`` takes rows (file_name,
markdown).  Each task attempt writes its pages below a staging folder of its own;
only the attempts that the driver accepts are moved to their names when all tasks
are done, so a task that is retried or runs twice leaves each page once, and a job
that fails leaves none.  The folder is a URI of any file system that Arrow opens.
Of rows with one name the last task's last row stays.
"""

from __future__ import annotations

import posixpath
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Pages that the driver moves to their names at a time.
MOVERS = 16
#: Most pages of a staging folder: as many names does a commit hold at a time.
FOLDER_PAGES = 10_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _listed(files, folder: str):
    from pyarrow import fs

    return files.get_file_info(fs.FileSelector(folder))


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    parts: int  # its folders 0, 1, ..., which hold the pages in the order of the rows


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return posixpath.join(base, f".staging-{self.job}")

    def write(self, iterator) -> _Written:
        files, base = _open(self.folder)
        own, parts = posixpath.join(self._staging(base), uuid.uuid4().hex), 0
        files.create_dir(own, recursive=True)
        for i, row in enumerate(iterator):
            name = row["file_name"]
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"no file name: {name!r}")
            if i % FOLDER_PAGES == 0:
                part, parts = posixpath.join(own, str(parts)), parts + 1
                files.create_dir(part)
            with files.open_output_stream(posixpath.join(part, name)) as f:
                f.write((row["markdown"] or "").encode())
        return _Written(own, parts)

    def commit(self, messages) -> None:
        files, base = _open(self.folder)

        def move(pages) -> None:
            for page in pages:
                files.move(page.path, posixpath.join(base, page.base_name))

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:  # one folder's pages after another's, so that the last ones stay; a folder's own names differ
                for i in range(m.parts if m else 0):
                    pages = _listed(files, posixpath.join(m.folder, str(i)))
                    list(pool.map(move, [pages[k::MOVERS] for k in range(MOVERS)]))
        self._clear(files, base)

    def abort(self, messages) -> None:
        files, base = _open(self.folder)
        self._clear(files, base)

    def _clear(self, files, base: str) -> None:
        if not self._exists(files, base):
            return
        for attempt in _listed(files, self._staging(base)):
            for part in _listed(files, attempt.path):
                files.delete_dir(part.path)
        files.delete_dir(self._staging(base))

    def _exists(self, files, base: str) -> bool:
        from pyarrow import fs

        return files.get_file_info(self._staging(base)).type == fs.FileType.Directory


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if {"file_name", "markdown"} - set(schema.fieldNames()):
            raise ValueError("page_files takes file_name and markdown")
        return _Writer(self.options["folder"])


def export_pages(pages: DataFrame, folder: str) -> None:
    """One markdown file per page in a folder that driver and executors share."""
    pages.sparkSession.dataSource.register(PageFiles)
    uri = folder if "://" in folder else f"file://{folder}"
    pages.select("file_name", "markdown").write.format("page_files").option("folder", uri).mode("append").save()
