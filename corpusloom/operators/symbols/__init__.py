"""Symbols of source files: path, name, kind, parent, source and a 1-based range."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ...functions.paths import language
from .ecmascript import ecmascript_symbols
from .lines import line_symbols
from .python_source import python_symbols

COLUMNS = ["path", "name", "kind", "parent", "source", "start_line", "start_column", "end_line", "end_column"]
ECMASCRIPT = ("javascript", "jsx", "typescript", "tsx")


def parse_files(files: DataFrame) -> DataFrame:
    """path, content to symbols, by the language of the path; files of no language give none."""
    known = files.select("path", language("path").alias("language"), "content").where("language is not null and content is not null")
    scripts = ecmascript_symbols(known.where(known.language.isin(*ECMASCRIPT)))
    python = python_symbols(known.where("language = 'python'"))
    rest = line_symbols(known.where(~known.language.isin(*ECMASCRIPT, "python")))
    return scripts.select(*COLUMNS).unionByName(python.select(*COLUMNS)).unionByName(rest.select(*COLUMNS))
