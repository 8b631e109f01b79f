"""Symbols of Python files by the standard parser; files that it rejects go by lines."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, name string, kind string, parent string, source string, start_line long, start_column long, end_line long, end_column long"
NAMES = ["path", "name", "kind", "parent", "source", "start_line", "start_column", "end_line", "end_column"]


def emit(rows) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64()] * 4
    columns = list(zip(*rows)) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)


def _range(node) -> tuple[int, int, int, int]:
    return node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1


def symbols_of(source: str):
    """(name, kind, parent, source, range...) in source order."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last where the parser's stack overflows
        yield from _by_lines(source)
        return
    stack = list(reversed(list(ast.iter_child_nodes(tree))))
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node.name, "function", None, None, *_range(node)
        elif isinstance(node, ast.ClassDef):
            yield node.name, "class", None, None, *_range(node)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names = {a.name for a in node.names if a.name != "*"}
            if isinstance(node, ast.ImportFrom) and node.module:
                names.add("." * node.level + node.module)
            for name in sorted(names):
                yield name, "import", None, None, *_range(node)
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


_LINE = re.compile(r"(?:(?:async )?(def) |(class) )[&*$@]*([\w\-.:\\]+)")


def _by_lines(source: str):
    for number, line in enumerate(source.split("\n"), 1):
        text = line.strip()
        name = None
        if m := _LINE.match(text):
            name, kind = m[3].strip(":"), "function" if m[1] else "class"
        elif m := re.match(r"(?:from (\S+)|import ([^, ]+))", text):
            name, kind = m[1] or m[2], "import"
        if name:
            column = len(line[: max(0, line.find(name))].encode()) + 1
            yield name, kind, None, None, number, column, number, max(len(line.encode()), column) + 1


def _run(batches):
    for batch in batches:
        yield emit([(path, *row) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in symbols_of(text)])


def python_symbols(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_run, SCHEMA)
