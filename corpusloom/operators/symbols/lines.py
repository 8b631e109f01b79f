"""Symbols by line patterns, as one Column expression per language; no Python rows.

Each rule is (pattern with the name as group 1, kind).  The first rule of a
language that gives a name decides a line.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.paths import stem
from ...functions.text import lines, trim_white, trim_white_start

#: An identifier after signs that may lead it.
_IDENT = r"[&*$@]*([\p{IsAlphabetic}\p{N}_\-.:\\]+)"


def _after(keyword: str) -> str:
    """The identifier after the first place of a keyword; the group is atomic, so a later place is never tried and a long line costs no stack."""
    return rf"^(?>.*?{keyword}){_IDENT}"


def _starts(*words: str) -> str:
    return rf"^(?:{'|'.join(words)}){_IDENT}"


#: What stands before the first paren, its last word; not for assignments, types, `if` and `for`.
_BEFORE_PAREN = rf"^(?!if |for )(?=[^(]*\()(?![^(]*[=:][^(]*\()(?:[^(]*[\s])?{_IDENT}[^\s(]*\s*\("

RULES: dict[str, list[tuple[str, str]]] = {
    "python": [(_starts("async def ", "def "), "function"), (_starts("class "), "class")],
    "rust": [(_after("fn "), "function"), (_after("struct "), "class"), (_after("enum "), "enum"), (_after("trait "), "interface"), (_after("type "), "type_alias")],
    "go": [
        (rf"^func (?:\([^)]*\)\s*){_IDENT}", "function"),
        (rf"^func (?!\([^)]*\)){_IDENT}", "function"),
        (rf"^type (?=.* struct){_IDENT}", "class"),
        (rf"^type (?=.* interface){_IDENT}", "interface"),
        (_starts("type "), "type_alias"),
    ],
    "swift": [(_after("func "), "function"), (_after("class "), "class"), (_after("struct "), "class"), (_after("enum "), "enum"), (_after("protocol "), "interface")],
    "ruby": [(_starts("def "), "function"), (_starts("class "), "class"), (_starts("module "), "object")],
    "php": [(_after("function "), "function"), (_after("class "), "class"), (_after("interface "), "interface"), (_after("trait "), "interface")],
    "shell": [(_starts("function "), "function"), (rf"^\s*{_IDENT}[^(]*?\(\)", "function")],
    "sql": [(rf"(?i)^(?>.*?create table ){_IDENT}", "object"), (rf"(?i)^(?!.*create table )(?>.*?create view ){_IDENT}", "object"), (rf"(?i)^(?!.*create (?:table|view) )(?>.*?create function ){_IDENT}", "function")],
    "json": [(r'^"([^"]*)"\s*:', "object")],
    "yaml": [(r"^(?!-)([^:]*[^:\s])\s*:(?!\s*//)", "object")],
    "toml": [(r"^\[([^\]]*)\]", "object"), (r"^(?!\[)([^=]*[^=\s])\s*=", "object")],
    "xml": [(rf"^<(?![/?!]){_IDENT}", "object")],
    "css": [(r"^(?!@)([^{]*[^{\s])\s*\{", "object")],
    "vue": [(rf"^(?=<script|<style)<{_IDENT}", "object"), (rf"^(?!<script|<style)(?>.*?function ){_IDENT}", "function"), (rf"^(?!<script|<style)(?>.*?class ){_IDENT}", "class"), (rf"^<(?![/?!]){_IDENT}", "object")],
}
_JVM = [(_after("class "), "class"), (_after("interface "), "interface"), (_after("enum "), "enum"), (_BEFORE_PAREN, "function")]
_C = [(_after("struct "), "class"), (_after("enum "), "enum"), (_BEFORE_PAREN, "function")]
RULES |= {"java": _JVM, "kotlin": _JVM, "csharp": _JVM, "c": _C, "cpp": _C, "ini": RULES["toml"], "scss": RULES["css"], "less": RULES["css"], "svelte": RULES["vue"], "astro": RULES["vue"]}
#: Languages whose names are taken as they stand, even where signs end them.
_RAW = ("json", "yaml", "toml", "ini", "css", "scss", "less")
IMPORTS = {"go": r"^import (.*)$", "java": r"^import (.*)$", "kotlin": r"^import (.*)$", "swift": r"^import (.*)$", "ruby": r"^require (.*)$", "php": r"^use (.*)$", "python": r"^(?:from (\S+)|import ([^, ]+))"}
COMMENTS = {"python": ("#",), "ruby": ("#",), "shell": ("#",), "yaml": ("#",), "sql": ("--",), "xml": ("<!--",)}


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _given(name: Column) -> Column:
    return _let(name, lambda n: F.when(n != "", n))


def _clean(name: Column) -> Column:
    """Without white space and then quotes and brackets at both ends; null if nothing is left."""
    ends = r"^[\"'`;:{()]+|[\"'`;:{()]+$"
    return _let(name, lambda n: F.when(n != "", _given(F.regexp_replace(trim_white(n), ends, ""))))


def _by_language(names, language: Column | str, make, otherwise: Column) -> Column:
    """make(name) for the language; with one given as a string, of that alone."""
    if isinstance(language, str):
        return make(language) if language in names else otherwise
    out = otherwise
    for name in names:
        out = F.when(language == name, make(name)).otherwise(out)
    return out


def is_comment(line: Column, language: Column | str) -> Column:
    starts = lambda marks: reduce(or_, [F.startswith(line, F.lit(m)) for m in marks])
    return _by_language(COMMENTS, language, lambda name: starts(COMMENTS[name]), starts(("//", "/*")))


def _named(given: Column, kind: str) -> Column:
    return _let(given, lambda g: F.when(g.isNotNull(), F.struct(g.alias("name"), F.lit(kind).alias("kind"))))


def _ruled(line: Column, name: str) -> Column:
    """struct<name, kind> by the first rule of a language that gives a name; a rule is tried once, and only after those before it."""
    found = []
    for pattern, kind in RULES[name]:
        text = F.regexp_extract(line, pattern, 1)
        if name in ("json", "toml", "ini") and pattern in (RULES["json"][0][0], RULES["toml"][0][0]):
            given = F.when(line.rlike(pattern), text)
        else:
            given = _given(text) if name in _RAW else _clean(text)
        found.append(_named(given, kind))
    return F.coalesce(*found)


def symbol_of(line: Column, language: Column | str) -> Column:
    """struct<name, kind> of a line without white space before it, or null; of one language if it is given as a string."""
    return _by_language(RULES, language, lambda name: _ruled(line, name), F.lit(None).cast("struct<name:string,kind:string>"))


def _imported(line: Column, name: str) -> Column:
    pattern = IMPORTS[name]
    said = F.regexp_extract(line, pattern, 1)
    if name == "python":
        said = F.concat(said, F.regexp_extract(line, pattern, 2))
    if name in ("go", "java", "kotlin", "swift"):
        said = F.regexp_replace(said, "^[\"';]+|[\"';]+$", "")
    return _clean(said)


def import_of(line: Column, language: Column | str) -> Column:
    """Name that a line imports, or null."""
    return _by_language(IMPORTS, language, lambda name: _imported(line, name), F.lit(None).cast("string"))


def _symbol(name: Column, kind: Column, line: Column, number: Column) -> Column:
    at = F.instr(line, name)
    column = F.when(at > 0, F.octet_length(line.substr(F.lit(1), at - 1)) + 1).otherwise(F.lit(1))
    return F.struct(
        name.alias("name"),
        kind.alias("kind"),
        number.cast("long").alias("start_line"),
        column.cast("long").alias("start_column"),
        number.cast("long").alias("end_line"),
        (F.greatest(F.octet_length(line), column) + 1).cast("long").alias("end_column"),
    )


def _tried(name: str) -> Column:
    """Of the lines of a file of one language, those that declare or import something: line, number, s, i."""
    nothing = F.lit(None).cast("struct<line:string,number:int,s:struct<name:string,kind:string>,i:string>")

    def one(line, at):
        told = lambda t: F.struct(line.alias("line"), (at + 1).alias("number"), symbol_of(t, name).alias("s"), import_of(t, name).alias("i"))
        return _let(trim_white_start(line), lambda t: F.when((t != "") & ~is_comment(t, name), told(t)).otherwise(nothing))

    return F.filter(F.transform("lines", one), lambda x: x["s"].isNotNull() | x["i"].isNotNull())


def line_symbols(files: DataFrame) -> DataFrame:
    """path, language, content to symbols; a file without any gives one named after it."""
    split = files.select("path", "language", lines("content").alias("lines"))
    # rules are tried inside an array function: as plain columns their generated code would be too long to compile.
    # The language is asked once a file, and each file is read once: one without a hit keeps a row of its own.
    none = F.array().cast("array<struct<line:string,number:int,s:struct<name:string,kind:string>,i:string>>")
    hits = _by_language(dict.fromkeys([*RULES, *IMPORTS]), F.col("language"), _tried, none)
    rows = split.select("path", F.coalesce(F.get("lines", F.lit(0)), F.lit("")).alias("first"), F.explode_outer(hits).alias("x"))
    rows = rows.select("path", "first", "x.line", "x.number", "x.s", "x.i")
    line, number, one = F.col("line"), F.col("number"), F.lit(1).cast("long")
    both = F.array(F.when(F.col("i").isNotNull(), _symbol(F.col("i"), F.lit("import"), line, number)), F.when(F.col("s").isNotNull(), _symbol(F.col("s.name"), F.col("s.kind"), line, number)))
    width = (F.greatest(F.octet_length("first"), F.lit(1)) + 1).cast("long")
    named = F.struct(stem("path").alias("name"), F.lit("object").alias("kind"), one.alias("start_line"), one.alias("start_column"), one.alias("end_line"), width.alias("end_column"))
    found = rows.select("path", F.explode(F.when(line.isNull(), F.array(named)).otherwise(F.filter(both, lambda x: x.isNotNull()))).alias("x")).select("path", "x.*")
    null = F.lit(None).cast("string")
    return found.select("path", "name", "kind", null.alias("parent"), null.alias("source"), "start_line", "start_column", "end_line", "end_column")
