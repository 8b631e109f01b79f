"""Database schemas from source files: DDL, Prisma models and document-store models.

A file is small and its parse is stateful, so parsers run on whole files in
Arrow batches; what they give is flat tables, merged and filtered by joins.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import provider_of
from ..functions.paths import base_name
from ..sources.tables import written
from .filters import is_model, is_provider_hint, is_sql_schema, schema_skips

COLUMN = "name data_type is_primary_key is_unique is_nullable default_value references_table references_column".split()
RELATION = "from_table from_column to_table to_column kind".split()
MANY_TO_ONE = "many-to-one"
_PARSED = "path string, provider string, body string"
_COLUMN_TYPE = "struct<name:string,data_type:string,is_primary_key:boolean,is_unique:boolean,is_nullable:boolean,default_value:string,references_table:string,references_column:string>"
_TABLE_TYPE = f"struct<name:string,columns:array<{_COLUMN_TYPE}>,primary_keys:array<string>,indexes:array<string>>"
_RELATION_TYPE = "struct<from_table:string,from_column:string,to_table:string,to_column:string,kind:string>"
_BODY = f"struct<tables:array<{_TABLE_TYPE}>,relationships:array<{_RELATION_TYPE}>>"


def _lines(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def _column(name, data_type, **more) -> dict:
    return dict.fromkeys(COLUMN) | {"name": name, "data_type": data_type, "is_primary_key": False, "is_unique": False, "is_nullable": True} | more


def _relation(*values) -> dict:
    return dict(zip(RELATION, (*values, MANY_TO_ONE)))


# --- DDL


def _unquote(x: str) -> str:
    return x.strip('"').strip("`").strip("[").strip("]")


def group_columns(text: str) -> list[str]:
    """Names in the first pair of parens."""
    m = re.search(r"\(([^)]*)\)", text)
    return [n for n in (_unquote(x.strip()) for x in m[1].split(",")) if n] if m else []


_TABLE_HEAD = re.compile(r"""create\x20table\s*(?:if\x20not\x20exists\s*)?"*`*\[*(?P<name>[^ (]*?)\]*`*"*(?=[ (]|$)""", re.I)


def table_name(line: str) -> str:
    """The name in a table's head, without the signs that quote it."""
    return _TABLE_HEAD.search(line)["name"]


def foreign_key(text: str, own: str) -> tuple[str, str, str] | None:
    """(column, table it leads to, column there) of a constraint; only the first column counts."""
    low = text.lower()
    at, to = low.find("foreign key"), low.find("references ")
    if at < 0 or to < 0 or not (local := group_columns(text[at:])):
        return None
    target = text[to + 11 :].strip()
    there = group_columns(target)
    return local[0], _unquote(re.split(r"[ (]", target, maxsplit=1)[0]) if target else own, there[0] if there else "id"


# How a line of a table begins that is no column.
_CONSTRAINT = ("constraint ", "foreign key", "unique", "check", "exclude", "index", "key ")


def sql_column(text: str) -> dict | None:
    words = text.split()
    if len(words) < 2:
        return None
    name, low = _unquote(words[0]), text.lower()
    if not name or name.lower() == "constraint":
        return None
    default = low.find(" default ")
    return _column(
        name, words[1], is_primary_key="primary key" in low, is_unique=" unique" in low, is_nullable="not null" not in low, default_value=text[default + 9 :].strip() if default >= 0 else None
    )


def parse_sql(text: str) -> dict:
    """Tables whose definition starts a line; a definition's lines end at `)` or `);`."""
    tables, relations = [], []
    todo = iter(_lines(text))
    for line in todo:
        head = line.strip()
        if not head.lower().startswith("create table") or not (name := table_name(head)):
            continue
        columns, keys, indexes = [], [], []
        for body in todo:
            part = body.strip().rstrip(",")
            low = part.lower()
            if part.startswith(");") or part == ")":
                break
            if low.startswith("primary key"):
                keys += group_columns(part)
            elif low.startswith(_CONSTRAINT):
                if found := foreign_key(part, name):
                    relations.append(_relation(name, *found))
                indexes.append(part)
            elif column := sql_column(part):
                keys += [column["name"]] * column["is_primary_key"]
                columns.append(column)
        tables.append({"name": name, "columns": columns, "primary_keys": keys, "indexes": indexes})
    return {"tables": tables, "relationships": relations}


# --- Prisma


def _in_brackets(text: str) -> list[str]:
    return [x.strip() for x in text.strip().lstrip("[").rstrip("]").split(",") if x.strip()]


_FIELD = re.compile(r"(?P<name>\S+)\s+(?P<type>\S+)")
# The attributes that are read.
_ATTRIBUTES = ("id", "unique", "default(", "relation(")


def prisma_field(line: str, model: str) -> tuple[dict, list[dict]] | None:
    """A field's column and relations; of a repeated attribute the first counts, and a list is cut at its first comma."""
    head = _FIELD.match(line.lstrip())
    if not head:
        return None
    said: dict[str, str] = {}
    for part in map(str.strip, line.split("@")[1:]):
        for known in _ATTRIBUTES:
            if part.startswith(known):
                said.setdefault(known, part[len(known) :].rstrip(")"))
    kind = head["type"].rstrip("?")
    column = _column(head["name"], kind, is_primary_key="id" in said, is_unique="unique" in said, is_nullable=head["type"].endswith("?"))
    if "default(" in said:
        column["default_value"] = said["default("]
    ends = dict(re.findall(r"(?:^|,)\s*(fields|references):([^,]*)", said.get("relation(", "")))
    local, there = (_in_brackets(ends.get(x, "")) for x in ("fields", "references"))
    if not local or not there:
        return column, []
    return column | {"references_table": kind, "references_column": there[0]}, [_relation(model, x, kind, there[0]) for x in local]


def parse_prisma(text: str) -> dict:
    tables, relations, model = [], [], None
    for line in map(str.strip, _lines(text)):
        if model is None:
            if line.startswith("model ") and line.endswith("{"):
                model = {"name": line.removeprefix("model ").rstrip("{").strip(), "columns": [], "primary_keys": [], "indexes": []}
                tables.append(model)
        elif line == "}":
            model = None
        elif line.startswith("@@"):
            model["indexes"].append(line)
        elif line and not line.startswith("//") and (found := prisma_field(line, model["name"])):
            model["columns"].append(found[0])
            model["primary_keys"] += [found[0]["name"]] * found[0]["is_primary_key"]
            relations += found[1]
    return {"tables": tables, "relationships": relations}


def prisma_provider(text: str) -> str:
    """The first provider line's value, whatever block it is in."""
    for line in map(str.strip, _lines(text)):
        if line.startswith("provider") and "=" in line:
            return line.split("=")[1].strip().strip('"')
    return "postgresql"


# --- document-store models

_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|[{}]""", re.S)


def brace_block(text: str, start: int) -> str | None:
    """What stands between the first brace from start and its partner; quotes and comments do not count."""
    open_at = text.find("{", start)
    depth = 0
    for m in _SKIP.finditer(text, open_at) if open_at >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == "}" and depth == 0:
            return text[open_at + 1 : m.start()]
    return None


def model_name(text: str, path: str) -> str:
    m = re.search(r"model\(\s*(['\"])(.*?)\1", text, re.S)
    if m and m.start() == text.find("model(") and m[2].strip():
        return m[2].strip()
    return path.rsplit("/", 1)[-1].replace(".model.ts", "").replace(".model.js", "") or "Model"


def document_relations(block: str, table: str) -> list[dict]:
    out, field = [], None
    for line in map(str.strip, _lines(block)):
        if ":" in line:
            name = line.split(":", 1)[0].strip().strip('"').strip("'")
            if name and name not in ("type", "ref", "required", "default"):
                field = name
        if "ref:" in line:
            said = line.split("ref:")[1].strip().lstrip('"').lstrip("'")
            target = re.split(r"[\"',}]", said, maxsplit=1)[0].strip()
            if field and target:
                out.append(_relation(table, field, target, "_id"))
    return out


def parse_model(text: str, path: str) -> dict | None:
    if "mongoose" not in text and "Schema" not in text:
        return None
    name, columns, relations = model_name(text, path), [], []
    at = text.find("export interface ")
    for line in map(str.strip, _lines(brace_block(text, at) or "")) if at >= 0 else ():
        line = line.rstrip(";")
        if ":" not in line or line.startswith("export interface"):
            continue
        left, right = line.split(":", 1)
        if field := left.strip().rstrip("?"):
            columns.append(_column(field, right.strip(), is_primary_key=field.lower() in ("id", "_id"), is_nullable="?" in left))
    at = text.find("new Schema(")
    for rel in document_relations(brace_block(text, at) or "", name) if at >= 0 else ():
        for column in columns:
            if column["name"] == rel["from_column"]:
                column |= {"references_table": rel["to_table"], "references_column": rel["to_column"]}
                break
        relations.append(rel)
    return {"tables": [{"name": name, "columns": columns, "primary_keys": [], "indexes": []}], "relationships": relations} if columns else None


# --- tables


def _run(kind: str):
    def run(batches):
        for batch in batches:
            rows = []
            for path, text, said in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if kind == "prisma":
                    rows.append((path, prisma_provider(text), json.dumps(parse_prisma(text))))
                elif kind == "sql":
                    rows.append((path, said, json.dumps(parse_sql(text))))
                elif found := parse_model(text, path):
                    rows.append((path, "mongodb", json.dumps(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "provider", "body"])

    return run


def parse_schema_files(files: DataFrame, kind: str) -> DataFrame:
    """path, content of files of one kind (sql, prisma, model) to path, provider, tables, relationships."""
    # what a connection string names goes through the parser beside its text: a join by path would bring it to the driver, and pair up equal paths
    said = F.coalesce(provider_of("content"), F.lit("sql")) if kind == "sql" else F.lit(None).cast("string")
    parsed = files.select("path", "content", said.alias("said")).mapInArrow(_run(kind), _PARSED)
    return parsed.select("path", "provider", F.from_json("body", _BODY).alias("b")).select("path", "provider", "b.tables", "b.relationships")


def tables_of(schemas: DataFrame) -> DataFrame:
    return schemas.select("path", F.posexplode("tables").alias("at", "t")).select("path", "at", F.col("t.name").alias("table_name"), "t.columns", "t.primary_keys", "t.indexes")


def _placed_columns(schemas: DataFrame) -> DataFrame:
    """columns_of with at, the table's place in its file."""
    rows = tables_of(schemas).select("path", "at", "table_name", F.posexplode("columns").alias("position", "c"))
    return rows.select("path", "at", "table_name", "position", "c.*")


def columns_of(schemas: DataFrame) -> DataFrame:
    return _placed_columns(schemas).drop("at")


def relationships_of(schemas: DataFrame) -> DataFrame:
    return schemas.select("path", F.posexplode("relationships").alias("position", "r")).select("path", "position", "r.*")


def existing_relationships(relationships: DataFrame, columns: DataFrame) -> DataFrame:
    """Relationships whose own column is one of its table's (of the same project, where both have that column)."""
    own = ["project"] if "project" in relationships.columns and "project" in columns.columns else []
    have = columns.select(*own, F.col("table_name").alias("from_table"), F.col("name").alias("from_column")).distinct()
    return relationships.join(have, [*own, "from_table", "from_column"], "left_semi")


def _first_wins(rows: DataFrame, keys, order) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(own)).where("_rank = 1").drop("_rank")


def merge_schemas(schemas: DataFrame, project: Column | None = None) -> dict[str, DataFrame]:
    """Schemas of many files as one, in path order: columns, keys and indexes of a table's first mention win.

    Keys: columns, primary_keys, indexes, relationships, summary (provider, sources).  project, an expression of the path,
    merges the files of each project on their own; the tables then have it as a column.
    """
    apart = [] if project is None else ["project"]
    marked = lambda rows: rows if project is None else rows.withColumn("project", project)
    first = lambda rows, keys, order: _first_wins(marked(rows), [*apart, *keys], order)
    tables = tables_of(schemas)
    columns = first(_placed_columns(schemas), ["table_name", "name"], ["path", "at", "position"])
    part = lambda name: tables.select("path", "table_name", "at", F.posexplode(name).alias("position", "value"))
    keys = first(part("primary_keys"), ["table_name", "value"], ["path", "at", "position"])
    indexes = first(part("indexes"), ["table_name", "value"], ["path", "at", "position"])
    relations = first(relationships_of(schemas), RELATION, ["path", "position"])
    full = marked(schemas.where(F.size("tables") > 0))
    named = F.min_by("provider", F.when(F.col("provider") != "sql", F.col("path")))
    told = [F.coalesce(named, F.lit("sql")).alias("provider"), F.sort_array(F.collect_set("path")).alias("sources")]
    summary = full.groupBy(*apart).agg(*told) if apart else full.agg(*told)
    return {"columns": columns, "primary_keys": keys, "indexes": indexes, "relationships": relations, "summary": summary}


MOST_DEPTH = 6


def detect_schema(files: DataFrame) -> tuple[str | None, DataFrame | None]:
    """(provider, schemas) of a project's files (path relative to its root, content).

    A Prisma schema goes first, then SQL files with tables, then models, then a
    connection string, which names a provider without tables.
    """
    low = F.lower(base_name("path"))
    direct = F.col("path").isin("prisma/schema.prisma", "schema.prisma")
    rows = files.where((~schema_skips("path") | direct) & (F.size(F.split("path", "/")) <= MOST_DEPTH))
    prisma = rows.where(F.endswith(low, F.lit(".prisma")))
    rank = F.when(F.col("path") == "prisma/schema.prisma", 0).when(F.col("path") == "schema.prisma", 1).otherwise(2)
    one = prisma.orderBy(rank, "path").limit(1)
    found = parse_schema_files(one, "prisma")
    first = found.select("provider").head(1)
    if first:
        return first[0]["provider"], found
    found = written(parse_schema_files(rows.where(is_sql_schema("path")), "sql").where(F.size("tables") > 0), "sql-schemas")  # parsed once for what follows
    if found.head(1):
        return merge_schemas(found)["summary"].select("provider").first()["provider"], found  # without the list of all paths
    found = written(parse_schema_files(rows.where(is_model("path") & ~is_sql_schema("path")), "model"), "model-schemas")
    if found.head(1):
        return "mongodb", found
    hint = rows.where(is_provider_hint("path")).select("path", provider_of("content").alias("provider")).where("provider is not null").orderBy("path").head(1)
    return (hint[0]["provider"], None) if hint else (None, None)
