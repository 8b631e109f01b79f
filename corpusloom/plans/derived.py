"""Queries over sources that are derived from table rows: one file of each kind for each row, parsed as a whole.

A template is a source in which {k} stands for a row's key, six digits long; its expected rows, beside it, are the
same for every key, and SQL puts each row's key in their place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..operators import filters, schemas, snapshot, views
from ..operators.symbols import parse_files
from ..sources.files import NOT_TEXT, decode, root_scores
from .queries import query, table

# The templates.
SCRIPT = """// note on function hidden{k}() {}
import React from 'react';
import { helper{k}, load as fetch{k}, type Row } from './helper{k}';
import * as util from "../util";

export interface Account{k} { id: string; tags: string[] }
type AccountId{k} = Account{k}['id'];
export const enum Phase{k} { Idle, Busy }
export default class Store{k} extends Base {
  private cache = new Map();
  get size() { return 1; }
  async find<T>(id: string): Promise<T> { return this.get(id); }
}
export function save{k}(row: Account{k}) { return row; }
const Panel{k} = ({ a }: { a: string }) => { return <main>{a}</main>; };
const format{k} = function (x) { return x; };
export const api{k} = {
  read() { return 1; },
  write: async (x) => x,
  limit: 3,
};
export { save{k} as store{k}, Panel{k} };
export { Button, Card as Tile{k} } from './ui';
export * from './all{k}';
"""
PYTHON = """import os, sys as s
from a{k}.b import c, d as e

class A{k}(B):
    def run{k}(self):
        def inner(): pass

async def go{k}(): pass
"""
SQL = """-- shop of {k}
CREATE TABLE IF NOT EXISTS "buyers{k}" (
  id INTEGER PRIMARY KEY,
  mail TEXT NOT NULL UNIQUE,
  price DECIMAL(10, 2) DEFAULT 0
);

create table orders{k} (
  id INTEGER,
  buyer_id INTEGER NOT NULL,
  unique_code TEXT,
  PRIMARY KEY (id),
  CONSTRAINT fk FOREIGN KEY (buyer_id) REFERENCES buyers{k} (id)
);
"""
PRISMA = """datasource db {
  provider = "mysql"
}
model Author{k} {
  id    Int     @id @default(autoincrement())
  mail  String? @unique
  books Book{k}[]
  @@index([mail])
}
model Book{k} {
  id       Int @id
  // comment
  authorId Int
  author   Author{k} @relation(fields: [authorId], references: [id])
}
"""
MODEL = """import { Schema, model } from 'mongoose';
export interface INote{k} extends Document {
  owner: Schema.Types.ObjectId;
  title?: string; // } not a brace
  _id: string;
}
const NoteSchema = new Schema({
  owner: { type: Schema.Types.ObjectId, ref: 'Person{k}', required: true },
  title: { type: String, default: "}" },
});
export default models.Note{k} || model('Note{k}', NoteSchema);
"""
LINES = {
    'rs': '// fn no()\npub struct Row{k};\npub fn go{k}() {}\nenum Kind{k} { A }\ntrait Able{k} {}\nuse std::fmt;\n',
    'go': 'package main\n\nimport "fmt"\n\nfunc Run{k}() {\n}\ntype Row{k} struct {\n}\n',
    'java': 'import a.b.C{k};\npublic class T{k} {\n  void run{k}(int x) {\n  }\n}\ninterface I{k} {\n}\n',
    'swift': 'import UIKit\nstruct S{k} {\n  func run{k}() {\n  }\n}\n',
    'rb': "require 'json'\nmodule M{k}\n  class C{k}\n    def run{k}\n    end\n  end\nend\n",
    'php': '<?php\nuse A\\B{k};\nclass C{k} {\n  public function run{k}() {\n  }\n}\n',
    'c': '#include <stdio.h>\nstruct row{k} {\n};\nint run{k}(int x) {\n  return x;\n}\n',
    'sh': '#!/bin/sh\n# note\nrun{k}() {\n  echo x\n}\nfunction stop{k} {\n}\n',
    'sql': '-- note\nCREATE TABLE t{k} (id INT);\ncreate view v{k} as select 1;\n',
    'yaml': '# note\nkey{k}: v\n- item: x\nother{k}:\n',
    'toml': '[part{k}]\nname = 1\n',
    'css': '.box{k} {\n}\n#id{k} {\n}\n@media print {\n}\n',
    'vue': '<template>\n  <main></main>\n</template>\n<script>\nfunction run{k}() {\n}\n</script>\n',
    'html': '<html>\n<body>\n<main id="x">\n</main>\n',
    'json': '{\n  "name{k}": 1,\n  "size": 2\n}\n',
    'kt': 'import a.b\nclass K{k} {\n  fun run{k}() {\n  }\n}\n',
    'md': '# nothing\n',
}

# Path, name, kind, parent, source, start line and column, end line and column of each symbol.
SYMBOLS = """
src/{k}.c|row{k}|class|||2|8|2|19
src/{k}.c|run{k}|function|||4|5|4|23
src/{k}.css|.box{k}|object|||1|1|1|13
src/{k}.css|#id{k}|object|||3|1|3|12
src/{k}.go|fmt|import|||3|9|3|13
src/{k}.go|Run{k}|function|||5|6|5|19
src/{k}.go|Row{k}|class|||7|6|7|24
src/{k}.java|a.b.C{k}|import|||1|8|1|20
src/{k}.java|T{k}|class|||2|14|2|23
src/{k}.java|run{k}|function|||3|8|3|26
src/{k}.java|I{k}|interface|||6|11|6|20
src/{k}.json|name{k}|object|||2|4|2|19
src/{k}.json|size|object|||3|4|3|12
src/{k}.kt|a.b|import|||1|8|1|11
src/{k}.kt|K{k}|class|||2|7|2|16
src/{k}.kt|run{k}|function|||3|7|3|20
src/{k}.php|A\\B{k}|import|||2|5|2|15
src/{k}.php|C{k}|class|||3|7|3|16
src/{k}.php|run{k}|function|||4|19|4|32
src/{k}.py|os|import|||1|1|1|20
src/{k}.py|sys|import|||1|1|1|20
src/{k}.py|a{k}.b|import|||2|1|2|32
src/{k}.py|c|import|||2|1|2|32
src/{k}.py|d|import|||2|1|2|32
src/{k}.py|A{k}|class|||4|1|6|26
src/{k}.py|run{k}|function|||5|5|6|26
src/{k}.py|inner|function|||6|9|6|26
src/{k}.py|go{k}|function|||8|1|8|27
src/{k}.rb|json|import|||1|10|1|15
src/{k}.rb|M{k}|object|||2|8|2|15
src/{k}.rb|C{k}|class|||3|9|3|16
src/{k}.rb|run{k}|function|||4|9|4|18
src/{k}.rs|Row{k}|class|||2|12|2|22
src/{k}.rs|go{k}|function|||3|8|3|21
src/{k}.rs|Kind{k}|enum|||4|6|4|22
src/{k}.rs|Able{k}|interface|||5|7|5|20
src/{k}.sh|run{k}|function|||3|1|3|14
src/{k}.sh|stop{k}|function|||6|10|6|22
src/{k}.sql|t{k}|object|||2|14|2|31
src/{k}.sql|v{k}|object|||3|13|3|33
src/{k}.swift|UIKit|import|||1|8|1|13
src/{k}.swift|S{k}|class|||2|8|2|17
src/{k}.swift|run{k}|function|||3|8|3|21
src/{k}.toml|part{k}|object|||1|2|1|13
src/{k}.toml|name|object|||2|1|2|9
src/{k}.tsx|react|import||react|2|1|2|27
src/{k}.tsx|./helper{k}|import||./helper{k}|3|1|3|78
src/{k}.tsx|helper{k}|import||./helper{k}|3|10|3|22
src/{k}.tsx|fetch{k}|import||./helper{k}|3|24|3|43
src/{k}.tsx|Row|import||./helper{k}|3|50|3|53
src/{k}.tsx|../util|import||../util|4|1|4|33
src/{k}.tsx|util|import||../util|4|8|4|17
src/{k}.tsx|Account{k}|export|||6|1|6|62
src/{k}.tsx|Account{k}|interface|||6|8|6|62
src/{k}.tsx|AccountId{k}|type_alias|||7|1|7|44
src/{k}.tsx|Phase{k}|export|||8|1|8|45
src/{k}.tsx|Phase{k}|enum|||8|8|8|45
src/{k}.tsx|Store{k}|export|||9|1|13|2
src/{k}.tsx|Store{k}|class|||9|16|13|2
src/{k}.tsx|Store{k}.size|method|Store{k}||11|3|11|27
src/{k}.tsx|Store{k}.find|method|Store{k}||12|3|12|65
src/{k}.tsx|save{k}|export|||14|1|14|63
src/{k}.tsx|save{k}|function|||14|8|14|63
src/{k}.tsx|Panel{k}|component|||15|7|15|76
src/{k}.tsx|format{k}|function|||16|7|16|49
src/{k}.tsx|api{k}|export|||17|1|21|3
src/{k}.tsx|api{k}|object|||17|14|21|3
src/{k}.tsx|api{k}.read|method|api{k}||18|3|18|23
src/{k}.tsx|api{k}.write|method|api{k}||19|3|19|24
src/{k}.tsx|store{k}|export|||22|10|22|35
src/{k}.tsx|Panel{k}|export|||22|37|22|48
src/{k}.tsx|Button|export||./ui|23|10|23|16
src/{k}.tsx|Tile{k}|export||./ui|23|18|23|36
src/{k}.tsx|*|export||./all{k}|24|1|24|29
src/{k}.vue|template|object|||1|2|1|11
src/{k}.vue|main|object|||2|4|2|16
src/{k}.vue|script|object|||4|2|4|9
src/{k}.vue|run{k}|function|||5|10|5|23
src/{k}.yaml|key{k}|object|||2|1|2|13
src/{k}.yaml|other{k}|object|||4|1|4|13
"""
# Path, table, position, name, type, primary, nullable, unique, default, table and column referred to.
COLUMNS = """
db/{k}.sql|buyers{k}|0|id|INTEGER|True|True|False|||
db/{k}.sql|buyers{k}|1|mail|TEXT|False|False|True|||
db/{k}.sql|buyers{k}|2|price|DECIMAL(10,|False|True|False|0||
db/{k}.sql|orders{k}|0|id|INTEGER|False|True|False|||
db/{k}.sql|orders{k}|1|buyer_id|INTEGER|False|False|False|||
prisma/{k}.prisma|Author{k}|0|id|Int|True|False|False|autoincrement(||
prisma/{k}.prisma|Author{k}|1|mail|String|False|True|True|||
prisma/{k}.prisma|Author{k}|2|books|Book{k}[]|False|False|False|||
prisma/{k}.prisma|Book{k}|0|id|Int|True|False|False|||
prisma/{k}.prisma|Book{k}|1|authorId|Int|False|False|False|||
prisma/{k}.prisma|Book{k}|2|author|Author{k}|False|False|False||Author{k}|id
models/{k}.model.ts|Note{k}|0|owner|Schema.Types.ObjectId|False|False|False||Person{k}|_id
models/{k}.model.ts|Note{k}|1|title|string; // } not a brace|False|True|False|||
models/{k}.model.ts|Note{k}|2|_id|string|True|False|False|||
"""
# Path, from table and column, to table and column, kind.
RELATIONS = """
db/{k}.sql|orders{k}|buyer_id|buyers{k}|id|many-to-one
prisma/{k}.prisma|Book{k}|authorId|Author{k}|id|many-to-one
models/{k}.model.ts|Note{k}|owner|Person{k}|_id|many-to-one
"""


def dealt_parts(spark, sf_dir: str):
    """p_partkey, dealt out before any text is made of it: part may be one small file, which is one task."""
    return table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def keys(spark, sf_dir: str):
    """k, rest: six digits of each part's number, and those behind them (for the first million of parts none)."""
    number = F.col("p_partkey").cast("string")
    return dealt_parts(spark, sf_dir).select(F.lpad(number, 6, "0").alias("k"), F.substring(number, 7, 20).alias("rest"))


def filled(rows, **templates: str):
    """k and each template with the key in its place."""
    return rows.select("k", *[F.replace(F.lit(t), F.lit("{k}"), F.col("k")).alias(name) for name, t in templates.items()])


def files(spark, sf_dir: str, sources: dict[str, str]):
    """path, content: every source for every key; {rest} stands for the digits that the key lacks."""
    put = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), F.col("k")), F.lit("{rest}"), F.col("rest"))
    made = F.array(*[F.struct(put(p).alias("path"), put(c).alias("content")) for p, c in sources.items()])
    return keys(spark, sf_dir).select(F.explode(made).alias("f")).select("f.path", "f.content")


def literal(value) -> str:
    if value is None or value == "":
        return "NULL"
    return str(value).upper() if value in (True, False, "True", "False") else "'" + str(value).replace("'", "''") + "'"


def expected(rows, columns: str, numbers: str = "") -> str:
    """SQL of the rows for every key; rows are tuples, columns their names, of which numbers are whole numbers."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    flags = {n for i, n in enumerate(names) if all(str(r[i]) in ("True", "False") for r in rows)}
    cell = lambda n: n if n in flags else f"CAST({n} AS BIGINT) AS {n}" if n in numbers.split() else f"replace({n}, '{{k}}', k) AS {n}"
    return f"SELECT {', '.join(map(cell, names))} FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS k FROM part), (VALUES {values}) v({columns.replace(' ', ', ')})"


def told(text_: str) -> list[tuple]:
    return [tuple(line.split("|")) for line in text_.strip().split("\n")]


_RANGE = "start_line start_column end_line end_column"


@query(expected(told(SYMBOLS), f"path name kind parent source {_RANGE}", _RANGE))
def source_symbols(spark, sf_dir):
    """All that the parsers find in a source of each language: names, kinds, parents, sources and ranges."""
    sources = {"src/{k}.tsx": SCRIPT, "src/{k}.py": PYTHON} | {f"src/{{k}}.{end}": s for end, s in LINES.items()}
    found = parse_files(files(spark, sf_dir, sources))
    return found.select("path", "name", "kind", "parent", "source", *[F.col(c).cast("long").alias(c) for c in _RANGE.split()])


_SCHEMAS = (("sql", "db/{k}.sql", SQL), ("prisma", "prisma/{k}.prisma", PRISMA), ("model", "models/{k}.model.ts", MODEL))


def _schemas(spark, sf_dir, below: str = ""):
    found = [schemas.parse_schema_files(files(spark, sf_dir, {below + path: source}), kind) for kind, path, source in _SCHEMAS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _merged(spark, sf_dir):
    """Every schema mentioned twice and merged.  From part 1,000,000 on several parts share six digits: the digits behind them are the project that a schema lies in."""
    found = _schemas(spark, sf_dir, "{rest}/")
    again = found.withColumn("path", F.regexp_replace("path", "^([^/]*)/", "$1/z/"))
    return schemas.merge_schemas(found.unionByName(again), F.split("path", "/")[0])


@query(expected(told(COLUMNS), "path table_name position name data_type is_primary_key is_nullable is_unique default_value references_table references_column", "position"))
def source_columns(spark, sf_dir):
    """Columns of DDL, Prisma schemas and document models."""
    found = schemas.columns_of(_schemas(spark, sf_dir))
    shown = found.select("path", "table_name", F.col("position").cast("long").alias("position"), "name", "data_type", "is_primary_key", "is_nullable", "is_unique", "default_value", "references_table", "references_column")
    return shown


@query(expected(told(RELATIONS), "path from_table from_column to_table to_column kind"))
def source_relations(spark, sf_dir):
    return schemas.relationships_of(_schemas(spark, sf_dir)).select("path", "from_table", "from_column", "to_table", "to_column", "kind")


@query(expected([("db/{k}.sql", "sql"), ("prisma/{k}.prisma", "mysql"), ("models/{k}.model.ts", "mongodb")], "path provider"))
def source_providers(spark, sf_dir):
    return _schemas(spark, sf_dir).select("path", "provider")


@query(expected([("buyers{k}", "id"), ("orders{k}", "id"), ("Author{k}", "id"), ("Book{k}", "id")], "table_name value"))
def merged_keys(spark, sf_dir):
    """Primary keys of the schemas of all files, each mentioned twice."""
    return _merged(spark, sf_dir)["primary_keys"].select("table_name", "value")


@query(expected([r[1:] for r in told(RELATIONS)], "from_table from_column to_table to_column kind"))
def merged_relations(spark, sf_dir):
    """Relationships of the merged schemas whose own column exists."""
    merged = _merged(spark, sf_dir)
    return schemas.existing_relationships(merged["relationships"], merged["columns"]).select(*schemas.RELATION)


# Path, whether it is indexed, searched, watched, a schema in SQL, a source of the graph.
PATHS = [
    ("{k}/src/App.tsx", True, True, True, False, True), ("{k}/README.md", True, True, True, False, False), ("docs/wiki/{k}.md", False, True, False, False, False),
    ("{k}/node_modules/a/index.ts", False, False, False, False, True), (".env.{k}", False, False, False, False, False), ("a/{k}.key", False, False, False, False, False),
    ("{k}/Makefile", True, True, True, False, False), ("dist/{k}.js", False, False, False, False, True), ("{k}.scala", False, True, False, False, False), ("lib/{k}.mjs", True, False, True, False, True),
    ("conf/{k}.ini", True, False, True, False, True), ("{k}.png", False, False, False, False, False), ("db/{k}/init.sql", True, True, True, True, True), ("a/.hidden/{k}.py", False, False, True, False, True),
]


@query(expected(PATHS, "path indexable searchable watched sql_schema graph_source"))
def part_path_filters(spark, sf_dir):
    rows = files(spark, sf_dir, {p[0]: "" for p in PATHS}).select("path")
    return rows.select("path", filters.is_indexable("path").alias("indexable"), filters.is_searchable("path").alias("searchable"), filters.is_watched("path").alias("watched"), filters.is_sql_schema("path").alias("sql_schema"), filters.is_graph_source("path").alias("graph_source"))


# Path as given and normalised.
RAW = [("./{k}/../{k}/App.tsx", "{k}/App.tsx"), ("../{k}/a", "../{k}/a"), ("a//{k}/./c", "a/{k}/c"), ("{k}/b/../../..", ".."), ("/root/ws/{k}.py", "{k}.py"), ("a\\{k}", "a/{k}")]


@query(expected(RAW, "raw path"))
def part_normalized_paths(spark, sf_dir):
    rows = files(spark, sf_dir, {p: "" for p, _ in RAW}).select(F.col("path").alias("raw"))
    return rows.select("raw", paths.normalize("raw", "/root/ws").alias("path"))


# Path, language, colour.
LANGUAGES = [("a/{k}.rs", "rust", "warning"), ("{k}.ts", "typescript", "accent"), ("{k}.tsx", "tsx", "accent"), ("x/{k}.py", "python", "muted"), ("{k}.go", "go", "muted"), ("{k}.md", None, "success"), ("{k}.json", "json", "warning"), ("{k}.unknown", None, "muted")]


@query(expected(LANGUAGES, "path language color"))
def part_languages(spark, sf_dir):
    rows = files(spark, sf_dir, {p: "" for p, *_ in LANGUAGES})
    return rows.select("path", paths.language("path").alias("language"), labels.file_color("path").alias("color"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'number' WHEN p_partkey % 3 = 1 THEN 'string' ELSE 'Date' END || CASE WHEN p_partkey % 2 = 0 THEN ' | null' ELSE '' END AS shown,
 CASE WHEN p_partkey % 5 = 0 THEN 'PK, NOT NULL' WHEN p_partkey % 2 = 0 THEN 'UNIQUE, FK -> nation.n_nationkey' ELSE 'UNIQUE, NOT NULL, FK -> nation.n_nationkey' END AS constraints,
 CASE WHEN p_partkey % 3 = 0 THEN 'postgresql' WHEN p_partkey % 3 = 1 THEN 'mysql' END AS provider FROM part""")
def part_column_labels(spark, sf_dir):
    """Types, constraints and providers by each part's number."""
    n = F.col("p_partkey")
    kind = F.when(n % 3 == 0, "BIGINT").when(n % 3 == 1, "varchar(10)").otherwise("TIMESTAMP")
    primary, nullable = n % 5 == 0, n % 2 == 0
    url = F.when(n % 3 == 0, "URL=postgres://h/").when(n % 3 == 1, "mysql://u@h/").otherwise("file of ")
    other = lambda c: F.when(~primary, F.lit(c))
    said = labels.constraints(primary, ~primary, F.when(primary, False).otherwise(nullable), F.lit(None).cast("string"), other("nation"), other("n_nationkey"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.typescript_type(kind, nullable).alias("shown"), said.alias("constraints"), labels.provider_of(F.concat(url, n.cast("string"))).alias("provider"))


@query(
    f"""SELECT 'docs/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 10 = 3 THEN 'docs/' || doc_id || '.txt: {NOT_TEXT}' END AS error,
 CASE WHEN doc_id % 10 <> 3 THEN md5(text) END AS content_md5 FROM documents"""
)
def decoded_files(spark, sf_dir):
    """Documents as bytes, each tenth with a byte that is no UTF-8: an error of its own, the others as text."""
    raw = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 10 == 3, F.concat(raw, F.unhex(F.lit("E9")))).otherwise(raw)
    found = decode(table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), content.alias("content")))
    return found.select("path", "error", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    """WITH a AS (SELECT doc_id % 4 = 0 AS source, doc_id % 12 = 0 AS bad FROM documents)
SELECT CAST(count(*) AS BIGINT) AS files_seen, CAST(count_if(source AND NOT bad) AS BIGINT) AS files_changed, CAST(count_if(NOT source) AS BIGINT) AS files_skipped, 0::BIGINT AS files_deleted,
 CAST(count_if(bad) AS BIGINT) AS errors, 'error' AS run_status FROM a"""
)
def failed_run(spark, sf_dir):
    """A run over new files of which a quarter are sources, and a third of these not UTF-8."""
    n = F.col("doc_id")
    path = F.concat(F.lit("src/"), n.cast("string"), F.when(n % 4 == 0, ".rs").otherwise(".md"))
    content = F.when(n % 12 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    raw = table(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content"))
    scanned = snapshot.describe_files(raw)
    none = scanned.limit(0).withColumn("status", F.lit(""))
    actions = snapshot.file_actions(snapshot.classify(scanned, none), scanned.limit(0)).join(decode(raw).select("path", "error"), "path")
    return snapshot.run_summary(actions.withColumn("error", F.when(F.col("parse"), F.col("error"))))


@query(
    """SELECT p_partkey, 'parts/' || p_partkey || '.rs' AS path, 'T' || p_partkey AS title, '' AS snippet, CASE WHEN p_partkey % 2 = 0 THEN 'parts/' || p_partkey || '.rs:L' || p_partkey || '-L' || (p_partkey + 2) ELSE 'parts/' || p_partkey || '.rs' END AS label,
 p_partkey / 1000000.0 AS score FROM part WHERE p_partkey % 7 <> 0"""
)
def part_citations(spark, sf_dir):
    """Citations read back from JSON; those without a path go."""
    n = F.col("p_partkey")
    lines = F.when(n % 2 == 0, F.concat(F.lit(',"startLine":'), n.cast("string"), F.lit(',"endLine":'), (n + 2).cast("string"))).otherwise("")
    path = F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("parts/"), n.cast("string"), F.lit(".rs")))
    said = F.concat(F.lit('[{"path":"'), path, F.lit('","title":"T'), n.cast("string"), F.lit('","score":'), F.format_string("%.6f", n / 1_000_000), lines, F.lit("}]"))
    rows = views.normalize_citations(table(spark, sf_dir, "part").select(said.alias("said")), "said")
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    return rows.select(number.alias("p_partkey"), "path", "title", "snippet", paths.line_label("path", "start_line", "end_line").alias("label"), "score")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Struct' WHEN p_partkey % 4 = 1 THEN 'Function' WHEN p_partkey % 4 = 2 THEN 'Enum' ELSE 'Code Block' END AS kind,
 CASE WHEN p_partkey % 3 = 0 THEN 'Database' WHEN p_partkey % 3 = 1 THEN 'API/Network' ELSE 'In-process' END AS flow,
 'Implements `n' || p_partkey || '` behavior with source-backed logic.' AS intent, 'This block handles `n' || p_partkey || '` and contributes to the module workflow.' AS logic FROM part"""
)
def part_explanations(spark, sf_dir):
    n = F.col("p_partkey")
    head = F.when(n % 4 == 0, "struct ").when(n % 4 == 1, "pub FN ").when(n % 4 == 2, "enum ").otherwise("let ")
    tail = F.when(n % 3 == 0, " SELECT 1").when(n % 3 == 1, " http call").otherwise(" x")
    title = F.concat(F.lit("n"), n.cast("string"))
    snippet = F.concat(head, title, tail)
    return table(spark, sf_dir, "part").select("p_partkey", labels.citation_kind(snippet).alias("kind"), labels.interaction(snippet).alias("flow"), labels.intent_explanation(title).alias("intent"), labels.plain_logic(title, snippet).alias("logic"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 135 WHEN 1 THEN -25 WHEN 2 THEN 0 ELSE -125 END AS score, FALSE AS git_only FROM part")
def part_root_scores(spark, sf_dir):
    """Scores of folders that may be a project's root."""
    n, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    folder = F.concat(F.lit("/w/"), key, F.when(n % 4 == 1, "/dist").when(n % 4 == 3, "/node_modules").otherwise("/app"))
    entries = F.when(n % 4 == 0, F.array(*map(F.lit, ("package.json", ".git", "README.md")))).when(n % 4 == 1, F.array(F.lit("a.js"))).otherwise(F.array().cast("array<string>"))
    found = root_scores(table(spark, sf_dir, "part").select(folder.alias("folder"), entries.alias("entries")))
    return found.select(F.regexp_extract("folder", r"/w/(\d+)/", 1).cast("long").alias("p_partkey"), "score", "git_only")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'parse,http,part' || p_partkey || ',parsehttppart' || p_partkey ELSE 'snake_part_' || p_partkey || ',snake_part_' || p_partkey END AS tokens FROM part")
def part_identifier_tokens(spark, sf_dir):
    n = F.col("p_partkey")
    name = F.concat(F.when(n % 2 == 0, "parseHTTPPart").otherwise("snake_part_"), n.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tokens(name), ",").alias("tokens"))
