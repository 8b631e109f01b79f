"""Registered queries of sources that differ from row to row (how many declarations, where they stand, what stands before them), and of projects whose schemas are detected."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schemas
from ..operators.symbols import parse_files
from .derived import dealt_parts
from .queries import query

# Fixed values, by extension: a line that declares nothing, a unit of declarations (@ stands for its own number), and what
# the unit declares: name, kind, parent and line in the unit.
UNITS = {
    "go": ("// func No() {}\n", "func F@(a int) int {\n\treturn a\n}\ntype T@ struct {\n\tn int\n}\n", (("F@", "function", None, 1), ("T@", "class", None, 4))),
    "rs": ("// fn no() {}\n", "pub struct R@;\n\npub fn g@(x: i32) -> i32 {\n    x\n}\n", (("R@", "class", None, 1), ("g@", "function", None, 3))),
    "java": ("// class No {}\n", "class C@ {\n  void m@(int x) {\n  }\n}\n", (("C@", "class", None, 1), ("m@", "function", None, 2))),
    "py": ("# def no(): pass\n", 'class P@(Base):\n    """def no():\n    pass"""\n    def q@(self):\n        return 1\n', (("P@", "class", None, 1), ("q@", "function", None, 4))),
    "ts": ("// function no() {}\n", 'function f@(x: string) {\n  return `function no() { ${x} }`;\n}\nclass K@ {\n  go@() { return "class No {}"; }\n}\n', (("f@", "function", None, 1), ("K@", "class", None, 4), ("K@.go@", "method", "K@", 5))),
    "rb": ("# def no\n", "class C@\n  def r@\n  end\nend\n", (("C@", "class", None, 1), ("r@", "function", None, 2))),
    "php": ("// function no() {}\n", "class C@ {\n  public function r@() {\n  }\n}\n", (("C@", "class", None, 1), ("r@", "function", None, 2))),
    "kt": ("// fun no() {}\n", "class K@ {\n  fun r@() {\n  }\n}\n", (("K@", "class", None, 1), ("r@", "function", None, 2))),
    "swift": ("// func no() {}\n", "struct S@ {\n  func r@() {\n  }\n}\n", (("S@", "class", None, 1), ("r@", "function", None, 2))),
    "c": ("// int no(int x) {\n", "int r@(int x) {\n  return x;\n}\n", (("r@", "function", None, 1),)),
    "sh": ("# no() {\n", "r@() {\n  echo x\n}\n", (("r@", "function", None, 1),)),
    "sql": ("-- CREATE TABLE no (id INT);\n", "CREATE TABLE t@ (id INT);\n", (("t@", "object", None, 1),)),
    "css": ("/* .no { } */\n", ".b@ {\n}\n", ((".b@", "object", None, 1),)),
    "toml": ("# [no]\n", "[p@]\n", (("p@", "object", None, 1),)),
    "yaml": ("# no: 1\n", "k@: v\n", (("k@", "object", None, 1),)),
}
_ROWS = ", ".join(
    f"('{end}', {unit.count(chr(10))}, '{name}', '{kind}', {'NULL' if parent is None else chr(39) + parent + chr(39)}, {at})" for end, (_, unit, told) in UNITS.items() for name, kind, parent, at in told
)


@query(
    f"""WITH v(ext, height, name, kind, parent, place) AS (VALUES {_ROWS}),
p AS (SELECT p_partkey AS k, unnest(range(0, p_partkey % 5 + 1)) AS i FROM part),
r AS (SELECT k, i, k || '_' || i AS n, k % 4 + list_sum(list_transform(range(0, i + 1), lambda j: (k + j) % 3)) AS ahead FROM p)
SELECT 'src/' || k || '.' || ext AS path, replace(name, '@', n) AS name, kind, replace(parent, '@', n) AS parent, CAST(ahead + i * height + place AS BIGINT) AS start_line FROM r, v"""
)
def varied_symbols(spark, sf_dir):
    """A source of each language for each part: part k has k mod 4 lines that only look like declarations, and k mod 5 + 1 units, unit i behind (k + i) mod 3 empty lines."""
    k = F.col("p_partkey").cast("long")
    number = lambda i: F.concat(k.cast("string"), F.lit("_"), i.cast("string"))
    text = lambda unit: F.array_join(F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat(F.repeat(F.lit("\n"), ((k + i) % 3).cast("int")), F.replace(F.lit(unit), F.lit("@"), number(i)))), "")
    made = [F.struct(F.concat(F.lit("src/"), k.cast("string"), F.lit(f".{end}")).alias("path"), F.concat(F.repeat(F.lit(noise), (k % 4).cast("int")), text(unit)).alias("content")) for end, (noise, unit, _) in UNITS.items()]
    files = dealt_parts(spark, sf_dir).select(F.explode(F.array(*made)).alias("f")).select("f.*")
    return parse_files(files).select("path", "name", "kind", "parent", F.col("start_line").cast("long").alias("start_line"))


_PRISMA = 'datasource db {\n  provider = "mysql"\n}\nmodel A {\n  id Int @id\n}\n'
_PARTS = (
    ("prisma/schema.prisma", _PRISMA, "a", False),
    ("db/p{k}.sql", "CREATE TABLE t{k} (id INTEGER PRIMARY KEY);\n", "ab", True),
    ("node_modules/db/p{k}.sql", "CREATE TABLE no{k} (id INTEGER PRIMARY KEY);\n", "abcde", True),
    ("a/b/c/d/e/f/schema{k}.sql", "CREATE TABLE deep{k} (id INTEGER PRIMARY KEY);\n", "abcde", True),
    ("models/m{k}.model.ts", "export interface IM{k} extends Document {\n  name: string;\n}\nexport default model('M{k}', new Schema({ name: String }));\n", "abc", True),
    (".env", "DATABASE_URL=postgres://host/db\n", "abcd", False),
    ("notes/n{k}.md", "postgres://host/db\n", "abcde", True),
)


@query(
    """WITH n AS (SELECT count(*) AS n FROM part)
SELECT project, provider, CAST(CASE project WHEN 'a' THEN 1 WHEN 'b' THEN n WHEN 'c' THEN n ELSE 0 END AS BIGINT) AS schemas FROM n, (VALUES ('a', 'mysql'), ('b', 'sql'), ('c', 'mongodb'), ('d', 'postgresql'), ('e', NULL)) v(project, provider)"""
)
def detected_schemas(spark, sf_dir):
    """What is found in five projects: each lacks what goes first in the one before it (Prisma, SQL, models, a connection)."""
    keys, found = dealt_parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("k")), []
    for project in "abcde":
        files = None
        for path, content, held, each in _PARTS:
            if project in held:
                put = lambda t: F.replace(F.lit(t), F.lit("{k}"), F.col("k"))
                rows = (keys if each else spark.range(1).select(F.lit("").alias("k"))).select(put(path).alias("path"), put(content).alias("content"))
                files = rows if files is None else files.unionByName(rows)
        provider, schemas_found = schemas.detect_schema(files)
        found.append((project, provider, schemas_found.count() if schemas_found is not None else 0))
    return spark.createDataFrame(found, "project string, provider string, schemas long")
