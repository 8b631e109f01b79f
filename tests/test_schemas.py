from pyspark.sql import functions as F

from corpusloom.operators import schemas as S

SQL = """-- shop
CREATE TABLE IF NOT EXISTS "buyers" (
  id INTEGER PRIMARY KEY,
  mail TEXT NOT NULL UNIQUE,
  price DECIMAL(10, 2) DEFAULT 0
);

create table orders (
  id INTEGER,
  buyer_id INTEGER NOT NULL,
  unique_code TEXT,
  PRIMARY KEY (id),
  CONSTRAINT fk FOREIGN KEY (buyer_id) REFERENCES buyers (id)
);
"""
PRISMA = """
datasource db {
  provider = "mysql"
}
model Author {
  id    Int     @id @default(autoincrement())
  mail  String? @unique
  books Book[]
  @@index([mail])
}
model Book {
  id       Int @id
  // comment
  authorId Int
  author   Author @relation(fields: [authorId], references: [id])
}
"""
MODEL = """
import { Schema, model } from 'mongoose';
export interface INote extends Document {
  owner: Schema.Types.ObjectId;
  title?: string; // } not a brace
  _id: string;
}
const NoteSchema = new Schema({
  owner: { type: Schema.Types.ObjectId, ref: 'Person', required: true },
  title: { type: String, default: "}" },
});
export default models.Note || model('Note', NoteSchema);
"""


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_ddl():
    found = S.parse_sql(SQL)
    buyers, orders = found["tables"]
    assert [c["name"] for c in buyers["columns"]] == ["id", "mail", "price"] and buyers["primary_keys"] == ["id"]
    assert buyers["columns"][1]["is_unique"] and not buyers["columns"][1]["is_nullable"]
    assert buyers["columns"][2]["data_type"] == "DECIMAL(10," and buyers["columns"][2]["default_value"] == "0"
    assert [c["name"] for c in orders["columns"]] == ["id", "buyer_id"] and orders["primary_keys"] == ["id"]
    assert found["relationships"] == [{"from_table": "orders", "from_column": "buyer_id", "to_table": "buyers", "to_column": "id", "kind": "many-to-one"}]


def test_prisma_goes_first(spark):
    provider, found = S.detect_schema(frame(spark, {"prisma/schema.prisma": PRISMA, "db/a.sql": SQL}))
    assert provider == "mysql"
    columns = {(r["table_name"], r["name"]): r for r in S.columns_of(found).collect()}
    assert columns["Author", "mail"]["is_nullable"] and columns["Author", "id"]["default_value"] == "autoincrement("
    assert columns["Book", "author"]["references_table"] == "Author"
    kept = S.existing_relationships(S.relationships_of(found), S.columns_of(found)).collect()
    assert [(r["from_table"], r["from_column"], r["to_column"]) for r in kept] == [("Book", "authorId", "id")]


def test_sql_files_merge(spark):
    second = "CREATE TABLE buyers (\n  id BIGINT,\n  phone TEXT\n);\n-- mysql://host\n"
    provider, found = S.detect_schema(frame(spark, {"db/1.sql": SQL, "db/2.sql": second, "notes/x.sql": SQL, "node_modules/db/3.sql": SQL}))
    merged = S.merge_schemas(found)
    assert provider == "mysql" and merged["summary"].first()["sources"] == ["db/1.sql", "db/2.sql"]
    assert {r["name"]: r["data_type"] for r in merged["columns"].where("table_name = 'buyers'").collect()} == {"id": "INTEGER", "mail": "TEXT", "price": "DECIMAL(10,", "phone": "TEXT"}
    assert merged["relationships"].count() == 1


def test_models(spark):
    provider, found = S.detect_schema(frame(spark, {"database/note.model.ts": MODEL, "database/plain.ts": "const x = 1;"}))
    columns = {r["name"]: r for r in S.columns_of(found).collect()}
    assert provider == "mongodb" and list(columns) == ["owner", "title", "_id"] and columns["_id"]["is_primary_key"] and columns["title"]["is_nullable"]
    assert columns["owner"]["references_table"] == "Person" and columns["owner"]["references_column"] == "_id"
    assert S.relationships_of(found).first()["to_table"] == "Person"


def test_provider_only_and_nothing(spark):
    assert S.detect_schema(frame(spark, {".env": "URL=postgresql://u@h/app\n"})) == ("postgresql", None)
    assert S.detect_schema(frame(spark, {"a/b.txt": "postgres://"})) == (None, None)


def test_equal_paths_are_not_paired_and_nothing_is_broadcast(spark):
    files = spark.createDataFrame([("db/a.sql", SQL)] * 3, "path string, content string")
    found = S.parse_schema_files(files, "sql")
    assert [r["provider"] for r in found.select("provider").collect()] == ["sql"] * 3
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_merge_by_project_and_first_mention_in_one_file(spark):
    twice = "CREATE TABLE t (\n  a INTEGER,\n  b INTEGER PRIMARY KEY\n);\nCREATE TABLE t (\n  b TEXT\n);\n"
    found = S.parse_schema_files(frame(spark, {"p/1.sql": twice, "q/1.sql": twice}), "sql")
    assert {r["name"]: r["data_type"] for r in S.merge_schemas(found)["columns"].collect()} == {"a": "INTEGER", "b": "INTEGER"}
    merged = S.merge_schemas(found, F.split("path", "/")[0])
    assert sorted((r["project"], r["table_name"], r["value"]) for r in merged["primary_keys"].collect()) == [("p", "t", "b"), ("q", "t", "b")]
    assert sorted(r["project"] for r in merged["summary"].collect()) == ["p", "q"]


def test_detected_schemas_are_parsed_once(spark):
    for files in ({"db/1.sql": SQL}, {"database/note.model.ts": MODEL}):
        _, found = S.detect_schema(frame(spark, files))
        assert found.count() == 1 and "InArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
