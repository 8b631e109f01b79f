import pytest

from corpusloom.operators.symbols import ecmascript, parse_files, python_source

SCRIPT = """
// comment with function hidden() {}
import React from 'react';
import { helper, load as fetchAll, type Row } from './helper';
import * as util from "../util";

export interface Account { id: string; tags: string[] }
type AccountId = Account['id'];
export const enum Phase { Idle, Busy }
export default class Store extends Base {
  private cache = new Map();
  get size() { return 1; }
  async find<T>(id: AccountId): Promise<T> { const inner = () => 1; return inner(); }
  static of() { if (true) { return 1; } }
}
export function save(row: Account) { return row; }
const Panel = ({ a }: { a: string }) => { return <main>{a}</main>; };
const format = function (x) { return x; };
export const api = {
  read() { return 1; },
  write: async (x) => x,
  limit: 3,
};
export { save as store, Panel };
export { Button, Card as Tile } from './ui';
export * from './all';
"""


def by_kind(rows, kind):
    return [r[0] for r in rows if r[1] == kind]


def test_script_symbols():
    rows = ecmascript.symbols_of(SCRIPT)
    assert by_kind(rows, "import") == ["react", "./helper", "helper", "fetchAll", "Row", "../util", "util"]
    assert by_kind(rows, "interface") == ["Account"] and by_kind(rows, "type_alias") == ["AccountId"] and by_kind(rows, "enum") == ["Phase"]
    assert by_kind(rows, "class") == ["Store"] and by_kind(rows, "component") == ["Panel"] and by_kind(rows, "object") == ["api"]
    assert by_kind(rows, "method") == ["Store.size", "Store.find", "Store.of", "api.read", "api.write"]
    assert set(by_kind(rows, "function")) == {"save", "format", "inner"}
    assert by_kind(rows, "export") == ["Account", "Phase", "Store", "save", "api", "store", "Panel", "Button", "Tile", "*"]
    sources = {(r[0], r[1]): r[3] for r in rows}
    assert sources["fetchAll", "import"] == "./helper" and sources["Tile", "export"] == "./ui" and sources["*", "export"] == "./all" and sources["save", "export"] is None
    assert all(r[2] == "Store" for r in rows if r[0].startswith("Store."))
    where = {r[0]: r[4:8] for r in rows if r[1] == "function"}
    assert where["save"][:2] == (16, 8) and where["save"][2] == 16


def names(text, kind="function", **how):
    return [r[0] for r in ecmascript.symbols_of(text, **how) if r[1] == kind]


def test_literals_that_look_like_code():
    assert names("const a = `x ${ `}` + `${ {a: '}'}.a } function no() {` } function no() {`;\nfunction yes() {}\n") == ["yes"]
    assert names("const r = /[/'\"`]function no() {/g;\nfunction yes() { return /}/.test('x'); }\nfunction also() {}\n") == ["yes", "also"]
    assert names("const half = total / 2; function one() {} const x = (a) / b / c; function two() {}\n") == ["one", "two"]
    assert names("const s = 'it\\'s'; const t = \"}\"; function yes() {}\n") == ["yes"]
    assert names("const t = `open ${ x\nfunction lost() {}\n") in ([], ["lost"])


def test_elements():
    page = """
export const Page = ({ rows }) => {
  const shown = <ul title='a > b'>{rows.map((r) => <li key={r.id}>don't } function no() {}</li>)}</ul>;
  function inner() { return <>it's {shown} <br/> here</>; }
  return cond ? <Empty /> : inner();
};
function after() { return 1; }
"""
    assert names(page) == ["inner", "after"] and names(page, "component") == ["Page"]
    assert names("const f = <T,>(x: T) => x;\nfunction g<T>(x: T) { return <T>x; }\nfunction h() {}\n", jsx=False) == ["f", "g", "h"]
    assert names("type M = <T>(x: T) => void;\nfunction g() {}\n") == ["g"] and names("if (a < b) { }\nfunction g() {}\n") == ["g"]


def test_declarations_around_a_fault():
    open_body = "function a() {\n  if (x) {\n    call(;\n  }\n\nfunction b() { return 1; }\n\nclass C {\n  run() { return [1; }\n}\nexport const d = () => 2;\n"
    assert names(open_body) == ["a", "b", "d"] and names(open_body, "class") == ["C"] and names(open_body, "method") == ["C.run"]
    where = {r[0]: r[6] for r in ecmascript.symbols_of(open_body) if r[1] == "function"}
    assert where["a"] == 4 and where["b"] == 6  # a ends before the line of b
    assert names("function a() { return (1)); }\nfunction b() {} }\nfunction c() {}\n") == ["a", "b", "c"]
    assert names("import { x from './x';\nfunction a() {}\n") == ["a"]
    assert names("const t = {\n  a: [1, 2,\n\nexport function b() {}\n") == ["b"]


def test_broken_script_does_not_fail():
    for text in ("", "{", "export", "import {", "class A {", "const x = (", "`", "function", "export default", "<a", "<a>{", "`${" * 200, "<a>{" * 200, "/", "/[", "const x = <", "((((" * 500, "}" * 50, "<A/><B", "`${`"):
        ecmascript.symbols_of(text)


PYTHON = "import os, sys as s\nfrom a.b import c, d as e\n\nclass A(B):\n    def run(self):\n        def inner(): pass\n\nasync def go(): pass\n"


def test_python_symbols():
    rows = list(python_source.symbols_of(PYTHON))
    assert by_kind(rows, "function") == ["run", "inner", "go"] and by_kind(rows, "class") == ["A"]
    assert by_kind(rows, "import") == ["os", "sys", "a.b", "c", "d"]
    broken = list(python_source.symbols_of(PYTHON + "def broken(:\n"))
    assert "broken" in by_kind(broken, "function") and by_kind(broken, "class") == ["A"]


def test_files_by_language(spark):
    files = [
        ("a.ts", "export const App = () => 1;"), ("b.py", "def f(): pass"), ("c.rs", "// fn no()\npub fn yes() {}\n  struct S;"), ("d.json", "{\n  \"name\": 1\n}"), ("e.unknown", "fn x()"), ("f.go", "package x"),
        ("g.java", "import a.b;\nclass T {\n  void run(int x) {\n"), ("h.yaml", "# c\nkey: v\n- item: x"), ("empty.toml", ""),
    ]
    rows = {(r["path"], r["name"], r["kind"], r["start_line"], r["start_column"]) for r in parse_files(spark.createDataFrame(files, "path string, content string")).collect()}
    assert {("a.ts", "App", "component", 1, 14), ("a.ts", "App", "export", 1, 1), ("b.py", "f", "function", 1, 1)} <= rows
    assert {r for r in rows if r[0] == "c.rs"} == {("c.rs", "yes", "function", 2, 8), ("c.rs", "S", "class", 3, 10)}
    assert {r[1] for r in rows if r[0] == "d.json"} == {"name"} and not any(r[0] == "e.unknown" for r in rows)
    assert ("f.go", "f", "object", 1, 1) in rows and ("empty.toml", "empty", "object", 1, 1) in rows
    assert {(r[1], r[2]) for r in rows if r[0] == "g.java"} == {("a.b", "import"), ("T", "class"), ("run", "function")}
    assert {r[1] for r in rows if r[0] == "h.yaml"} == {"key"}


def test_a_table_of_documents_is_parsed(spark, tmp_path):
    from corpusloom.plans.queries import QUERIES

    given = [
        ("import { a as b } from './x';\nexport class Store {\n  load() { return 1; }\n}\n", [("./x", "import", 1), ("b", "import", 1), ("Store", "export", 2), ("Store", "class", 2), ("Store.load", "method", 3)]),
        ("import os\n\ndef main():\n    pass\n", [("os", "import", 1), ("main", "function", 3)]),
        ("pub struct Row;\nfn go() {}\n", [("Row", "class", 1), ("go", "function", 2)]),
        ("package main\n\nfunc Run() {\n}\n", [("Run", "function", 3)]),
        ("public class A {\n", [("A", "class", 1)]),
        ("select 1;\ncreate view v as\n", [("v", "object", 2)]),
        ("- a: b\nname: x\n", [("name", "object", 2)]),
        ("# def no():\n", []),
    ]
    rows = [(i, given[i % 8][0]) for i in range(400)] + [(401, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ends = ("ts", "py", "rs", "go", "java", "sql", "yaml", "md")
    want = sorted((f"docs/{i}.{ends[i % 8]}", *s) for i in range(400) for s in given[i % 8][1])
    assert sorted(tuple(r) for r in QUERIES["parsed_documents"](spark, str(tmp_path)).collect()) == want


def test_a_source_that_overflows_the_parser_goes_by_lines():
    source = "def go():\n    return " + "-" * 200_000 + "1\n"
    with pytest.raises(MemoryError):
        python_source.ast.parse(source)
    assert [s[0] for s in python_source.symbols_of(source)] == ["go"]


def test_line_symbols_reads_each_file_once_and_takes_long_lines(spark):
    long = "x" * 200_000
    files = [("a.rs", f"{long} fn go() {{}}\n"), ("b.sql", f"-- no\n{long} create table t (\n"), ("b.sql", "select 1\n"), ("c.php", "function class function ok()\n")]
    found = parse_files(spark.createDataFrame(files, "path string, content string")).where("path not like '%.ts'")
    assert sorted((r["path"], r["name"], r["kind"], r["start_line"]) for r in found.collect()) == [("a.rs", "go", "function", 1), ("b.sql", "b", "object", 1), ("b.sql", "t", "object", 2), ("c.php", "class", "function", 1)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
