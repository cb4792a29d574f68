"""Sections of code against Python's own parser, the chunk table function, and collections as a data source."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.functions import registry
from graphloom.operators import chunk
from graphloom.sources import code, collection_source, files

ROOT = Path(__file__).resolve().parent.parent


def by_parser(text):
    """(definitions, rest) of a Python file, cut at the lines that its syntax tree names."""
    lines, found, rest, at = text.split("\n"), [], [], 0
    for node in ast.parse(text).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append("\n".join(lines[node.lineno - 1 : node.end_lineno]))
            rest += [*lines[at : node.lineno - 1], "# Code for: " + lines[node.lineno - 1]]
            at = node.end_lineno
    return found, "\n".join(rest + lines[at:]).removesuffix("\n")


def test_sections_of_all_files_here_like_the_parser(spark):
    paths = sorted(p for p in (ROOT / "graphloom").rglob("*.py") if not p.name.startswith("_"))
    assert len(paths) > 40
    got = {r.path.split("/graphloom/", 1)[1]: r for r in code.read_code(spark, [f"file://{p}" for p in paths]).collect()}
    for path in paths:
        row, (found, rest) = got[str(path.relative_to(ROOT / "graphloom"))], by_parser(path.read_text())
        assert row.language == "python"
        assert [s.content for s in row.sections if s.kind == "functions_classes"] == found, path
        assert [s.content for s in row.sections if s.kind == "simplified_code"] == [rest], path


CASES = [
    ("go", "package a\n\n// adds\nfunc add(x int) int {\n\treturn x + 1\n}\n\nvar n = 1\n", ["func add(x int) int {\n\treturn x + 1\n}"], "package a\n\n// adds\n// Code for: func add(x int) int {\n\nvar n = 1"),
    ("rust", "use a;\npub(crate) fn f(\n    x: u8,\n) -> u8 {\n    x\n}\n", ["pub(crate) fn f(\n    x: u8,\n) -> u8 {\n    x\n}"], "use a;\n// Code for: pub(crate) fn f("),
    ("c", "#include <a.h>\nint g(void);\nint f(int x)\n{\n    return x;\n}\nstruct s {\n    int a;\n};\n", ["int f(int x)\n{\n    return x;\n}", "struct s {\n    int a;\n};"], "#include <a.h>\nint g(void);\n// Code for: int f(int x)\n// Code for: struct s {"),
    ("ruby", "require 'a'\ndef f(x)\n  x\nend\nf(1)\n", ["def f(x)\n  x\nend"], "require 'a'\n# Code for: def f(x)\nf(1)"),
    ("lua", "local function f(x)\n  return x\nend\nprint(f(1))", ["local function f(x)\n  return x\nend"], "-- Code for: local function f(x)\nprint(f(1))"),
    ("java", "import a.B;\r\n\r\npublic final class C {\r\n  int x;\r\n}\r\n", ["public final class C {\n  int x;\n}"], "import a.B;\n\n// Code for: public final class C {"),
    ("typescript", "export interface A {\n  x: number;\n}\nconst a = 1;", ["export interface A {\n  x: number;\n}"], "// Code for: export interface A {\nconst a = 1;"),
    ("python", "", [], ""),
    ("python", 'X = """\ndef no(x):\n"""\ndef f():\n    return """a\nb\n"""\ny = 1', ['def f():\n    return """a\nb\n"""'], 'X = """\ndef no(x):\n"""\n# Code for: def f():\ny = 1'),
    ("python", 'def f():\n    return 1  # """\ny = 1', ['def f():\n    return 1  # """'], "# Code for: def f():\ny = 1"),
    ("python", "@wrap\nasync def f(\n    a,\n):\n    return a\nclassic = 1\n", ["async def f(\n    a,\n):\n    return a"], "@wrap\n# Code for: async def f(\nclassic = 1"),
]


def test_sections_of_other_languages(spark):
    rows = spark.createDataFrame([(k, x[0], x[1]) for k, x in enumerate(CASES)] + [(100, None, "def f(x):\r\n 1"), (101, "latex", None), (102, "python", None)], "k int, language string, text string")
    found = {r.k: r for r in rows.withColumn("s", code.code_sections(F.col("text"), F.col("language"))).withColumn("all", code.headed(F.col("s"))).collect()}
    for k, (_, _, definitions, rest) in enumerate(CASES):
        assert [s.content for s in found[k].s] == [*definitions, rest], k
        assert [s.kind for s in found[k].s] == ["functions_classes"] * len(definitions) + ["simplified_code"]
        assert found[k]["all"] == "\n\n".join([f"=== FUNCTIONS_CLASSES ===\n{x}" for x in definitions] + [f"=== SIMPLIFIED_CODE ===\n{rest}"])
    assert found[100]["all"] == "def f(x):\r\n 1" and found[101]["all"] == "" and found[102]["all"] == "=== SIMPLIFIED_CODE ===\n"


def test_sections_of_a_very_long_file(spark):
    n = 30_000
    text = F.concat(F.lit("def f():\n"), F.repeat(F.lit("    x = 1\n"), n), F.repeat(F.lit("\n"), n), F.repeat(F.lit("y = 2\n"), n))
    row = spark.range(1).select(code.code_sections(text, F.lit("python")).alias("s")).first()
    assert [len(s.content) for s in row.s] == [8 + 10 * n, 21 + n + 6 * n - 1]


def test_table_function_gives_the_recursive_chunks(spark):
    registry.register_functions(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-1, "word " * 5000), (-1, "word " * 5000)], docs.schema))
    want = chunk.recursive(docs, "doc_id", "text").collect()
    got = spark.sql("select cast(id as bigint), chunk_id, chunk from chunk_table(table(select cast(doc_id as string), text from {d}), 1000, 200)", d=docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > docs.count() - 2
    beside = spark.sql("select d.doc_id, c.chunk_id, c.chunk from {d} d, lateral recursive_chunks(d.text, 1000, 200) c", d=docs).collect()
    assert sorted(map(tuple, beside)) == sorted(map(tuple, want))
    assert spark.sql("select * from chunk_table(table(select cast(doc_id as string), text from {d}), 9, 0)", d=docs.limit(0)).count() == 0


def test_collections_are_a_source_with_versions_and_filters(spark, tmp_path):
    collection_source.register_source(spark)
    store = files.Collections(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}", [float(i), 1.0], {"n": str(i)}) for i in range(8)], "id long, page_content string, embedding array<double>, meta map<string,string>")
    store.add("c", rows.repartition(3))
    path = f"file://{tmp_path}/c"

    def read(**options):
        return spark.read.format("collection").options(**options).load(path)

    assert read().schema.names == store.read("c").schema.names
    key = lambda df: sorted((r.id, r.page_content, tuple(r.embedding), r.meta["n"]) for r in df.collect())
    assert key(read()) == key(store.read("c")) and len(key(read())) == 8
    for condition in ("id = 5", "id in (1, 2, 99)", "id > 3 and page_content <> 't5'", "page_content is null", "not (id <= 6)", "page_content like 't%' and id < 2", "embedding[0] = 4.0", "id = 1 or page_content = 't7'"):
        assert key(read().where(condition)) == key(rows.where(condition)), condition
    kept, begun = collection_source.snapshot(spark, path), read().toLocalIterator()
    first = next(begun)
    assert store.delete("c", F.col("id") >= 4) == 4
    assert sorted(r.id for r in (first, *begun)) == list(range(8))  # it began before the deletion
    assert [r.id for r in kept.orderBy("id").collect()] == list(range(8))
    (tmp_path / "c" / "v2").mkdir()  # a deletion that broke off
    assert sorted(r.id for r in read().collect()) == [0, 1, 2, 3] and read(version="0").count() == 8
    assert sorted(r.id for r in read().select("id").collect()) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="has no version 7"):
        read(version="7").collect()


def test_filters_of_a_source_pass_over_row_groups(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/c/v0"
    spark.range(0, 20_000, 1, 1).selectExpr("id", "sha2(cast(id as string), 256) as x").write.option("parquet.block.size", 65536).parquet(path)
    assert collection_source.complete_versions(f"file://{tmp_path}/c") == [0]
    monkeypatch.setattr(collection_source, "TASK_BYTES", 1 << 16)
    source = collection_source.CollectionSource({"path": f"file://{tmp_path}/c"})
    every, some = source.reader(source.schema()), source.reader(source.schema())
    asked = [collection_source.D.EqualTo(("id",), 19_999), collection_source.D.StringContains(("x",), "0")]
    assert list(some.pushFilters(asked)) == asked and len(some.wanted) == 1
    groups = sum(len(p.groups) for p in every.partitions())
    assert groups > 1 and sum(len(p.groups) for p in some.partitions()) == 1
    assert sum(b.num_rows for p in every.partitions() for b in every.read(p)) == 20_000
    assert [b.column("id").to_pylist() for p in some.partitions() for b in some.read(p)] == [[19_999]]
