"""Sources, sinks, registries, summaries and stages that no query with SQL reaches."""

import json
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import records as J
from graphloom.functions import registry
from graphloom.functions import text as X
from graphloom.operators import agents, chunk, components, indexing, retrieve, summaries
from graphloom.plans import vectors
from graphloom.sources import files, star
from graphloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_logs_are_written_once_and_read_by_time(spark, tmp_path):
    logs = spark.createDataFrame([("a", 1), ("b", 2)], "file string, v long")
    files.write_logs(logs, f"{tmp_path}/out")
    files.write_logs(logs.union(spark.createDataFrame([("c", 3)], "file string, v long")).withColumn("v", F.col("v") * 10), f"{tmp_path}/out")
    assert sorted((r.file, r.v) for r in spark.read.json(f"{tmp_path}/out").collect()) == [("a", 1), ("b", 2), ("c", 30)]
    for name in ("late", "early"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"answer_ids": []}))
    import os

    os.utime(tmp_path / "early.json", (time.time() - 1000,) * 2)
    assert [r.file for r in files.read_logs(spark, f"file://{tmp_path}/*.json").collect()] == ["early", "late"]


def test_csv_to_parquet_and_compaction(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n1,a\n2,b\n2,b\n")
    files.csv_to_parquet(spark, f"{tmp_path}/x.csv", f"{tmp_path}/x", "k long, v string")
    files.compacted(spark, f"{tmp_path}/x", f"{tmp_path}/y", 2, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/y").collect()) == [(1, "a"), (2, "b")]


def test_files_that_cannot_be_read_are_moved_away(spark, tmp_path):
    for k in range(4):
        spark.range(k * 1000, k * 1000 + 1000).select(F.col("id").alias("index"), F.md5(F.col("id").cast("string")).alias("v")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/x")
    whole = sorted((tmp_path / "x").glob("*.parquet"))
    cut, torn = whole[0], whole[1]
    gone = {r["index"] for p in (cut, torn) for r in spark.read.parquet(str(p)).select("index").collect()}
    cut.write_bytes(cut.read_bytes()[:500])  # no footer
    data = bytearray(torn.read_bytes())
    data[4:900] = b"\xff" * 896  # a footer, but damaged pages
    torn.write_bytes(bytes(data))
    for p in (tmp_path / "x").glob(".*.crc"):
        p.unlink()
    moved = files.compacted(spark, f"file://{tmp_path}/x", f"{tmp_path}/y", 2)
    assert len(moved) == 2 and all(error for _, error in moved) and not cut.exists() and not torn.exists()
    assert len(list((tmp_path / "x").glob("_*.bad.*.parquet"))) == 2
    left = {r["index"] for r in spark.read.parquet(f"{tmp_path}/y").collect()}
    assert len(left) == 2000 and left == set(range(4000)) - gone
    assert files.quarantine(spark, f"file://{tmp_path}/x") == []


def test_text_providers(spark):
    assert one(spark, files.first_text(F.lit(" "), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, files.needs_ocr(F.lit(None).cast("string"))) and not one(spark, files.needs_ocr(F.lit("w" * 60)))


def test_collections_keep_a_version_until_the_next_is_whole(spark, tmp_path):
    store = files.Collections(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, f"t{i}", [float(i == 0), float(i), 1.0]) for i in range(6)], "id long, page_content string, embedding array<double>")
    store.add("c", rows)
    assert store.delete("c", F.col("id") >= 4) == 2 and store.versions("c") == [0, 1]
    (tmp_path / "c" / "v2").mkdir()  # a deletion that broke off
    assert sorted(r.id for r in store.read("c").collect()) == [0, 1, 2, 3]
    store.add("c", rows.where("id = 5"))
    found = store.search("c", rows.where("id = 3"), 2, F.col("id") != 3, id_col="id")
    assert [r.item for r in found.orderBy("rank").collect()] == [5, 2]
    assert store.vacuum("c") == 1 and store.read("c").count() == 5


def test_agents_that_may_not_filter_or_ask(spark):
    rows = spark.createDataFrame([(1, "n", "t", "e", 2.0)], "index long, name string, type string, edge string, score double")
    got = agents.without(rows, node_types=True, edge_types=True, query=True).first()
    assert (got.type, got.edge, got.score) == (None, None, 0.0) and agents.without(rows).first() == rows.first()


def test_streams_embed_and_drop_repeats(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (2, 3.0), (1, 2.0)], "index long, v double").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.embed(spark, f"{tmp_path}/in", "index long, v double", f"{tmp_path}/index", F.array("v"), f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["index"], r.embedding) for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [(1, [2.0]), (2, [3.0])]
    events = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert ingest.once_each(events, ["k"], "v").count() == 2


def test_resolution_halves_with_each_level():
    assert components.resolutions(2.0, 3) == [2.0, 1.0, 0.5]


def test_registries_and_tasks(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fish")], "d long, t string")
    asked = spark.createDataFrame([(7, "fish")], "q long, w string")
    found = registry.retrievers().get("bm25")(docs, asked, doc_id="d", doc_text="t", query_id="q", query_text="w")
    assert [(r.query, r.doc) for r in found.collect()] == [(7, 2)]
    hits = docs.withColumns({"g": F.lit(1), "query": F.lit("fish")})
    best = registry.rerankers().get("overlap")(hits, query="query", text="t", group="g", order="d", k=1)
    assert [r.d for r in best.collect()] == [2]
    tasks = [registry.Task("double", lambda c: {"b": 2 * c["a"]}, ("a",)), registry.Task("add", lambda c: {"c": c["a"] + c["b"]}, ("a", "b"))]
    assert registry.run_tasks(tasks, {"a": 1})["c"] == 3
    with pytest.raises(registry.BadArgument):
        registry.run_tasks(tasks[1:], {"a": 1})


def test_code_of_all_languages(spark):
    source = "import x\n" + "\n".join(f"def f{i}(a):\n    return a + {i}\n" for i in range(60))
    docs = spark.createDataFrame([(1, source)], "id int, t string")
    parts = [r.chunk for r in chunk.code(docs, "id", "t", "python", 300, 0).orderBy("chunk_id").collect()]
    assert all(len(p) <= 300 for p in parts) and sum(p.lstrip().startswith("def ") for p in parts) >= len(parts) - 1
    assert len(chunk.LANGUAGES) == 28 and set(chunk.EXTENSIONS.values()) <= set(chunk.LANGUAGES) and chunk.code_separators("none") == chunk.SEPARATORS
    plain = [r.chunk for r in chunk.recursive(docs, "id", "t", 1000, 200).orderBy("chunk_id").collect()]
    assert [r.chunk for r in chunk.contextual(docs, "id", "t").orderBy("chunk_id").collect()] == [one(spark, X.with_context(F.lit(p))) for p in plain]


def brute_pieces(text, separators, size, overlap):
    """As the splitter, with windows over the list of parts whose lengths are those of real joins."""
    at = next(k for k, s in enumerate(separators) if s == "" or s in text)
    mark, rest = separators[at], separators[at + 1 :]
    parts = text.split(mark) if mark else list(text)
    if mark.strip():
        parts = parts[:1] + [mark + p for p in parts[1:]]
    parts, glue, out, start = [p for p in parts if p], "" if mark.strip() else mark, [], 0
    joined = lambda a, b: glue.join(parts[a:b])
    for i, part in enumerate(parts):
        if len(part) > size:
            out, start = [*out, joined(start, i), *brute_pieces(part, rest, size, overlap)], i + 1
        elif len(joined(start, i + 1)) > size:
            out.append(joined(start, i))
            start = next(k for k in range(start, i + 1) if k == i or len(joined(k, i)) <= overlap and len(joined(k, i + 1)) <= size)
    return [p.strip() for p in [*out, joined(start, len(parts))] if p.strip()]


def test_recursive_pieces_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").union(spark.createDataFrame([(-1, "", "", "", 0), (-2, None, "", "", 0), (-3, "x" * 2500 + "\n\n" + "y z " * 700, "", "", 0)], "a long, b string, c string, d string, e long"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) > 100
    for size, overlap in ((1000, 200), (300, 0), (80, 79)):
        got = {}
        for r in chunk.recursive(docs, "doc_id", "text", size, overlap).orderBy("doc_id", "chunk_id").collect():
            got.setdefault(r.doc_id, []).append(r.chunk)
        assert got == {i: p for i, t in texts.items() if (p := brute_pieces(t or "", chunk.SEPARATORS, size, overlap))}
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("name", F.concat(F.lit("a"), F.array(*map(F.lit, (".htm", ".rst", ".JS", ".cob")))[(F.col("page_id") % 4).cast("int")]))
    want = {r.page_id: brute_pieces(r.html, chunk.code_separators(("html", "rst", "javascript", "cobol")[r.page_id % 4]), 400, 50) for r in pages.collect()}
    got = {}
    for r in chunk.code_files(pages, "page_id", "html", "name", 400, 50).orderBy("page_id", "chunk_id").collect():
        got.setdefault(r.page_id, []).append(r.chunk)
    assert got == want and any(p.startswith("<") for p in want[0][1:])


def test_marks_of_markup_need_no_blank(spark):
    tex = "\\chapter{A}\n" + "a " * 60 + "\n\\section{B}\n" + "b " * 60
    docs = spark.createDataFrame([(1, tex, "x.tex"), (2, "T\n===\n" + "c " * 60 + "\n.. note::\n" + "d " * 60, "x.rst"), (3, "# A\n" + "e " * 67 + "\n## B\nf", "x.md")], "id int, t string, name string")
    got = {}
    for r in chunk.code_files(docs, "id", "t", "name", 140, 0, default="markdown").orderBy("id", "chunk_id").collect():
        got.setdefault(r.id, []).append((r.language, r.chunk.split()[0]))
    assert got[1] == [("latex", "\\chapter{A}"), ("latex", "\\section{B}")] and got[2][-1] == ("rst", "..")
    assert got[3] == [("markdown", "#"), ("markdown", "##")]


def test_headings_like_a_scan_of_lines(spark):
    import random
    import re

    random.seed(4)
    choices = ["# a", "## b", "### c", "#### d", "##### no", "#no", "text", "", "  # no", "#  two words ", "x\r"]
    texts = {k: "\n".join(random.choices(choices, k=k % 40)) for k in range(120)}

    def scan(text):
        path, parts = [""] * 4, []
        for line in text.split("\n"):
            m = re.match(r"(#{1,4}) +\S", line)
            if m:
                d = len(m[1])
                path = [*path[: d - 1], re.sub("^#+ +", "", line).strip(" "), *[""] * (4 - d)]
            if m or not parts:
                parts.append((path, []))
            if not m:
                parts[-1][1].append(line)
        return [(n, " > ".join(p for p in path if p), body) for n, (path, ls) in enumerate(parts) if (body := "\n".join(ls).strip(" \n"))]

    got = {k: [] for k in texts}
    for r in chunk.markdown(spark.createDataFrame(list(texts.items()), "id int, t string"), "id", "t").orderBy("id", "section").collect():
        got[r.id].append((r.section, r.breadcrumb, r.body))
    assert got == {k: scan(t) for k, t in texts.items()}


def test_products_with_missing_parts(spark):
    rows = spark.createDataFrame(
        [(1, "T", None, None, None, None, None, None), (2, "U", "", "a ; b ; c", [" ", ""], [], [], []), (3, "V", "B", "1 x 2 ; 3 g", [" d", None, "e "], ["f", "", "my ASIN"], [("s1", "r1", None), ("s2", "r2", "1,200"), (None, "r3", "1,200"), ("s4", None, "7")], [("q", None)])],
        "id int, title string, brand string, size string, description array<string>, features array<string>, reviews array<struct<summary: string, reviewText: string, vote: string>>, qa array<struct<question: string, answer: string>>",
    )
    got = {r.id: r.s for r in rows.select("id", summaries.described_product(*map(F.col, rows.columns[1:])).alias("s")).collect()}
    assert got[1] == "- product: T" and got[2] == "- product: U"
    reviews = '#2:\nsummary: s2\ntext: "r2"\n#3:\nsummary: \ntext: "r3"\n#4:\nsummary: s4\ntext: ""\n#1:\nsummary: s1\ntext: "r1"'
    assert got[3] == f'- product: V\n- brand: B\n- dimensions: 1 x 2\n- weight: 3 g\n- description: d e\n- features: \n#1: f\n- reviews: \n{reviews}\n- Q&A: \n#1:\nquestion: "q"\nanswer: ""'
    assert one(spark, summaries.counted(F.lit("paper"), F.lit("x"), F.lit(1), F.lit(1))) is None


def test_details_and_papers(spark):
    details = F.lit(json.dumps({"_x": 1, "a_id": 2, "n": "nan", "alias": "b", "genomic_pos": [{"chr": 1}, {"chr": 2}], "interpro": [{"desc": "p"}, {"desc": "q"}], "z": [1, 2]}))
    got = one(spark, summaries.described_node(F.lit("N"), F.lit("gene/protein"), F.lit("S"), details))
    assert got.split("\n") == ["- name: N", "- type: gene/protein", "- source: S", "- details:", "  - alias (other gene names): b", '  - genomic_pos (genomic position): {"chr":1}', '  - interpro (protein family and classification information): ["p","q"]', "  - z: [1,2]"]
    assert one(spark, summaries.described_node(F.lit("N"), F.lit("drug"), F.lit("S"), F.lit(None).cast("string"))) == "- name: N\n- type: drug\n- source: S"
    paper = summaries.described_paper(F.lit("T"), F.lit("a\r\nb\n"), F.lit("-1"), ("venue", F.lit("-1")), ("journal", F.lit("J")))
    assert one(spark, paper) == " - paper title: T\n - abstract: a\nb\n - journal: J"


def test_nan_becomes_null_at_any_depth(spark):
    rows = spark.sql("select array(struct(double('nan') as a, array(1.5d, double('nan')) as b), null) as r, 1 as k")
    got = summaries.cleaned(rows, "r").first().r
    assert got[0].a is None and got[0].b == [1.5, None] and got[1] is None


def test_index_pipeline_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, b"x" * 1500), (2, b" "), (3, None)], "doc_id long, text binary")
    held = []
    chunks, metrics = indexing.index_documents(docs, lambda df: held.append(df.count()), extract=lambda c: c.cast("string"))
    assert [(m["stage"], m["rows"]) for m in metrics] == [("extract", 3), ("clean", 1), ("chunk", 2), ("insert", 2)] and held == [2]
    assert chunks.count() == 2 and all(m["seconds"] >= 0 for m in metrics)


def test_a_broken_run_begins_after_its_last_whole_stage(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    ran, broken = [], [True]

    def stages(step):
        def add(df):
            ran.append("add")
            return df.withColumn("x", F.col("id") + step)

        def half(df):
            ran.append("half")
            fails = F.raise_error(F.lit("lost")) if broken[0] else F.lit(None).cast("string")
            return df.where("x % 2 = 0").withColumn("y", fails)

        return [("add", add, step), ("half", half)]

    source, folder = spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/run"
    with pytest.raises(Exception, match="lost"):
        indexing.staged(source, stages(1), folder)
    broken[0] = False
    rows, metrics = indexing.staged(source, stages(1), folder)
    assert ran == ["add", "half", "half"] and [(m["rows"], m["reused"]) for m in metrics] == [(10, True), (5, False)]
    assert sorted(r.id for r in rows.collect()) == [1, 3, 5, 7, 9]
    assert [m["reused"] for m in indexing.staged(source, stages(1), folder)[1]] == [True, True]
    assert [m["reused"] for m in indexing.staged(source, stages(2), folder)[1]] == [False, False]
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
    again, metrics = indexing.staged(spark.read.parquet(f"{tmp_path}/in"), stages(1), folder)
    assert [m["rows"] for m in metrics] == [12, 6] and again.count() == 6


def test_local_search_by_permission(spark):
    nodes, links = star.stored_nodes(spark, SF), star.links(spark, SF)
    asked = spark.createDataFrame([(1, "Supplier")], "query int, text string")
    members = nodes.select("index", (F.col("index") % 3).alias("community"))
    sizes = members.groupBy("community").agg(F.count("*").cast("double").alias("importance"))
    every = retrieve.search_locally(asked, nodes, links, members, sizes).first()
    some = retrieve.search_locally(asked, nodes, links, members, sizes, allowed=F.col("index") % 2 == 0).first()
    assert every.entities == 5 and 0 < some.entities < 5 and "Communities:\n[C1]" in every.context


def test_both_lists_of_the_hybrid_search_differ(spark):
    sparse, dense = vectors._lists(spark, SF)
    assert sparse.count() and dense.count() and sparse.select("query", "item").intersect(dense.select("query", "item")).count() < sparse.count()


def test_flags(spark):
    assert one(spark, J.is_true(F.lit(" Yes "))) and not one(spark, J.is_true(F.lit("no")))


def test_broadcasts_are_checked_by_bytes(spark):
    from graphloom.operators.sizes import fits

    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits(rows) and not fits(rows, 99) and not fits(rows, most_bytes=50_000) and fits(rows.where("false"))


def test_batches_merge_into_the_state(spark, tmp_path):
    from graphloom.operators import merge

    schema = "id long, type string, description string, source_document string, seq long, embedding array<double>"
    parts = (["id"], ["type", "description"], ["embedding"])
    merged = ingest.MergedStream(spark, f"{tmp_path}/m", schema, lambda x: merge.partial_state(x, *parts), lambda x: merge.combined(x, *parts))
    batches = [
        [(i, None if i == 4 else "T", f"d{i}", "a", i, [float(i)]) for i in range(20)],
        [(3, "U", "late", "b", 99, [7.0]), (3, "U", "x", None, 98, [8.0]), (50, "T", "new", "b", 100, None)],
        [(3, "V", "early", "c", -1, [9.0]), (4, "W", None, "a", 101, None)],
    ]
    rows = [spark.createDataFrame(b, schema) for b in batches]
    for number, batch in enumerate(rows):
        merged.put(batch, number)
        merged.put(batch, number)  # a batch that is run again counts once
    assert not merged._buckets_of(f"{tmp_path}/m/arrived/batch=2")
    got = merge.from_state(merged.read(), *parts)
    want = merge.merge_entities(rows[0].union(rows[1]).union(rows[2]))
    found = {r.id: (r.type, r.description, list(r.source_documents), r.n, r.embedding) for r in got.collect()}
    assert found == {r.id: (r.type, r.description, list(r.source_documents), r.n, r.embedding) for r in want.collect()} and len(found) == 21
    assert found[3] == ("V", "early", ["c", "a", "b"], 4, [7.0]) and found[4] == ("W", "d4", ["a"], 2, [4.0]) and found[50][4] is None
    versions = merged._versions()
    assert all(len(v) <= 2 for v in versions.values())
    # a batch opens the last states of its own buckets and no others
    touched = {b for b, v in versions.items() if v[-1][0] == 2}
    assert len(touched) == 2 and all(b in touched or n < 2 for b, v in versions.items() for n, _ in v)


def test_a_batch_reads_states_and_no_earlier_arrivals(spark, tmp_path):
    from graphloom.operators import merge

    schema, parts = "id long, type string, source_document string, seq long", (["id"], ["type"])
    merged = ingest.MergedStream(spark, f"{tmp_path}/m", schema, lambda x: merge.partial_state(x, *parts), lambda x: merge.combined(x, *parts), buckets=4)
    sizes = []
    for number in range(5):
        merged.put(spark.range(2000).selectExpr("id % 50 as id", "'T' as type", "'a' as source_document", f"id + {number} * 2000 as seq"), number)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / "m").rglob("*.parquet")))
    assert merge.from_state(merged.read(), *parts).agg(F.sum("n"), F.count("*")).first()[:] == (10_000, 50)
    assert max(sizes[2:]) < 1.3 * sizes[1]  # what is kept does not grow with the arrivals


def test_recursive_chunks_of_a_batch_are_cut_few_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from graphloom.operators import chunk

    texts = pa.array([None, "", *(f"{k} " + "words of a text " * 600 for k in range(1000))])
    tracemalloc.start()
    got = chunk._cut(texts, chunk.SEPARATORS, 1000, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    assert got.to_pylist() == [list(chunk._split(x or "", chunk.SEPARATORS, 1000, 200)) for x in texts.to_pylist()]
