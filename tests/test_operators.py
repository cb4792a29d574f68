"""Properties of operators that SQL does not express, and edge cases."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import records as J
from graphloom.functions import registry
from graphloom.functions import text as X
from graphloom.operators import chunk, components, fusion, merge, nearest, traverse
from graphloom.sources import files
from graphloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clean_pieces(spark):
    assert one(spark, X.clean(F.lit("a\t b  \n\n\n\nc"), unicode=False)) == "a b\n\nc"
    assert one(spark, X.nfkc(F.lit("ﬁ"))) == "fi"
    assert one(spark, X.without_page_marks(F.lit("--- Page 3 ---\n12\nPage 1 of 9"))).strip() == ""
    assert one(spark, X.search_terms(F.lit("what is (BM25)?"))) == "what AND is AND BM25"
    assert one(spark, X.without_invisible(F.lit("a​b\x00c"))) == "abc"


def test_ranking_replies(spark):
    reply = F.lit('{"ranking":[2,2,9,0]}')
    assert one(spark, J.ranking(reply, F.lit(3))) == [2, 0, 1]
    assert one(spark, J.ranking(reply, F.lit(3), complete=False)) == [2, 0]


def test_votes_differ_by_tie(spark):
    lists = spark.createDataFrame([(1, a, p, n) for a, ns in enumerate([[7, 8], [9], [9, 8]]) for p, n in enumerate(ns, 1)], "question int, agent int, pos long, node int")
    order = {tie: [r.node for r in fusion.votes(lists, tie).orderBy("rank").collect()] for tie in ("flat", "first_agent", "min_depth")}
    assert order == {"flat": [8, 9, 7], "first_agent": [8, 9, 7], "min_depth": [9, 8, 7]}


def test_hops_and_boundary(spark):
    edges = spark.createDataFrame([(1, 2, "r"), (2, 3, "r"), (3, 4, "r")], "start_node_index long, end_node_index long, type string")
    seed = spark.createDataFrame([(1,)], "index long")
    near = traverse.within_hops(edges, seed, 1)
    assert sorted(r["index"] for r in near.collect()) == [1, 2]
    assert sorted(r.start_node_index for r in traverse.subgraph_edges(edges, near).collect()) == [1, 2]
    assert [r.start_node_index for r in traverse.subgraph_edges(edges, near, boundary=False).collect()] == [1]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 500]], "index long")
    got = {r["index"]: r.component for r in components.components(nodes, links).collect()}
    assert set(got[i] for i in range(61)) == {0} and got[101] == 100 and got[500] == 500


def test_communities_beat_one_for_all(spark):
    cliques = [(i, j) for base in (0, 10, 20) for i in range(base, base + 5) for j in range(i + 1, base + 5)]
    links = spark.createDataFrame([*cliques, (4, 10), (14, 20)], "a long, b long")
    nodes = links.select(F.explode(F.array("a", "b")).alias("index")).distinct()
    first = components.label_propagation(nodes, links)
    assert components.modularity(first, links).first().modularity > 0.3
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, components.label_propagation(nodes, links).collect()))


def test_recursive_chunks_keep_sizes_and_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = chunk.recursive(docs, "doc_id", "text", 300, 60)
    assert found.where(F.length("chunk") > 300).count() == 0
    words = lambda df, c: {(r[0], r[1]) for r in df.select("doc_id", F.explode(F.split(c, r"\s+"))).distinct().collect() if r[1]}
    assert words(docs, "text") == words(found, "chunk")
    assert list(chunk._split("", chunk.SEPARATORS, 10, 2)) == [] and list(chunk._split("abcdefghijkl", chunk.SEPARATORS, 5, 1)) == ["abcde", "efghi", "ijkl"]


def test_delete_shared_documents(spark):
    rows = spark.createDataFrame([("x", ["d1", "d2"]), ("y", ["d1"]), ("z", None)], "id string, source_documents array<string>")
    once = merge.without_document(rows, "d1")
    assert sorted(r.id for r in once.collect()) == ["x", "z"]
    assert [r.id for r in merge.without_document(once, "d2").collect()] == ["z"]


def test_first_description_may_be_empty(spark):
    rows = spark.createDataFrame([("a", None, "", "d1", 1), ("a", "T", "later", "d2", 2), ("a", "U", "last", "d1", 3)], "id string, type string, description string, source_document string, seq int")
    assert tuple(merge.merge_entities(rows).first()) == ("a", "T", "", ["d1", "d2"], 3)


def test_bucketed_search_is_part_of_the_exact_one(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0")
    exact = {(r.query, r.item): r.score for r in nearest.nearest(vectors, queries, 1).collect()}
    found = {(r.query, r.item): r.score for r in nearest.bucketed(vectors, queries, 1).collect()}
    assert len(set(exact) & set(found)) >= 0.9 * len(exact)
    assert nearest.nearest(vectors, vectors.where("false"), 3).count() == 0


def test_bucketed_search_finds_more_than_the_query_itself(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    near = vectors.where("vec_id < 12").select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.expr("transform(array_repeat(1f, 64), (x, k) -> cast(x + vec_id * (k % 2) / 1e4 as float))").alias("embedding"))
    rows = vectors.select("vec_id", "embedding").union(near)
    queries = rows.where("vec_id % 50 = 0")
    exact = {(r.query, r.item) for r in nearest.nearest(rows, queries, 10).collect() if r.query != r.item}
    found = [(r.query, r.item) for r in nearest.bucketed(rows, queries, 10).collect()]
    assert len(exact & set(found)) >= 0.9 * len(exact) and len(found) == len(set(found)) == 10 * queries.count()


def test_registry_binds_arguments(spark):
    chunkers = registry.chunkers()
    docs = spark.createDataFrame([(1, "a b c")], "id int, text string")
    assert chunkers.get("stride")(docs, id_col="id", text_col="text", size="4", overlap=1).count() == 2
    for bad in ({"id_col": "id"}, {"id_col": "id", "text_col": "text", "size": 0}, {"id_col": "id", "text_col": "text", "more": 1}):
        with pytest.raises(registry.BadArgument):
            chunkers.get("stride")(docs, **bad)
    registry.register_functions(spark)
    assert spark.sql("select count_words(' a b  c ') as n").first().n == 3
    assert [r.chunk for r in spark.sql("select * from recursive_chunks('aa bb cc', 5, 0)").collect()] == ["aa bb", "cc"]


def test_logs_and_questions(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "1.json").write_text('{"question": "q", "answer_indices": [1], "trajectories": [{"agent_answer_indices": [1, 2], "steps": 3}]}')
    (tmp_path / "logs" / "2.json").write_text('{"question": ')
    assert [(r.file, r.answer_indices) for r in files.read_logs(spark, f"file://{tmp_path}/logs").collect()] == [("1", [1])]
    (tmp_path / "q.csv").write_text('id,query,answer_ids\n7,"a, b","[1, 2]"\n8,c,"[3]"\n9,d,"[]"\n')
    (tmp_path / "val.index").write_text("2\n0\n")
    assert [(r.id, r.answer_ids) for r in files.read_questions(spark, f"file://{tmp_path}/q.csv", f"file://{tmp_path}/val.index").collect()] == [(9, []), (7, [1, 2])]


def test_collections(spark, tmp_path):
    held = files.Collections(spark, f"file://{tmp_path}/c")
    held.add("a", spark.createDataFrame([("t1", "f1"), ("t2", "f2")], "page_content string, filename string"))
    held.add("a", spark.createDataFrame([("t3", "f1")], "page_content string, filename string"))
    assert held.read("a").count() == 3
    assert held.delete("a", F.col("filename") == "f1") == 2 and held.read("a").count() == 1


def test_texts_of_any_encoding(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin1"))
    assert {(r.text, r.encoding) for r in files.read_texts(spark, f"file://{tmp_path}").collect()} == {("é", "utf-8"), ("é", "latin1")}


def test_pending_embeddings_resume(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    nodes = spark.range(5).select(F.col("id").alias("index"))
    files.embed_pending(nodes.where("index < 3"), path, F.array(F.col("index").cast("double")))
    files.embed_pending(nodes, path, F.array(F.col("index").cast("double")))
    assert spark.read.parquet(path).count() == 5


def test_stream_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "d1", 1), (1, "b", "d2", 2), (2, "c", "d1", 3)], "id int, description string, source_document string, seq int")
    root = f"file://{tmp_path}"
    rows.repartition(2).write.parquet(f"{root}/in")
    parts = (["id"], ["description"])
    merged = ingest.MergedStream(spark, f"{root}/merged", rows.schema.simpleString()[7:-1].replace(":", " "), lambda x: merge.partial_state(x, *parts), lambda x: merge.combined(x, *parts))
    merged.start(f"{root}/in").awaitTermination()
    first = sorted(map(str, merge.from_state(merged.read(), *parts).collect()))
    merged.start(f"{root}/in").awaitTermination()
    assert sorted(map(str, merge.from_state(merged.read(), *parts).collect())) == first and len(first) == 2
