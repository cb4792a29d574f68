"""The pipeline's stages, each against what it must do with its own input."""

import corpus_pipeline as P
import sentencepiece
import test_decontaminate
import test_line_dedup
import test_simhash
from graphloom.llm import registry, vocabulary
from graphloom.llm.common import stored
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stored(stage(spark, docs, SF), "test")
        seen.append(docs.count())
        assert 0 < docs.count() <= before.count(), name
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns and docs.where("n_chars <> length(text)").count() == 0
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert sorted((r.doc_id, r.token_ids) for r in docs.collect()) == sorted((r.doc_id, r.token_ids) for r in P.run(spark, SF).collect())
    assert seen[0] > 0.6 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_like_brute_force(spark):
    """Each stage after the classifier, on the rows that its predecessor kept, against plain loops over the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = stored(stage(spark, docs, SF), "test")
        after = {r.doc_id: r for r in docs.collect()}
        if k == 1:
            lines = test_line_dedup.slow(before)
            assert set(after) == {i for i, (n, gone) in lines.items() if n > gone or not gone}
            assert all((after[i].text == text) == (lines[i][1] == 0) for i, text in before if i in after)
        elif k == 2:
            prints = {i: test_simhash.slow_print(t) for i, t in before}
            group = test_simhash.slow_groups(prints.values())
            least = {}
            for i, code in prints.items():
                least[group[code]] = min(i, least.get(group[code], i))
            assert set(after) == set(least.values())
        elif k == 3:
            assert set(after) == {i for i, _, hit, _ in test_decontaminate.slow(before, items) if not hit}
        elif k == 4:
            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary.DEFAULT_MODEL)
            assert {i: list(r.token_ids) for i, r in after.items()} == {i: model.encode(t or "") for i, t in before}
            assert all(r.round_trip and r.decoded == (r.text or "") for r in after.values())


def test_odd_documents(spark):
    """Null and empty texts, repeated rows and ids, ties, a long text and a clashing column pass through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    kinds = dict(docs.dtypes)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one text. " * 20_000), (-3, "one text. " * 20_000), (-4, "tie"), (-4, "other")], "doc_id long, text string")
    odd = odd.select(*((F.col(c) if c in odd.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in docs.columns)).withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    rows = docs.union(odd).withColumn("score", F.lit("clash"))
    for k, (name, stage) in enumerate(P.STAGES):
        done = stored(stage(spark, rows, SF), "test")
        assert k == len(P.STAGES) - 1 or done.columns == rows.columns, name
        rows = done
    assert rows.where("not round_trip").count() == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and set(registry.SQL) <= set(registry.QUERIES)
