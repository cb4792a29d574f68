"""SentencePiece encoding against a plain best-path search and the library."""

import dataclasses
import itertools

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import sentencepiece_codec as S
from graphloom.llm import vocabulary

VOCAB = vocabulary.load()
ENCODER = S.Encoder(VOCAB)
#: The same pieces with scores that are no ranks, as a unigram vocabulary has them.
SUMS = S.Encoder(dataclasses.replace(VOCAB, scores=VOCAB.scores - 0.5))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=vocabulary.DEFAULT_MODEL)
NORMAL = {VOCAB.surfaces[i]: (VOCAB.scores[i] - 0.5, i) for i in VOCAB.normal.tolist()}


def plain(text):
    if not text:
        return []
    s, low = " " + text, min(x for x, _ in NORMAL.values()) - 10
    best = [(0, None, None)] + [None] * len(s)
    for i in range(len(s)):
        alone = False
        for j in range(i + 1, min(len(s), i + 17) + 1):
            piece = s[i:j].encode()
            if piece in NORMAL:
                alone |= j == i + 1
                sums = best[i][0] + NORMAL[piece][0]
                if best[j] is None or sums > best[j][0]:
                    best[j] = (sums, i, [NORMAL[piece][1]])
        if not alone and (best[i + 1] is None or best[i][0] + low > best[i + 1][0]):
            best[i + 1] = (best[i][0] + low, i, [int(VOCAB.byte_ids[b]) for b in s[i].encode()])
    out, k = [], len(s)
    while k:
        out = best[k][2] + out
        k = best[k][1]
    return out


def encoded(texts, encoder=ENCODER):
    ids, ends = encoder.encode([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in itertools.pairwise([0, *ends.tolist()])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ab\n\té漢🎉the"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_best_path(texts):
    assert encoded(texts, SUMS) == [plain(t) for t in texts]


def test_remembered_chunks_do_not_matter():
    texts = ["the same words", "the other words same", "the same words"]
    first = encoded(texts)
    ENCODER.forget()
    assert encoded(texts) == first == LIBRARY.encode(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ab\n\té漢🎉thein"), st.characters(exclude_categories=["Cs"], exclude_characters="▁")), max_size=120), max_size=5))
def test_ids_of_the_library(texts):
    assert encoded(texts) == LIBRARY.encode(texts)


def test_ids_of_the_library_on_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["ab" * 3000, "漢字かな交じり文。" * 300, "the" * 500 + " " + "in" * 40, "  lead", "trail   ", "<s> <unk> <0x0A>"]
    assert encoded(texts) == LIBRARY.encode(texts)


def test_the_library_reads_the_ids():
    texts = ["Hello  world\nthe é 漢字 ", "plain words", " lead"]
    assert [LIBRARY.decode(ids) for ids in encoded(texts)] == texts


def test_round_trip_of_odd_rows(spark, odd_docs, no_docs):
    done = S.with_token_ids(odd_docs, out_col="x").withColumn("again", S.decode(F.col("x")))
    rows = done.collect()
    assert len(rows) == odd_docs.count() and set(done.columns) == {*odd_docs.columns, "again"}
    assert all(r.again == (r.text or "") for r in rows)
    assert S.with_token_ids(no_docs).count() == 0
    assert [r.t for r in spark.sql("select null as ids union all select array(1, 2)").select(S.decode(F.col("ids").cast("array<int>")).alias("t")).collect()] == ["", ""]


def test_contract_query(spark):
    got = S.op9_sentencepiece_codec(spark, "/root/testdata/sf0.001")
    assert got.where("not round_trip or n_ids = 0").count() == 0
