"""Phrase collocations against a plain count of all phrases, and the query against its SQL."""

import re
from collections import Counter, defaultdict
from random import Random

import duckdb
import pytest

from graphloom.llm import collocations as C

UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER))]


def slow(docs, least_n, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, seen in f.items():
        often = {p: a for p, a in seen.items() if a >= least_n}
        inside = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and inside[p] < a:
                score, _, l, r = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], score) for i, (score, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def made():
    random = Random(12)
    vocabulary = ["a", "b", "The", "the", "é", "x\x00y", "word", "漢字", "it's", "\xa0"]
    out = []
    for _ in range(300):
        words = random.choices(vocabulary, [9, 7, 5, 4, 3, 2, 2, 1, 1, 1], k=random.randrange(0, 40))
        out.append((random.choice(["en", "de", None]), "".join(w + random.choice([" ", " ", " ", "\t", " \t ", ". ", ",", "\n", "\r\n", ":", "!?", "\x0b"]) for w in words)))
    return [*out, ("en", "a " * 500), ("en", None), ("und", "a b a b a b"), ("fr", "")]


@pytest.mark.parametrize("segment_words", [C.SEGMENT_WORDS, 40])
def test_like_a_plain_count(spark, made, odd_docs, segment_words):
    docs = made + [(r.lang if "lang" in r else None, r.text) for r in odd_docs.collect()]
    df = spark.createDataFrame([(*r, 7, "x", 5) for r in docs], "lang string, text string, n int, word string, seg int").repartition(3)
    for least_n, top in ((20, 2000), (3, 25)):
        got = sorted(tuple(r) for r in C.collocations(df, least_n=least_n, top=top, segment_words=segment_words).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        want = slow(docs, least_n, top=top)
        assert got == want and len(want) > 20


def test_phrases_are_summed_in_parts(spark, made, monkeypatch):
    monkeypatch.setattr(C, "PART", 1 << 12)
    df = spark.createDataFrame(made, "lang string, text string").repartition(3)
    assert sorted(map(tuple, C.collocations(df, least_n=3, segment_words=40).collect())) == slow(made, 3)


def test_a_segment_has_a_row_for_each_part_and_not_for_each_phrase():
    """1,000 phrases of two words leave a task in one row for each of two parts, beside that of their lists."""
    words = C.np.random.default_rng(1).permutation(C.np.arange(1000).repeat(3))
    places = [C.np.flatnonzero(words == k).astype(C.np.int32) for k in range(1000)]
    row = {"seg": [5], "lists": [C._packed(C.np.concatenate(places))], "counts": [C.np.full(1000, 3, C.np.int32).tobytes()], "ids": [C.np.arange(1000).tobytes()], "endings": [C.np.arange(1000).tobytes()]}
    enough = type("B", (), {"value": C.np.full(C.LEAST_SUMS // 8, 255, C.np.uint8)})
    rows = [r for b in C._extended(C.LEAST_SUMS, enough, False, C.LEAST_SUMS // 2)([C.pa.record_batch(row)]) for r in b.to_pylist()]
    assert [r["part"] for r in rows] == [None, 0, 1]
    n = Counter(zip(words.tolist(), words[1:].tolist()))
    got = {}
    for r in rows[1:]:
        got |= {(a, b): c for a, b, c in zip(*(C.np.frombuffer(r[x], kind).tolist() for x, kind in (("left", "i8"), ("right", "i8"), ("n", "i4"))), strict=True)}
    assert got == n and len(got) > 1000


def test_a_long_text_is_cut_after_pieces_only(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD_BYTES", 50)
    text = "one two three four, five one two three four five. " * 40 + "one two three four five " * 30
    segments = C.Segments(60, 1000)
    monkeypatch.setattr(C, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    batch = C.pa.record_batch([C.pa.array(["en"]), C.pa.array([text])], ["lang", "text"])
    rows = [r for b in segments([batch]) for r in b.to_pylist()]
    assert len({r["seg"] for r in rows}) > 3
    n = Counter()
    for r in rows:
        if r["word"] is not None:
            n[r["word"]] += r["n"]
    assert n == Counter(w for p in pieces(text) for w in p)
    monkeypatch.undo()
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    assert sorted(map(tuple, C.collocations(df, least_n=20, segment_words=60).collect())) == slow([("en", text)], 20)


def test_exact_beyond_64_bits(spark):
    row = spark.sql("select cast(1000 as decimal(4,0)) * cast(3000000000000000000 as decimal(19,0)) * cast(100000000000000 as decimal(15,0)) div (cast(4000000000000000000 as decimal(19,0)) * cast(3000000000000000001 as decimal(19,0))) as x").first()
    assert row.x == 1000 * 3 * 10**18 * 10**14 // (4 * 10**18 * (3 * 10**18 + 1))


def test_nothing(spark, no_docs):
    empty = no_docs.selectExpr("cast(null as string) as lang", "text")
    assert C.collocations(empty).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\n")], "lang string, text string")).collect() == []


def test_query_gives_what_sql_gives(spark):
    sf = "/root/testdata/sf0.001"
    df = C.op12_phrase_collocations(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(C.OP12_SQL)
    want = sorted(map(str, cursor.fetchall()))
    assert df.columns == [c[0] for c in cursor.description] and want
    assert sorted(map(str, map(tuple, df.collect()))) == want
