"""Spelling variants against a plain scan of all pairs, and the query against its SQL."""

import itertools
import re
import zlib
from collections import Counter
from random import Random

import duckdb
import pytest

from graphloom.llm import spelling as S

UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def counted(docs):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow(seen):
    beside = {w: [] for w in seen}
    for a, b in itertools.combinations(seen, 2):
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    forms = {}
    for w, found in beside.items():
        best = min(found, key=lambda v: (-seen[v], v), default=None)
        forms[w] = best if best is not None and seen[best] >= 10 * seen[w] else None
    out = []
    for w in seen:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, seen[w], len(beside[w]), seen.get(forms[w])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def made():
    """Documents over few letters, with doubled ones, so that words have many neighbours and chains of forms."""
    random = Random(11)
    base = ["".join(random.choice("abéÀÿ") for _ in range(random.choice((7, 7, 8, 9)))) for _ in range(40)]
    words = base + [w[:i] + random.choice("aabé") + w[i + random.choice((0, 1)) :] for w in base for i in range(0, 7, 2)] + ["aaaaaaa", "aaaaaaaa", "aaaaaab", "bananas", "bannanas", "banaas"]
    weights = [random.choice((1, 1, 2, 30, 400)) for _ in words]
    return [(k, ", ".join(random.choices(words, weights, k=60)) + random.choice((".", " Bananas BANANAS", "1"))) for k in range(120)]


def test_like_a_scan_of_all_pairs(spark, made, odd_docs):
    docs = made + [(r.doc_id, r.text) for r in odd_docs.collect()]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, word string, n int")
    seen = counted(docs)
    vocabulary = S.words(df)
    assert {r.word: r.n for r in vocabulary.collect()} == seen
    want = slow(seen)
    assert rows(S.variants(vocabulary)) == want
    assert any(r[1] for r in want)


def test_chains_of_forms(spark):
    vocabulary = {"abcdefg": 2, "abcdefh": 20, "abcdeeh": 200, "abcddeh": 2000, "abddeeh": 1, "abcdeh": 5000, "zzzzzzz": 20000}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = rows(S.variants(df))
    assert got == slow(vocabulary)
    assert {r[0]: r[2] for r in got}["abcdefg"] not in ("abcdefg", "abcdefh")


def test_several_passes_find_the_same(spark, made):
    vocabulary = S.words(spark.createDataFrame(made, "doc_id long, text string"), least_length=2, least_n=1)
    whole = sorted(map(tuple, S.near_words(vocabulary).collect()))
    seen = {r.word: r.n for r in vocabulary.collect()}
    assert whole == sorted((a, b, seen[b]) for a in seen for b in seen if near(a, b))
    wide = spark.createDataFrame([(w + c, 1) for w in seen for c in map(chr, range(0xC0, 0x100))], "word string, n long")
    # a bitmap of one block, so that the vocabulary comes in several slices
    assert wide.count() * S.BITS_EACH / 2 > 2 * S.BLOCK
    assert S.near_words(wide, most_bits=S.BLOCK).count() == S.near_words(wide).count()


def test_every_neighbour_once():
    class Sent:
        value = None

    class All(S.Neighbours):
        def maybe(self, hashes):
            self.hashes.extend(hashes.ravel().tolist())
            return S.np.arange(hashes.size)

    word, alphabet = b"aabbcx", b"abcdx"
    made = All(alphabet, 1 << 16, 1, 0, Sent())
    made.hashes = []
    letters = S.np.frombuffer(word, S.np.uint8).reshape(1, -1)
    found = [row.tobytes() for _, out in made.of(letters) for row in out]
    want = {word[:i] + word[i + 1 :] for i in range(6)} | {word[:i] + bytes([c]) + word[i + 1 :] for i in range(6) for c in alphabet} | {word[:i] + bytes([c]) + word[i:] for i in range(7) for c in alphabet}
    assert sorted(found) == sorted(want - {word})
    # the hashes that were asked for are those of the words spelled out
    spelled = {int(S._hashes(S.np.frombuffer(x, S.np.uint8).reshape(1, -1))[0]) for x in found}
    assert spelled <= set(made.hashes)


def test_nothing(spark, no_docs, odd_docs):
    assert S.variants(S.words(no_docs)).collect() == []
    assert S.variants(S.words(odd_docs.where("text is null"))).collect() == []
    long = "ab" * 20_000
    got = rows(S.variants(S.words(spark.createDataFrame([(1, f"{long} {long}"), (None, long[:-1]), (None, f"{long[:-1]} ")], "doc_id int, text string"), typo_every=None)))
    assert [(len(r[0]), r[4]) for r in got] == [(39_999, 1), (40_000, 1)]


def test_query_gives_what_sql_gives(spark):
    sf = "/root/testdata/sf0.001"
    df = S.op11_spelling_variants(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(S.OP11_SQL)
    assert df.columns == [c[0] for c in cursor.description]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, cursor.fetchall()))
