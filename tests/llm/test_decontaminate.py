"""Benchmark decontamination against a plain scan."""

import hashlib
import re
from random import Random

from graphloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= ids
                    hit |= set(range(k, k + n))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


PASSAGE = "One two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "short ITEM"), (3, None), (4, ""), (10, PASSAGE + " thirteen"), (1, PASSAGE), (None, "nameless words here")]


def test_like_a_scan(spark, odd_docs):
    texts = [PASSAGE, f"before {PASSAGE.upper()}, after {PASSAGE}", "a short-item", "short x item", "two three four five six seven eight nine ten eleven", PASSAGE.replace(" ", "\n"), "five six", "é short item é", "nameless words here", "short " + "item short " * 2000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id int, text string")
    want = slow(docs, ITEMS)
    for block_bytes in (16_000_000, 300):
        got = D.contamination(rows, items, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == want
        assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)


def test_near_matches(spark):
    rows = spark.createDataFrame([(1, "one two X three four"), (2, "four three two one"), (3, "one two three four")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "one two three four")], "item_id int, text string")
    got = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in D.contamination(rows, items, slop=1).collect()}
    assert got == {1: ([], ["7"]), 2: ([], []), 3: (["7"], [])}


def test_near_matches_by_trying_every_start(spark):
    random = Random(4)
    letters = "a b c d e".split()
    docs = [(i, " ".join(random.choices(letters, k=random.randint(0, 14)))) for i in range(300)]
    items = [(k, " ".join(random.choices(letters, k=random.randint(1, 6)))) for k in range(12)]
    got = {r.doc_id: (set(r["items"]), set(r.near_items)) for r in D.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), width=4, slop=1).collect()}
    for doc, text in docs:
        w = text.split()
        exact, near = set(), set()
        for item, body in items:
            v = body.split()
            for part in ([v] if len(v) < 4 else [v[k : k + 4] for k in range(len(v) - 3)]):
                for s in range(-1, len(w) + 1):
                    if all(x in w[max(0, s + k - 1) : s + k + 2] for k, x in enumerate(part)):
                        near.add(str(item))
                    if s >= 0 and w[s : s + len(part)] == part:
                        exact.add(str(item))
        assert got[doc] == (exact, near - exact)


def test_empty_tables_and_filter(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert D.contamination(no_docs, items).count() == 0
    clean = D.contamination(odd_docs, items.where("false")).collect()
    assert len(clean) == odd_docs.count() and not any(r.n_hit for r in clean)
    kept = D.drop_contaminated(odd_docs, spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id int, text string"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
