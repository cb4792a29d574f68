"""License scans against exact containment in every window."""

import re

from graphloom.llm import license_scan as L

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def slow(docs, templates):
    out = {}
    wanted = {name: set(shingles(text)) for name, text in templates.items()}
    for doc, text in docs:
        h = shingles(text)
        for name, want in wanted.items():
            c = 1 << (len(want) - 1).bit_length()
            for at in range(0, max(0, -(-len(h) // c) - 2) * c + 1, c) if h else ():
                share = len(want & set(h[at : at + 2 * c])) / len(want)
                if share >= 0.8:
                    n, best, first = out.get((doc, name), (0, 0, at))
                    out[doc, name] = (n + 1, max(best, share), min(first, at))
    return out


def rows_of(found):
    return {(r.doc_id, r.template): (r.n_windows, r.containment, r.first_word) for r in found.collect()}


def test_like_exact_containment(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(L.op3_license_scan(spark, SF))
    assert got == slow(docs, L.TEMPLATES | L.full_texts()) and got


def test_long_templates_inside_texts(spark):
    pad = " ".join(f"pad{i}" for i in range(150))
    templates = L.TEMPLATES | {"long": " ".join(f"term{i * i % 1009}" for i in range(3000))}
    docs = [(i, f"{pad} {text} {pad}") for i, text in enumerate(templates.values())] + [(99, pad)]
    got = rows_of(L.scan(spark.createDataFrame(docs, "doc_id int, text string"), templates))
    assert got == slow(docs, templates) and {(i, n) for i, n in enumerate(templates)} <= set(got)


def test_rows_that_share_an_id_or_have_none(spark):
    """Each row is verified by itself, in whatever order they come."""
    mit = L.TEMPLATES["MIT/grant"]
    rows = [(7, "nothing of the kind in this text but released under the MIT license words"), (7, mit), (None, mit), (None, "permission is hereby granted to no one at all here"), (7, None), (None, "")]
    want = None
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = rows_of(L.scan(spark.createDataFrame(order, "doc_id int, text string").coalesce(1)))
        assert {(7, "MIT/grant"), (7, "MIT/notice"), (None, "MIT/grant")} == set(got) and got[7, "MIT/grant"][:2] == (1, 1.0)
        assert want in (None, got)
        want = got


def test_bands_reach_the_stated_certainty():
    for n in range(1, 3000, 37):
        (group,) = L.classes_of([n])
        share = 0.8 * n / (2 * group.size + 0.2 * n)
        assert n <= group.size < 2 * n and 1 - (1 - share) ** group.bands >= 0.999


def test_without_templates(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    assert L.scan(docs, {"empty": " .. "}).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    assert L.scan(odd_docs).count() == 0 and L.scan(no_docs).count() == 0
