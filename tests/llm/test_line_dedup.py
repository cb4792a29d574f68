"""Line dedup against a plain scan."""

import re

from pyspark.sql import functions as F

from graphloom.llm import line_dedup as L

SF = "/root/testdata/sf0.001"


STEP = re.compile(r"([^ \t\r\n。！？]*)([。！？]*[」』）”’]*)([ \t\r]*)(\n?)")


def lines(text, n=10):
    """Up to n words, or to one that ends a sentence or has a picked pair of letters at its end, or to a line end."""
    out, line, words, at = [], "", 0, 0
    while at < len(text):
        word, marks, blanks, end = STEP.match(text, at).groups()
        tail = word[-2:]
        stop = bool(re.search(r"""[.!?…]["')\]}»”’」』）]?$""", word)) and not re.search(r"""^["')\]}»”’]$""", word) or bool(re.fullmatch(L.PICKED, tail))
        words += 1
        if marks or not blanks or stop or words == n:
            out.append(line + word + marks + blanks + end)
            at += len(word + marks + blanks + end)
            line, words = "", 0
        else:
            line += word + blanks
            at += len(word + blanks)
    return [x for x in [*out, line] if x]


def slow(rows, window=3, least=1, full_runs_only=False):
    full = [[x for x in lines(t or "") if x.strip(" \t\r\n")] for _, t in rows]
    found = {}
    for d, ls in enumerate(full):
        plain = [x.strip(" \t\r\n") for x in ls]
        for k in range(max(1, len(ls) - window + 1) if ls else 0):
            part = tuple(plain[k : k + window])
            if sum(x.count(" ") + 1 for x in part) >= least:
                found.setdefault(part, []).append((rows[d][0], d, k))
    gone = [set() for _ in rows]
    for places in found.values():
        first = min(i for i, _, _ in places)
        for i, d, k in places:
            own = min(kk for ii, dd, kk in places if dd == d)
            if i > first:
                gone[d] |= set(range(k, k + window))
            elif k > own:
                gone[d] |= set(range(max(k, own + window), k + window))
    for d, ls in enumerate(full if full_runs_only else []):
        kept, run = set(), []
        for k in [*sorted(x for x in gone[d] if x < len(ls)), -9]:
            if run and k != run[-1] + 1:
                ends = sum(x == len(ls) - 1 or bool(re.search(L.LINE_END, ls[x])) for x in run)
                if ends >= window or sum(len(ls[x].split()) for x in run) >= 10 * window or len(run) == len(ls):
                    kept |= set(run)
                run = []
            run.append(k)
        gone[d] = kept
    return {i: (len(ls), len(g & set(range(len(ls))))) for (i, _), ls, g in zip(rows, full, gone, strict=True)}


def test_like_a_scan(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in L.op6_line_dedup(spark, SF).collect()}
    assert got == slow(rows)
    full = L.without_repeats(spark.read.parquet(f"{SF}/documents.parquet"), full_runs_only=True)
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in full.collect()} == slow(rows, full_runs_only=True) != got


def test_lines_join_to_the_text(spark, odd_docs):
    rows = odd_docs.where("text is not null").select("text", F.array_join(L.lines_of(F.col("text")), "").alias("again")).collect()
    assert all(r.text == r.again for r in rows)


PASSAGE = " ".join(f"word{i}" for i in range(55))


def test_passages_anywhere(spark):
    texts = {1: f"first doc.\n{PASSAGE}\nover one.", 2: f"second doc.\n{PASSAGE}\nover two.", 3: f"Third. {PASSAGE} third ends differently here.", 4: "clean text with nothing repeated in it at all, but long enough to make several lines of words"}
    got = {r.doc_id: r.text for r in L.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()}
    assert got[1] == texts[1] and got[4] == texts[4]
    assert got[2] == "second doc.\nover two." and "word3" not in got[3] and got[3].startswith("Third.")


def test_copies_and_repeats_within_a_text(spark, odd_docs, no_docs):
    line = "w1 w2 w3 w4 w5 w6 w7.\n"
    rows = spark.createDataFrame([(2, line * 6), (1, "x y z. " * 3), (3, line * 3), (3, line * 3)], "doc_id int, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in L.without_repeats(rows).collect())
    assert got == [(1, 3, 0), (2, 6, 3), (3, 3, 3), (3, 3, 3)]
    done = L.without_repeats(odd_docs)
    assert done.count() == odd_docs.count() and set(odd_docs.columns) <= set(done.columns)
    assert L.without_repeats(no_docs).count() == 0
    assert L.drop_repeated_lines(odd_docs).columns == odd_docs.columns


def test_short_lines_count(spark):
    verse = "\n".join(f"v{i}" for i in range(20))
    texts = {1: f"One begins.\n{verse}\nOne ends.", 2: f"Two begins.\n{verse}\nTwo ends."}
    got = {r.doc_id: (r.text, r.n_removed) for r in L.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()}
    assert got == {1: (texts[1], 0), 2: ("Two begins.\nTwo ends.", 20)}


def test_pastes_at_every_word_offset(spark):
    passage = " ".join(f"{a}{b}" for a in "ka lo mi nu re so ta vu".split() for b in "ban cod dif gul hem jor kip lat".split())
    texts = {i: " ".join([*(f"own{i}x{j}" for j in range(i)), passage, f"rest{i} of text{i}"]) for i in range(13)}
    texts |= {20: f'He said "so!" {passage}', 21: "a\tb\t" + passage.replace(" ", "\t"), 22: "c\t" + passage.replace(" ", "\t"), 23: f"終わり。{passage}"}
    got = {r.doc_id: r.text for r in L.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()}
    assert got[0] == texts[0] and got[21] == texts[21]
    words = set(passage.split())
    assert {i: n for i in got if i not in (0, 21) and (n := len(words & set(got[i].split()))) > 20} == {}


def test_lines_keep_the_text(spark):
    texts = ["一。二！三？」四 five", "x\r\ny \t\r\n z", ' q." (r?) s', "слово за словом и ещё много слов " * 9]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", L.lines_of(F.col("text")).alias("x")).collect()
    assert all("".join(r.x) == r.text and "" not in r.x[:-1] for r in rows)
    assert rows[0].x[:3] == ["一。", "二！", "三？」"] and [x for x in rows[2].x if x] == [' q." ', "(r?) ", "s"]


def test_real_lines_and_least_words(spark):
    texts = {1: "a b\nc d\ne f\ng. h i", 2: "x\na b\nc d\ne f\ny"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.without_repeats(rows, line_words=0).collect()}
    assert got == {1: (texts[1], 4, 0), 2: ("x\ny", 5, 3)}
    assert [r.n_removed for r in L.without_repeats(rows, line_words=0, least_words=7).collect()] == [0, 0]


def test_bitmap_lets_no_id_through(spark):
    ids = spark.range(0, 5000, 7)
    rows = L.maybe_among(spark.range(6000).withColumnRenamed("id", "doc_id"), "doc_id", ids)
    got = {r.doc_id: r._maybe for r in rows.collect()}
    assert len(got) == 6000 and all(got[i] for i in range(0, 5000, 7)) and sum(got.values()) < 1200


def test_short_passages_and_menus_go(spark):
    passage = "to the reader of the page a note on the use of the text and of all the rest that he may find in it"
    menu = "Home. News. Shop. About. Help. Jobs. Blog. Shipping. Terms. Contact."
    texts = {1: f"One begins here. {passage} one ends.", 2: f"Two begins here. {passage} two ends.", 3: f"{menu}\nThird text.", 4: f"{menu}\nFourth text."}
    got = {r.doc_id: r.text for r in L.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()}
    assert got[1] == texts[1] and got[3] == texts[3]
    assert got[2].startswith("Two begins here.") and len(got[2].split()) <= 12 and got[4] == "Fourth text."


def test_stock_phrases_stay_where_asked(spark):
    phrase = "to the reader of the page a note on the use of the text"
    texts = {i: f"Own{i} begin{i} word{i}. {phrase} own{i}b, and more{i}b." for i in range(4)} | {9: "Home\nAbout us\nContact\nnine is here.", 10: "Home\nAbout us\nContact\nten was here!"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r.text for r in L.without_repeats(rows, full_runs_only=True).collect()}
    assert got == texts | {10: "ten was here!"}
    assert {r.doc_id: r.text for r in L.without_repeats(rows).collect()} != got
