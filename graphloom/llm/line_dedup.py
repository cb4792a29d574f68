"""Line dedup over overlapping windows of three lines, with built-in functions only.

Texts are cut into lines at line ends, and long lines further at sentence ends, after words of a certain ending and after
a number of words, so that a passage that was pasted into another line soon has lines of its own wherever it begins. Each
window of three consecutive lines is hashed. A window's first occurrence, by document and place, is found by a grouped
minimum over all documents; all later ones are covered, covered places of a document are merged, and the covered lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import maybe_among, stored

WINDOW, LINE_WORDS, LEAST_WORDS = 3, 10, 1
#: What ends a line of the text itself.
LINE_END = r"""(\n|[.!?。！？…]["')\]}»”’」』）]*[ \t\r]*)$"""
#: Latin small letters by their code points modulo 8. A word ends a line if its last two letters are of these residues. Any
#: rule would do that depends on the word alone; this one picks about one word in nine of English, French, German or Spanish.
LETTERS = ["".join(c for c in map(chr, range(0x61, 0x100)) if c.isalpha() and ord(c) % 8 == k) for k in range(8)]
PICKED = f"[{LETTERS[0]}{LETTERS[1]}{LETTERS[5]}{LETTERS[7]}][{LETTERS[5]}{LETTERS[7]}]"


def lines_of(text: Column, line_words: int = LINE_WORDS) -> Column:
    """The lines of a text as an array; joined, they are the text again.

    A line ends at a line end. With `line_words` it also ends after a word that ends a sentence and after one whose last
    two letters are `PICKED`: these places depend on the word alone, so equal passages are cut alike from the first of them
    on. What lies between two such places is cut every `line_words` words. Runs without blanks end after full-width marks.
    A line keeps the blanks that follow it; an empty one may stand at the end. 0: real lines only.
    """
    if not line_words:
        return _matches(text, r"(?s)[^\n]*+(?:\n|$)")
    goes_on = rf"""(?<![.!?…])(?<![.!?…]["')\]}}»”’」』）])(?<!{PICKED})"""
    word = r"[^ \t\r\n]*+"
    plain = rf"(?:{word}{goes_on}[ \t\r]++){{0,{line_words - 1}}}+{word}(?:[ \t\r]++\n?|\n|$)"
    # the regular expressions of Java are ten times as slow with wide characters in the class that matches most
    word = r"[^ \t\r\n。！？]*+"
    wide = rf"(?:{word}{goes_on}[ \t\r]++){{0,{line_words - 1}}}+{word}[。！？]*+[」』）”’]*+(?:[ \t\r]++\n?|\n|$|(?<=[。！？」』）”’]))"
    return F.when(text.contains("。") | text.contains("！") | text.contains("？"), _matches(text, wide)).otherwise(_matches(text, plain))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def full_lines(text: Column, line_words: int = LINE_WORDS) -> Column:
    return F.filter(lines_of(text, line_words), lambda x: F.length(F.btrim(x, F.lit(" \t\r\n"))) > 0)


def ids_are_unique(docs: DataFrame, id_col: str) -> bool:
    """Whether no id is null or repeated, so that it names a text by itself."""
    return docs.groupBy(F.col(id_col).alias("id")).count().where("id is null or count > 1").isEmpty()


def text_hash(id_: Column, text: Column, unique: bool = False) -> Column:
    """Tells texts of one id apart: 32 bits where there is an id, which shuffles smaller, and 64 among texts without one; 0 for unique ids."""
    full = F.xxhash64(text)
    return F.lit(0).cast("long") if unique else F.when(id_.isNull(), full).otherwise(full.bitwiseAND(0xFFFFFFFF))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS, unique: bool = False) -> DataFrame:
    """(id, th, place, hash) of each window of non-blank lines with `least_words` words or more; th tells texts of one id apart.

    Lines are compared without surrounding blanks. A text of fewer lines is one window of all of them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.filter(F.transform(lines_of(text, line_words), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(id_col), text, unique).alias("th"), plain.alias("x"))
    rows = rows.select("id", "th", F.transform("x", lambda x: F.xxhash64(x)).alias("h"), *([F.transform("x", lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("w")] if least_words > 1 else []))
    places = F.sequence(F.lit(1), F.greatest(F.size("h") - window, F.lit(0)) + 1)
    hashes = F.transform(places, lambda k: F.xxhash64(*(F.get("h", k - 1 + j) for j in range(window))))
    if least_words > 1:
        words = F.transform(places, lambda k: sum((F.coalesce(F.get("w", k - 1 + j), F.lit(0)) for j in range(1, window)), F.coalesce(F.get("w", k - 1), F.lit(0))))
        hashes = F.transform(F.arrays_zip(hashes.alias("hash"), words.alias("words")), lambda x: F.when(x["words"] >= least_words, x["hash"]))
    # outer: else Spark asks first, with all expressions worked out twice, whether there is anything to explode
    return rows.select("id", "th", F.posexplode_outer(F.when(F.size("h") > 0, hashes)).alias("place", "hash")).where("hash is not null")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS, unique: bool = False) -> DataFrame:
    """(id, th, places): for each text with later occurrences the numbers of the non-blank lines that they cover, merged."""
    found = stored(windows(docs, id_col, text_col, window, least_words, line_words, unique), "line-windows")
    first = found.groupBy("hash").agg(F.min("id").alias("first_id"), *([] if unique else [F.min(F.when(F.col("id").isNull(), F.col("th"))).alias("first_th")]), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first, "line-repeats")
    # most windows occur once, and a bitmap keeps nearly all of these from the join
    some = maybe_among(found.drop("th") if unique else found, "hash", first.select(F.col("hash").alias("id"))).where("_maybe").drop("_maybe")
    hits = some.join(first, "hash")
    keys = ["id"] if unique else ["id", "th"]
    if unique:
        hits = hits.withColumns({"th": F.lit(0).cast("long"), "first_th": F.lit(None).cast("long")})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy(*keys, "hash")
    hits = hits.repartition(n, *keys).withColumn("own", F.min("place").over(own))
    elsewhere = F.when(F.col("first_id").isNull(), F.col("th") > F.col("first_th")).otherwise(F.col("id").isNull() | (F.col("id") > F.col("first_id")))
    # a later occurrence that overlaps the first one in the same text leaves the first one's lines
    start = F.when(elsewhere, F.col("place")).otherwise(F.greatest(F.col("place"), F.col("own") + window))
    later = hits.where(elsewhere | (F.col("place") > F.col("own"))).select(*keys, F.sequence(start, F.col("place") + window - 1).alias("places"))
    merged = later.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    return merged.select("id", (F.lit(0).cast("long") if unique else F.col("th")).alias("th"), "places")


def full_runs(lines: Column, places: Column, window: int, line_words: int) -> Column:
    """Those of the covered `places` whose runs are `window` lines long in the text itself, as an array.

    Pieces of a cut line are lines only by the way they are compared. A run stays covered if it has `window` ends of lines
    or sentences or of the text, or as many words as that many cut lines, or is all of the text; a stock phrase is none.
    """
    nothing = F.expr("cast(array() as array<struct<a: int, b: int>>)")
    last = F.size(lines) - 1

    def closed(run: Column) -> Column:
        enough = (run["ends"] >= window) | (F.lit(line_words > 0) & (run["words"] >= window * max(line_words, 1))) | ((run["a"] == 0) & (run["b"] == last))
        return F.when((run["b"] >= run["a"]) & enough, F.concat(run["runs"], F.array(F.struct(run["a"].alias("a"), run["b"].alias("b"))))).otherwise(run["runs"])

    def add(run: Column, place: Column) -> Column:
        line = F.get(lines, place)
        ends = F.when((place == last) | line.rlike(LINE_END), 1).otherwise(0)
        words = F.regexp_count(line, F.lit(r"\S+"))
        on = place == run["b"] + 1
        longer = F.struct(run["runs"].alias("runs"), run["a"].alias("a"), place.alias("b"), (run["words"] + words).alias("words"), (run["ends"] + ends).alias("ends"))
        return F.when(on, longer).otherwise(F.struct(closed(run).alias("runs"), place.alias("a"), place.alias("b"), words.alias("words"), ends.alias("ends")))

    start = F.struct(nothing.alias("runs"), F.lit(0).alias("a"), F.lit(-2).alias("b"), F.lit(0).alias("words"), F.lit(0).alias("ends"))
    runs = F.aggregate(F.array_sort(F.filter(places, lambda x: x <= last)), start, add, closed)
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["b"])))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS, full_runs_only: bool = False) -> DataFrame:
    """`docs` with `text_col` less the lines of later occurrences, and (n_lines, n_removed), which replace columns of these names.

    A window occurs first in the text with the smallest id; texts without an id come last, those in the order of their
    hashes. Rows that share an id do not count as repeats of each other, and rows that repeat id and text lose the same
    lines. Within a text the first place counts. Null texts stay null and have no lines, like empty ones. Every window counts,
    however short its lines; a higher `least_words` leaves windows of fewer words alone, and `full_runs_only` leaves covered
    runs that are shorter than `window` lines of the text itself. An empty table gives an empty one. A text of any length is
    cut within its own row; the lines of one text must fit into a task's memory. Only texts that may have repeats are
    shuffled, once.
    """
    unique = ids_are_unique(docs, id_col)
    found = stored(covered(docs, id_col, text_col, window, least_words, line_words, unique), "line-places").toDF("_dedup_id", "_dedup_found", "_dedup_places")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = maybe_among(docs, id_col, found.select(F.col("_dedup_id").alias("id"))).withColumn("_dedup_th", text_hash(F.col(id_col), text, unique))
    same = F.col(id_col).eqNullSafe(F.col("_dedup_id")) & (F.col("_dedup_th") == F.col("_dedup_found"))
    some = keyed.where("_maybe").join(found, same, "left").drop("_dedup_id", "_dedup_found")
    rest = keyed.where("not _maybe").withColumn("_dedup_places", F.lit(None).cast("array<int>"))
    joined = some.unionByName(rest).withColumn("_dedup_lines", full_lines(text, line_words))
    places, full = F.col("_dedup_places"), F.col("_dedup_lines")

    def kept(b: Column) -> Column:
        numbers = F.when(F.size(b["lines"]) > 0, F.sequence(F.lit(0), F.size(b["lines"]) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        gone = full_runs(b["lines"], b["places"], window, line_words) if full_runs_only else b["places"]
        return F.transform(F.array_except(numbers, gone), lambda k: F.get(b["lines"], k))

    # b is a variable: a filter that Spark moves below would otherwise cut the text anew for each line
    left = F.transform(F.array(F.struct(full.alias("lines"), places.alias("places"))), kept)[0]
    joined = joined.withColumn("_dedup_left", F.when(places.isNotNull(), left))  # a column, so it is worked out once
    left = F.col("_dedup_left")
    changed = F.when(places.isNull() | (F.size(left) == F.size(full)), F.col(text_col)).otherwise(F.rtrim(F.array_join(left, "")))
    counts = {"n_lines": F.size(full).cast("long"), "n_removed": F.when(places.isNotNull(), F.size(full) - F.size(left)).otherwise(0).cast("long")}
    return joined.withColumns(counts | {text_col: changed}).drop("_dedup_places", "_dedup_th", "_dedup_lines", "_dedup_left", "_maybe")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars, text) of every whole document after line dedup over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = without_repeats(docs)
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` without repeated lines, `n_chars` renewed; a document all of whose lines were repeats goes; same columns."""
    done = without_repeats(docs).withColumn("_dedup_row", F.monotonically_increasing_id())  # keeps the filter above, so that texts are cut once
    done = done.where("(n_removed = 0 or text <> '') and _dedup_row >= 0")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
