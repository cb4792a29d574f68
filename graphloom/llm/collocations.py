"""Phrase collocations from vertical lists of positions.

Texts are cut into segments of a bounded number of words, each stored as an inverted index of its own: for each word the
ascending list of its positions. A frequent phrase is extended by merging its list, one step on, with the lists of the words
that stand beside it there; of these only the places are kept where the word ends another frequent phrase of the same
length, since no other extension can be frequent. The length of a list is the phrase's exact frequency in the segment, and
these lengths are summed over all segments by an exchange: of words, a row for each word and segment; of longer phrases, a row
for each segment and part of the phrases, with arrays of what the segment has of them. Before it, lengths are
summed by a hash of the phrase, and phrases whose sum is too small are let go with their lists; the hash lets some more pass,
but none is lost. A segment reports each frequent phrase it has, so there are at most as many such reports as words for each
length, and more of them in each segment the more text there is, until all its phrases are frequent. Phrases are known by their first place in the corpus, so no hash can take one for another, and no table of
words or phrases is ever sent to all.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import pieces_of, small_batches, stored, texts_as_bytes

LEAST_N, LONGEST, TOP = 100, 5, 2000
#: Words and distinct words after which a segment ends where the next piece does.
SEGMENT_WORDS, SEGMENT_DISTINCT = 4_000_000, 600_000
#: A segment's number is its task's, of which there are under 2^20, before 12 bits; a place has the number before 31 bits.
TASK_BITS, SHIFT = 12, 31
#: Bytes of text that are split at once.
HELD_BYTES = 1_000_000
#: Words for each sum by hash, the least and the most such sums, and the sums of a block.
WORDS_EACH, LEAST_SUMS, MOST_SUMS, BLOCK = 16, 1 << 16, 1 << 28, 1 << 16
#: Sums whose phrases are summed exactly in one group.
PART = 1 << 18

#: A-Z in lower case, a tab as a blank, and each end of a piece as a line end.
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_WORD, _BLANK = re.compile(rb"[^ \n]+|\n+"), re.compile(rb"[ \n]")

#: Rows of a level: `lists` holds all lists of a segment, in the order of their codes, in one row. Besides, each word's list has
#: a row of its own, with its code, language, text, length and first position; those of longer phrases have a row for each part,
#: with an array each of codes, what they extend and by what, lengths and first positions.
_FIRST = "seg long, lists binary, counts binary, code int, lang string, word string, n int, first int"
_NEXT = "seg long, lists binary, counts binary, part int, codes binary, left binary, right binary, n binary, first binary"
#: Rows of the phrases that are frequent in all segments: one for each of them; besides, for each segment, the codes it has for
#: those of a part, their ids and the words that end them.
_FOUND = "id long, left long, right long, total long, seg long, codes binary, ids binary, endings binary"
#: Rows of the lists that go on: those of a segment in one row, with the ids of their phrases and of the words that end these;
#: besides, for a block of sums, what the extended phrases of the segment add to it.
_KEPT = "seg long, lists binary, counts binary, ids binary, endings binary, block int, at binary, n binary"


def _packed(positions: np.ndarray) -> bytes:
    """Steps between positions, all of their low bytes first, which compresses well."""
    return np.diff(positions, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(lists: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(lists, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel(), dtype=np.int32)


class _Codes(dict):
    """Codes of the words of one language; those of all languages of a segment are numbered together. 0: the end of a piece."""

    def __init__(self, lang: str, names: list) -> None:
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        if word.startswith(b"\n"):
            found = 0
        else:
            self.names.append((self.lang, word))
            found = len(self.names)
        self[word] = found
        return found


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words and ends of pieces of a text; a long one is cut at blanks and piece ends to be split."""
    text, at = text.translate(_TO), 0
    while at < len(text):
        end = _BLANK.search(text, at + HELD_BYTES) if len(text) - at > HELD_BYTES else None
        upto = end.start() if end else len(text)
        yield _WORD.findall(text, at, upto)
        at = upto


class Segments:
    """The inverted index of each segment of a task's texts (lang, text); a segment may end within a text, after a piece."""

    def __init__(self, most_words: int, most_distinct: int) -> None:
        self.most_words, self.most_distinct = most_words, most_distinct

    def begin(self) -> None:
        self.names: list[tuple[str, bytes]] = []
        self.codes: dict[str, _Codes] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        own = self.codes.get(lang)
        if own is None:
            own = self.codes[lang] = _Codes(lang, self.names)
        self.held.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << TASK_BITS
        self.begin()
        for batch in batches:
            for rows in pieces_of(batch, HELD_BYTES):
                for lang, text in zip(rows.column("lang").to_pylist(), texts_as_bytes(rows.column("text")), strict=True):
                    for k, words in enumerate(_parts(text)):
                        if self.size > self.most_words or len(self.names) > self.most_distinct:
                            cut = next((i for i, w in enumerate(words) if w[:1] == b"\n"), None) if k else 0
                            if cut is not None:
                                self.add(lang, words[:cut])
                                yield from _first_level(seg, self.names, self.held)
                                self.begin()
                                seg, words = seg + 1, words[cut:]
                        self.add(lang, words)
                    self.add(lang, [b"\n"])
        yield from _first_level(seg, self.names, self.held)


def _first_level(seg: int, names: list, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not names:
        return
    words = np.concatenate(held)
    places = np.flatnonzero(words).astype(np.int32)
    own = words[places] - 1
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(names))
    firsts = places[order][np.cumsum(counts) - counts]
    keys = {"lang": pa.array([x for x, _ in names], pa.string()), "word": pa.array([x for _, x in names], pa.binary()).cast(pa.string())}
    yield _rows(_FIRST, 1, seg=pa.array([seg]), **_all_lists(places[order], counts))
    size = len(counts)
    yield from _sliced(_rows(_FIRST, size, seg=pa.array(np.full(size, seg)), code=pa.array(np.arange(size, dtype=np.int32)), n=pa.array(counts.astype(np.int32)), first=pa.array(firsts), **keys))


def _all_lists(positions: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    return {"lists": pa.array([_packed(positions)], pa.binary()), "counts": pa.array([counts.astype(np.int32).tobytes()], pa.binary())}


def _rows(schema: str, size: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of a schema; columns that are not given are null."""
    fields = _arrow(schema).schema
    return pa.record_batch([columns[x.name] if x.name in columns else pa.nulls(size, x.type) for x in fields], fields)


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, 50_000):
        yield batch.slice(a, 50_000)


def _pairs(places: np.ndarray, counts: np.ndarray, ids: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, ...]:
    """(left, right, n, first, positions) of the phrases one word longer: what they extend, by which word, and their lists."""
    # lists merged by position: a phrase and what stands one step on are neighbours then
    order = np.argsort(places, kind="stable")
    places, own = places[order], np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
    at = np.flatnonzero(np.diff(places) == 1)
    distinct, ending = np.unique(endings, return_inverse=True)
    pair = own[at].astype(np.int64) * max(1, len(distinct)) + ending[own[at + 1]]
    order = np.argsort(pair, kind="stable")
    pair, places = pair[order], places[at][order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    left, right = np.divmod(pair[starts], max(1, len(distinct)))
    return ids[left], distinct[right], np.diff(starts, append=len(pair)), places[starts], places


def _bucket(left: np.ndarray, right: np.ndarray, sums: int) -> np.ndarray:
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - (sums.bit_length() - 1))).astype(np.int64)


def _kept(sums: int, least_n: int):
    """A function of a segment's lists and the codes of those that are frequent in all segments: the lists that go on, and sums."""
    none, size = _arrow(_KEPT), np.uint8 if least_n < 256 else np.uint32

    def run(key: tuple, lists: pa.Table, frequent: pa.Table) -> pa.Table:
        if not lists.num_rows or not frequent.num_rows:
            return none
        if "codes" in frequent.column_names:
            codes, ids, endings = (np.concatenate([np.frombuffer(y.as_buffer(), kind) for y in frequent.column(x)]) for x, kind in (("codes", np.int32), ("ids", np.int64), ("endings", np.int64)))
        else:
            codes, ids, endings = (frequent.column(x).to_numpy() for x in ("code", "id", "ending"))
        order = np.argsort(codes)
        codes, ids, endings = codes[order], ids[order], endings[order]
        counts = np.frombuffer(lists.column("counts")[0].as_py(), np.int32)
        some = np.zeros(len(counts), bool)
        some[codes] = True
        places, counts = _unpacked(lists.column("lists")[0].as_py())[np.repeat(some, counts)], counts[codes]
        out = [{"seg": key[0].as_py(), "lists": _packed(places), "counts": counts.tobytes(), "ids": ids.tobytes(), "endings": endings.tobytes()}]
        left, right, n, _, _ = _pairs(places, counts, ids, endings)
        bucket = _bucket(left, right, sums)
        order = np.argsort(bucket, kind="stable")
        bucket, n = bucket[order], n[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        bucket, n = bucket[starts], np.minimum(np.add.reduceat(n, starts) if len(starts) else n, least_n).astype(size)
        cuts = np.flatnonzero(np.diff(bucket // BLOCK, prepend=-1))
        for a, b in itertools.pairwise([*cuts, len(bucket)]):
            out.append({"block": int(bucket[a] // BLOCK), "at": (bucket[a:b] % BLOCK).astype(np.uint16).tobytes(), "n": n[a:b].tobytes()})
        return pa.Table.from_pylist(out, none.schema)

    return run


def _enough(least_n: int):
    """A function of what all segments add to a block of sums: the block's bits, set where the sum is `least_n` or more."""
    size = np.uint8 if least_n < 256 else np.uint32

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(batch.schema.get_field_index("at")), batch.column(batch.schema.get_field_index("n")), strict=True):
                total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), size)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least_n, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    return run


def _extended(sums: int, enough, last: bool, part: int):
    """A function of lists that go on: those of the phrases one word longer whose sum by hash is large enough."""
    kinds = {"codes": np.int32, "left": np.int64, "right": np.int64, "n": np.int32, "first": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = enough.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, endings = (np.frombuffer(row[x], np.int64) for x in ("ids", "endings"))
                left, right, n, first, places = _pairs(_unpacked(row["lists"]), np.frombuffer(row["counts"], np.int32), ids, endings)
                bucket = _bucket(left, right, sums)
                some = (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)
                if some.any():
                    places = places[:0] if last else places[np.repeat(some, n)]
                    seg = pa.array([row["seg"]])
                    yield _rows(_NEXT, 1, seg=seg, **_all_lists(places, n[some]))
                    parts = bucket[some] // part
                    order = np.argsort(parts, kind="stable")
                    parts = parts[order]
                    each = {"codes": order, "left": left[some][order], "right": right[some][order], "n": n[some][order], "first": first[some][order]}
                    for a, b in itertools.pairwise([*np.flatnonzero(np.diff(parts, prepend=-1)), len(parts)]):
                        yield _rows(_NEXT, 1, seg=seg, part=pa.array([parts[a]], pa.int32()), **{x: pa.array([each[x][a:b].astype(kind).tobytes()], pa.binary()) for x, kind in kinds.items()})

    return run


def _summed(least_n: int, last: bool):
    """A function of what all segments have of a part's phrases: those that are frequent, and for each segment its codes of them."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = {"codes": np.int32, "left": np.int64, "right": np.int64, "n": np.int32, "first": np.int32}, []
        for batch in batches:
            for row in batch.select(["seg", *kinds]).to_pylist():
                own = [np.frombuffer(row[x], kind) for x, kind in kinds.items()]
                held.append((np.full(len(own[0]), row["seg"], np.int64), *own))
        seg, codes, left, right, n, first = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(left) != 0) | (np.diff(right) != 0)])
        total = np.add.reduceat(n[order].astype(np.int64), starts)
        ids = np.minimum.reduceat((seg[order] << SHIFT) + first[order], starts)
        some = total >= least_n
        if not some.any():
            return
        yield from _sliced(_rows(_FOUND, int(some.sum()), id=pa.array(ids[some]), left=pa.array(left[starts][some]), right=pa.array(right[starts][some]), total=pa.array(total[some])))
        if last:
            return
        size = np.diff(starts, append=len(left))
        own = np.flatnonzero(np.repeat(some, size))
        own = own[np.argsort(seg[order][own], kind="stable")]
        seg, codes, ids, endings = seg[order][own], codes[order][own], np.repeat(ids, size)[own], right[own]
        for a, b in itertools.pairwise([*np.flatnonzero(np.diff(seg, prepend=-1)), len(seg)]):
            yield _rows(_FOUND, 1, seg=pa.array(seg[a : a + 1]), **{x: pa.array([y[a:b].tobytes()], pa.binary()) for x, y in (("codes", codes), ("ids", ids), ("endings", endings))})

    return run


def _arrow(schema: str) -> pa.Table:
    """An empty table of a schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]).empty_table()


def _frequent(level: DataFrame, least_n: int) -> DataFrame:
    """(seg, code, n, first, id, total, lang, word) of the lists of words that occur `least_n` times or more in all segments."""
    same = Window.partitionBy("lang", "word")
    place = F.shiftleft("seg", SHIFT) + F.col("first")
    rows = level.where("code is not null").select("seg", "code", "first", "n", "lang", "word")
    return rows.withColumns({"total": F.sum("n").over(same), "id": F.min(place).over(same)}).where(F.col("total") >= least_n)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_n: int = LEAST_N, longest: int = LONGEST, segment_words: int = SEGMENT_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, words, f) of all phrases of 1 to `longest` words that occur `least_n` times or more, (lang, n) of all words).

    Counts are exact, over all texts; overlapping occurrences count. No phrase crosses the end of a piece or of a text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    level = stored(texts.mapInArrow(Segments(segment_words, SEGMENT_DISTINCT), _FIRST), "word-lists")
    totals = level.where("code is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    sums = min(MOST_SUMS, max(LEAST_SUMS, 1 << (n_words // WORDS_EACH).bit_length()))
    found, out, names = _frequent(level, least_n), [], None
    for k in range(1, longest + 1):
        found = stored(found, f"phrases-{k}")
        if k == 1:
            # the row that the id tells of: one for each word
            each = found.where(F.col("id") == F.shiftleft("seg", SHIFT) + F.col("first"))
            names = each.select("id", "lang", F.array("word").alias("words"), F.col("total").alias("f"))
            own = found.select("seg", "code", "id", F.col("id").alias("ending"))
            words = names
        else:
            each = found.where("id is not null").select("id", "left", "right", "total")
            longer = each.join(out[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("before")), "left")
            longer = longer.join(names.select(F.col("id").alias("right"), F.col("words").alias("added")), "right")
            words = stored(longer.select("id", "lang", F.concat("before", "added").alias("words"), F.col("total").alias("f")), f"phrase-words-{k}")
            own = found.where("codes is not null").select("seg", "codes", "ids", "endings")
        out.append(words)
        if k == longest:
            break
        parts = level.where("lists is not null").select("seg", "lists", "counts").groupBy("seg").cogroup(own.groupBy("seg"))
        kept = stored(parts.applyInArrow(_kept(sums, least_n), _KEPT), f"phrase-kept-{k}")
        bits = np.zeros(sums // 8, np.uint8)
        added = kept.where("block is not null").select("block", "at", "n").groupBy("block")
        for row in added.applyInArrow(_enough(least_n), "block int, bits binary").toLocalIterator():  # `sums` bits
            bits[row.block * (BLOCK // 8) : (row.block + 1) * (BLOCK // 8)] = np.frombuffer(row.bits, np.uint8)
        longer = kept.where("block is null").select("seg", "lists", "counts", "ids", "endings")
        level = stored(longer.mapInArrow(_extended(sums, spark.sparkContext.broadcast(bits), k + 1 == longest, PART), _NEXT), f"phrase-lists-{k + 1}")
        found = level.where("part is not null").groupBy("part").applyInArrow(_summed(least_n, k + 1 == longest), _FOUND)
    return reduce(DataFrame.union, [x.select("lang", "words", "f") for x in out]), totals


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_n: int = LEAST_N, longest: int = LONGEST, top: int | None = TOP, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two words or more, best first, `top` of them or all.

    A phrase's score is that of its worst cut into two parts, floor(1000 * a * n / (l * r)) in exact arithmetic, where a, l
    and r count the phrase and its parts and n all words. Phrases that occur no more often than a longer one around them go.
    A null language is `und`; a null text is empty; rows that repeat count again; an empty table has no phrases.
    """
    found, totals = phrases(docs, text_col, lang_col, least_n, longest, segment_words)
    found = stored(found.select("lang", "words", "f", F.size("words").alias("k")), "phrases-all")
    part = found.select("lang", "words", "f")
    long = found.where("k > 1")
    inside = long.where("k > 2").select("lang", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.slice("words", i, m))))).alias("words"))
    covered = inside.groupBy("lang", "words").agg(F.max("f").alias("around"))
    kept = long.join(covered, ["lang", "words"], "left").where("around is null or around < f")
    cuts = kept.select("lang", F.col("words").alias("all"), F.col("f").alias("a"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(F.slice("words", F.lit(1), i).alias("first"), F.slice("words", i + 1, F.col("k") - i).alias("rest")))).alias("cut", "x"))
    cuts = cuts.select("lang", "all", "a", "cut", F.col("x.first").alias("words"), F.col("x.rest").alias("rest")).join(part.withColumnRenamed("f", "l"), ["lang", "words"]).drop("words")
    cuts = cuts.withColumnRenamed("rest", "words").join(part.withColumnRenamed("f", "r"), ["lang", "words"]).drop("words").join(totals, "lang")
    cuts = cuts.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * _whole(F.col("a")) * F.col("n").cast("decimal(15,0)"), "below": _whole(F.col("l")) * _whole(F.col("r"))})
    scored = cuts.withColumn("score", F.expr("above div below"))
    worst = scored.groupBy("lang", "all").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x"))
    rows = worst.select("lang", F.array_join("all", " ").alias("phrase"), "x.*")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    return best.select("lang", *(F.col(x).cast("long").alias(x) if x != "phrase" else F.col(x) for x in ("rank", "phrase", "a", "l", "r", "n", "score")))


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `documents` table."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP12_SQL = """with pieces as (select row_number() over () as piece, lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents)),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
grams as materialized (select lang, words, count(*) as f from (
  select lang, k, w[i + 1 : i + k] as words from (select lang, w, k, unnest(range(len(w) - k + 1)) as i from pieces, range(1, 6) t(k) where len(w) >= k)) group by lang, words having count(*) >= 100),
inside as (select distinct lang, f, words[i + 1 : i + m] as words from (select lang, f, words, m, unnest(range(len(words) - m + 1)) as i from grams, range(2, 5) t(m) where len(words) > m)),
kept as (select * from grams g where len(words) > 1 and not exists (select 1 from inside x where x.lang = g.lang and x.words = g.words and 100 * x.f >= 100 * g.f)),
cuts as (select lang, words, f as a, k, words[1 : k] as head, words[k + 1 :] as rest from (select *, unnest(range(1, len(words))) as k from kept)),
scored as (select c.lang, c.words, c.a, k, x.f as l, y.f as r, n, (1000::hugeint * c.a * n) // (x.f::hugeint * y.f) as score from cuts c join grams x on x.lang = c.lang and x.words = head join grams y on y.lang = c.lang and y.words = rest join totals t on t.lang = c.lang),
worst as (select *, row_number() over (partition by lang, words order by score, k) as place from scored),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(words, ' ')) as rank, array_to_string(words, ' ') as phrase, a, l, r, n, score::bigint as score from worst where place = 1)
select * from ranked where rank <= 2000"""
