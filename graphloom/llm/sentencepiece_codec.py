"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut at word marks, which no piece of the vocabulary crosses, and the distinct chunks are laid end
to end. A suffix array over that text gives by binary search the range of suffixes that begin with each piece, which are
all its occurrences. These are the edges of a lattice, sorted by position. The scores of a unigram vocabulary relax them in
one pass, for all chunks together, and the path with the largest sum is read back. The scores of a merge vocabulary are
ranks: there an edge joins two neighbours of a path of single characters, the edge of the best score first, until no edge
is left that does; the library encodes by the same order and gives the same ids. A character that no piece covers becomes
byte pieces. A worker remembers the ids of chunks of earlier batches, up to a fixed number, and indexes the new ones only.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import vocabulary
from graphloom.llm.common import small_batches, texts_as_bytes
from graphloom.llm.vocabulary import Vocabulary

#: Bytes of text that are encoded together, of distinct chunks in one suffix array, and chunks that an encoder remembers.
BATCH_BYTES, INDEX_BYTES, REMEMBERED = 2_000_000, 128_000, 400_000
#: Characters of a chunk up to which chunks are merged side by side; a longer one is merged by itself, through a queue.
SHORT = 48
#: Ids that are decoded together.
DECODED = 20_000
#: What an unknown character costs below the lowest score of a piece, as in SentencePiece.
UNKNOWN_PENALTY = 10.0

_CHUNK = re.compile(rb" +[^ ]*")


def _words64(data: np.ndarray) -> np.ndarray:
    """For each place the next eight bytes as one big-endian number, with zeros past the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


class SuffixArray:
    """Places of a text in the order of their first sixteen bytes; longer patterns are compared on from there."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        head = _words64(data)
        tail = np.concatenate((head[8:], np.zeros(min(8, len(head)), np.uint64)))
        self.order = np.argsort(head)
        same = np.flatnonzero(head[self.order[1:]] == head[self.order[:-1]])  # only equal heads need their tails compared
        tied = np.union1d(same, same + 1)
        places = self.order[tied]
        self.order[tied] = places[np.lexsort((tail[places], head[places]))]
        self.head, self.tail = head[self.order], tail[self.order]
        self.size = len(data)

    def ranges(self, heads: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.head, heads), np.searchsorted(self.head, heads | masks, "right")


class Encoder:
    """Best-path encoding with a vocabulary's pieces."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        ids = vocab.normal
        ids = ids[np.argsort(np.array([vocab.surfaces[i][:8].ljust(8, b"\0") for i in ids]), kind="stable")]  # in order, for quick searches
        self.ids = ids
        self.lens = np.array([len(vocab.surfaces[i]) for i in ids], np.int64)
        self.scores = vocab.scores[ids]
        self.unknown_score = float(self.scores.min()) - UNKNOWN_PENALTY
        padded = np.zeros((len(ids), 16), np.uint8)
        for k, i in enumerate(ids.tolist()):
            piece = vocab.surfaces[i][:16]
            padded[k, : len(piece)] = np.frombuffer(piece, np.uint8)
        self.heads, self.tails = padded[:, :8].copy().view(">u8").ravel().astype(np.uint64), padded[:, 8:].copy().view(">u8").ravel().astype(np.uint64)
        self.forget()
        self.head_masks, self.tail_masks = self._masks(np.minimum(self.lens, 8)), self._masks(np.clip(self.lens - 8, 0, 8))

    @staticmethod
    def _masks(n: np.ndarray) -> np.ndarray:
        return np.array([(1 << (8 * (8 - int(k)))) - 1 for k in n], np.uint64)

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of all occurrences of all pieces, piece as an index into `ids`."""
        index = SuffixArray(data)
        low, high = index.ranges(self.heads, self.head_masks)
        for k in np.flatnonzero((self.lens > 8) & (high > low)).tolist():
            tail = index.tail[low[k] : high[k]]
            low[k], high[k] = low[k] + np.searchsorted(tail, self.tails[k]), low[k] + np.searchsorted(tail, self.tails[k] | self.tail_masks[k], "right")
        n = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(n)), n)
        place = index.order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        over = np.flatnonzero(self.lens[piece] > 16)
        if len(over):
            drop = [e for e in over.tolist() if data[place[e] : place[e] + self.lens[piece[e]]].tobytes() != self.vocab.surfaces[self.ids[piece[e]]]]
            piece, place = np.delete(piece, drop), np.delete(place, drop)
        return place, piece

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct non-empty chunks: (ids one after another, number of ids of each chunk)."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(chunks), np.uint8)
        chunk_of = np.repeat(np.arange(len(chunks), dtype=np.int32), sizes)
        place, piece = self.occurrences(data)
        size = self.lens[piece]
        inside = place + size <= (starts + sizes)[chunk_of[place]]
        place, piece, size = place[inside], piece[inside], size[inside]
        best = self._merged if self.vocab.merges else self._heaviest
        place, size, token, owner = best(data, starts, sizes, chunk_of, place, piece, size)
        width = np.where(token < 0, size, 1)
        ids = np.repeat(token, width)
        at = np.repeat(place - (np.cumsum(width) - width), width) + np.arange(len(ids))
        ids = np.where(ids < 0, self.vocab.byte_ids[data[np.minimum(at, len(data) - 1)]], ids)
        return ids, np.bincount(owner, width, minlength=len(chunks)).astype(np.int64)

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk_of: np.ndarray, place: np.ndarray, piece: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, bytes, piece or -1, chunk) of the symbols left when edges have joined neighbours, best scores first, leftmost among equals."""
        wide = int(self.lens.max()) + 1
        order = np.argsort(place * wide + size)
        keys, pieces = (place * wide + size)[order], piece[order]

        def among(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Pieces over the given bytes, as indexes into `ids`, -1 for none."""
            long = end - start
            want = start * wide + np.minimum(long, wide - 1)
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            return np.where((long < wide) & (keys[at] == want), pieces[at], -1) if len(keys) else np.full(len(start), -1)

        def score(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            found = among(start, end)
            return np.where(found >= 0, self.scores[found], -np.inf)

        begins = (data & 0xC0) != 0x80
        begins[starts] = True
        start = np.flatnonzero(begins)
        end, of = np.append(start[1:], len(data)), chunk_of[start]
        counts = np.bincount(of, minlength=len(starts))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(counts > SHORT).tolist():
            mine = slice(*np.searchsorted(of, [k, k + 1]).tolist())
            done.append(_queued(start[mine], end[mine], score))
        short = counts[of] <= SHORT
        start, end, of = start[short], end[short], of[short]
        ahead = np.append(end[1:], 0)
        pair = np.where(np.append(of[1:] == of[:-1], False), score(start, np.where(ahead > start, ahead, end)), -np.inf) if len(of) else np.zeros(0)
        while len(start):
            heads = np.flatnonzero(np.diff(of, prepend=-1))
            top = np.repeat(np.maximum.reduceat(pair, heads), np.diff(np.append(heads, len(of))))
            alive = np.isfinite(top)
            if not alive.all():
                done.append((start[~alive], end[~alive]))
                start, end, of, pair, top = start[alive], end[alive], of[alive], pair[alive], top[alive]
                if not len(start):
                    break
            hit = np.flatnonzero(pair == top)
            hit = hit[np.diff(of[hit], prepend=-1) != 0]
            end[hit] = end[hit + 1]
            keep = np.ones(len(start), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the joined symbols are now
            start, end, of, pair = start[keep], end[keep], of[keep], pair[keep]
            for left in (at, at[at > 0] - 1):
                inside = np.flatnonzero(of[left] == of[np.minimum(left + 1, len(of) - 1)])
                pair[left] = -np.inf
                inside = inside[left[inside] + 1 < len(of)]
                pair[left[inside]] = score(start[left[inside]], end[left[inside] + 1])
        start, end = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (start, end)
        order = np.argsort(start)
        start, end = start[order], end[order]
        found = among(start, end)
        return start, end - start, np.where(found >= 0, self.ids[found], -1), chunk_of[start]

    def _heaviest(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk_of: np.ndarray, place: np.ndarray, piece: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, bytes, piece or -1, chunk) along the path of each chunk with the largest sum of scores."""
        chunks = len(starts)
        # characters without a piece of their own get an edge of their own
        lead = np.select([data < 0x80, data >= 0xF0, data >= 0xE0, data >= 0xC0], [1, 4, 3, 2], 0)
        alone = np.zeros(len(data), bool)
        alone[place[size == lead[place]]] = True
        extra = np.flatnonzero((lead > 0) & ~alone)
        place = np.concatenate((place, extra))
        size = np.concatenate((size, np.minimum(lead[extra], (starts + sizes)[chunk_of[extra]] - extra)))
        score = np.concatenate((self.scores[piece], np.full(len(extra), self.unknown_score)))
        token = np.concatenate((self.ids[piece], np.full(len(extra), -1)))
        step = place - starts[chunk_of[place]]
        order = np.argsort(step)
        place, size, score, token, step = place[order], size[order], score[order], token[order], step[order]
        source = place + chunk_of[place]  # one node more than bytes in each chunk
        best = np.full(len(data) + chunks, -np.inf)
        best[starts + np.arange(chunks)] = 0
        back = np.full(len(best), -1)
        cuts = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(step)], strict=True):
            target, sums = source[a:b] + size[a:b], best[source[a:b]] + score[a:b]
            better = np.flatnonzero(sums > best[target])
            best[target[better]] = sums[better]
            back[target[better]] = a + better
        at, goal = starts + sizes + np.arange(chunks), starts + np.arange(chunks)
        active, taken, owners = np.arange(chunks), [], []
        while len(active):
            edge = back[at[active]]
            taken.append(edge)
            owners.append(active)
            at[active] = source[edge]
            active = active[at[active] > goal[active]]
        edges, owner = np.concatenate(taken), np.concatenate(owners)
        order = np.argsort(source[edges])
        edges, owner = edges[order], owner[order]
        return place[edges], size[edges], token[edges], owner


    def _chunks(self, text: bytes) -> list[bytes]:
        """Chunks without the first blank that each has."""
        if not text:
            return []
        if not self.vocab.within_words:
            return [text]
        if b"  " in text or text[0] == 32 or text[-1] == 32:
            return [x[1:] for x in _CHUNK.findall(b" " + text)]
        return text.split(b" ")

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ends of the texts' ids)."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        numbers, before, flat = self.numbers, len(self.numbers), []
        for text in texts:
            found = self._chunks(text)
            flat.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        ids, counts = [self.known_ids], [self.known_counts]
        for group in _groups(itertools.islice(numbers, before, None), INDEX_BYTES):
            if group:
                found, n = self.encode_chunks([b" " + x for x in group])
                ids.append(found.astype(np.int32))
                counts.append(n.astype(np.int32))
        self.known_ids, self.known_counts = np.concatenate(ids), np.concatenate(counts)
        heads = np.cumsum(self.known_counts, dtype=np.int64) - self.known_counts
        out, sizes = [np.zeros(0, np.int32)], []
        for at in flat:
            n = self.known_counts[at]
            ends = np.cumsum(n, dtype=np.int64)
            sizes.append(int(ends[-1]) if len(ends) else 0)
            out.append(self.known_ids[np.repeat(heads[at] - (ends - n), n) + np.arange(sizes[-1])])
        return np.concatenate(out), np.cumsum(sizes)

    def forget(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.known_ids, self.known_counts = np.zeros(0, np.int32), np.zeros(0, np.int32)


def _queued(start: np.ndarray, end: np.ndarray, score) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one long chunk after the same merges, by a queue of pairs: time grows with the chunk's length only."""
    n = len(start)
    first, last = start.tolist(), end.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(-s, i, last[i + 1]) for i, s in enumerate(score(start[:-1], end[1:]).tolist()) if s != -np.inf]
    heapq.heapify(queue)
    while queue:
        _, i, upto = heapq.heappop(queue)
        j = after[i]
        if first[i] < 0 or j >= n or last[j] != upto:  # one of the two has been joined since
            continue
        last[i], first[j], after[i] = upto, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        ends = [(a, b) for a, b in ((before[i], i), (i, after[i])) if a >= 0 and b < n]
        for (a, b), s in zip(ends, score(np.array([first[a] for a, _ in ends]), np.array([last[b] for _, b in ends])).tolist() if ends else (), strict=True):
            if s != -np.inf:
                heapq.heappush(queue, (-s, a, last[b]))
    left = [k for k in range(n) if first[k] >= 0]
    return np.array([first[k] for k in left]), np.array([last[k] for k in left])


#: Encoders of this worker by the vocabulary's fingerprint, so that later tasks find what earlier ones remembered.
_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocab: Vocabulary) -> Encoder:
    key = zlib.crc32(b"\0".join(vocab.surfaces) + vocab.scores.tobytes())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab)
    return _ENCODERS[key]


def _groups(texts: Iterable[bytes], most: int) -> Iterable[list[bytes]]:
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size > most:
            yield held
            held, size = [], 0
    yield held


def encode(text: Column, model: str = vocabulary.DEFAULT_MODEL) -> Column:
    """Token ids as array<int>; null and empty texts give an empty array."""
    vocab = vocabulary.load(model)

    @F.arrow_udf("array<int>")
    def encode_pieces(column: pa.Array) -> pa.Array:
        own = _encoder(vocab)
        ids, ends, base = [], [np.zeros(1, np.int64)], 0
        for group in _groups(texts_as_bytes(column), BATCH_BYTES):
            found, upto = own.encode(group)
            ids.append(found)
            ends.append(upto + base)
            base += len(found)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))

    return encode_pieces(text)


def decode(ids: Column, model: str = vocabulary.DEFAULT_MODEL) -> Column:
    """The text of token ids; null and empty arrays give "". Control ids have no text, and bytes that are no UTF-8 become U+FFFD."""
    vocab = vocabulary.load(model)

    lens = np.fromiter(map(len, vocab.surfaces), np.int64, len(vocab.surfaces))
    heads, pieces = np.cumsum(lens) - lens, b"".join(vocab.surfaces)

    @F.arrow_udf("string")
    def decode_pieces(column: pa.Array) -> pa.Array:
        column = column.fill_null([]) if column.null_count else column
        data, out = np.frombuffer(pieces, np.uint8), []
        bounds = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + DECODED, "right")) - 1)
            found = values[bounds[a] : bounds[b]]
            n = lens[found]
            text = data[np.repeat(heads[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
            ends = np.concatenate(([0], np.cumsum(n)))[bounds[a : b + 1] - bounds[a]].tolist()
            for i, j in itertools.pairwise(ends):
                x = text[i + 1 : j] if text[i : i + 1] == b" " and j > i else text[i:j]
                out.append(x.decode("utf-8", "replace"))
            a = b
        return pa.array(out, pa.string())

    return decode_pieces(ids)


def with_token_ids(docs: DataFrame, text_col: str = "text", out_col: str = "token_ids", model: str = vocabulary.DEFAULT_MODEL) -> DataFrame:
    """`docs` with the token ids of `text_col` in `out_col`, which replaces a column of that name. Rows are independent.

    Lowers the session's limits of an Arrow batch.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, encode(F.col(text_col), model))


def op9_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, token_ids, round_trip) of every whole document; round_trip: decoding the ids gives the text again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_token_ids(docs)
    again = found.withColumn("again", decode(F.col("token_ids")))
    return again.select("doc_id", F.size("token_ids").cast("long").alias("n_ids"), "token_ids", (F.col("again") == F.coalesce("text", F.lit(""))).alias("round_trip"))
