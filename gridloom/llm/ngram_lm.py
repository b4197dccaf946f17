"""Language-model scoring with a log-frequency Bloom filter.

The model is an interpolated bigram model. The counts of words and of pairs of words of all training texts are
quantised to ``q = 1 + floor(log_BASE count)`` and put into a Bloom filter as the q events (n-gram, 1) … (n-gram, q). A
count is read back by probing (n-gram, 1), (n-gram, 2), … up to the first that is absent; q stands for the middle of
its range. The probability of w after v is

    (c(v w) + t(v) * p(w)) / (c(v) + t(v)),    p(w) = (c(w) + 1) / (N + V + 1),    t(v) = c(v) ** beta

(Witten-Bell's form; beta is such that t, the number of different words after v, adds up to the number of different
pairs in the corpus). Counts come from the filter, N and V are exact.

Counting is distributed: tasks count the n-grams of their texts, deal 64-bit hashes and counts out by segments of the
filter, and the task of a segment adds the counts and sets the segment's bits. The number of segments grows with the
corpus, so that none holds the n-grams of more than about SEGMENT_TOKENS tokens, and nothing is left out.

A filter that cannot have more than ``max_bits`` comes to the driver and is broadcast to the scoring tasks. A larger one
stays where it is: the texts are stored once in compressed slices of up to SLICE_ROWS rows, a slice sends its pairs' keys and its
words, with their counts in training texts, to their segments once; a segment adds the counts, sets its bits, probes them for all
n-grams it has got, and sends the levels and the words' exact counts back, and the slice's texts are scored whole. Both ways read the
same bits, so ``max_bits`` changes no score.

The base score needs exact counts of words: segments send them, or, with a broadcast filter, those of the ``TOP`` most frequent
words are broadcast and all others are joined.

Cases: null text is the empty text, whose only token is its end; a null id is in the training part; repeated rows are
scored each; texts of any length are scored whole; with no training text every count is zero and the score falls back to p(w).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import Batches, saved, stored, tasks_of, texts_of

#: A word never holds white space, so these stand for a text's start and its end.
START, END = b"\t", b"\n"
BASE = 1.5
#: Segments at least, a power of two, and tokens for each beyond that.
SEGMENTS, SEGMENT_TOKENS = 1024, 1 << 20
HASHES = 5
BITS_PER_EVENT = 7.3
TOP = 1 << 16
SLICE = 4_000_000
#: Bytes of text that a task has as tokens at a time, and rows of a batch that it has as Python objects.
RUN, ROWS = 1_000_000, 256
#: Distinct pairs that a task gathers before it deals them out, and words that it counts or numbers.
GATHERED, HELD = 1_000_000, 250_000
#: Rows of a slice of texts at most.
SLICE_ROWS = 4096

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0xD6E8FEB86659FD93) + mix(b))


def word_key(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes)


def segments_of(tokens: int) -> int:
    """Number of segments for a corpus of so many tokens."""
    return max(SEGMENTS, 1 << (max(tokens, 1) // SEGMENT_TOKENS).bit_length())


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> U(65 - segments.bit_length())).astype(np.int64)


def quantise(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


#: Whole counts that share a quantised value lie between two powers of BASE; their middle stands for them.
MIDDLE = np.array([0.0, *[(math.ceil(BASE ** (q - 1) - 1e-9) + max(math.ceil(BASE**q - 1e-9) - 1, math.ceil(BASE ** (q - 1) - 1e-9))) / 2 for q in range(1, 120)]])


def places(keys: np.ndarray, level: int, sizes: np.ndarray):
    """The HASHES bit places of the events (key, level), one array after another, within segments of ``sizes`` bits."""
    h = mix(keys + U((level * 0xA24BAED4963EE407) % 2**64))
    low, high = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    for i in range(HASHES):
        yield ((low + U(i) * high) & U(0xFFFFFFFF)) * sizes >> U(32)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, bitmap) for the distinct keys of one segment."""
    q = quantise(counts)
    bits = max(64, math.ceil(BITS_PER_EVENT * int(q.sum())))
    table = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        keys, q = keys[q >= level], q[q >= level]
        for at in places(keys, level, U(bits)):
            table[at.astype(np.int64)] = True
    return bits, np.packbits(table).tobytes()


def probe(keys: np.ndarray, sizes: np.ndarray, begins: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Quantised count of each key, whose segment has a size in bits and begins at a byte of the bitmap: probes one level
    after another until one is absent."""
    out = np.zeros(len(keys), np.int64)
    live, level = np.arange(len(keys)), 1
    while len(live) and level < len(MIDDLE):
        k, size, begin = keys[live], sizes[live], begins[live]
        here = np.arange(len(k))
        for at in places(k, level, size):
            at = at[here].astype(np.int64)
            here = here[(bitmap[begin[here] + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
        live = live[here]
        out[live] = level
        level += 1
    return out


def probe_one(keys: np.ndarray, bits: int, raw: bytes) -> np.ndarray:
    """Quantised counts of keys of one segment."""
    return probe(keys, np.full(len(keys), bits, np.uint64), np.zeros(len(keys), np.int64), np.frombuffer(raw, np.uint8))


@dataclass
class Filter:
    """All segments in one bitmap."""

    sizes: np.ndarray
    begins: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def join(cls, rows: list[tuple[int, int, bytes]], segments: int) -> Filter:
        sizes, begins, parts, at = np.full(segments, 64, np.uint64), np.zeros(segments, np.int64), [bytes(8)], 8
        for segment, bits, raw in sorted(rows):
            sizes[segment], begins[segment] = bits, at
            parts.append(raw)
            at += len(raw)
        return cls(sizes, begins, np.frombuffer(b"".join(parts), np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        segment = segment_of(keys, len(self.sizes))
        return probe(keys, self.sizes[segment], self.begins[segment], self.bitmap)


class Words:
    """Numbers the words of one task; keeps at most ``most`` of them."""

    def __init__(self, most: int = HELD):
        self.most, self.number, self.hashes = most, {}, np.zeros(0, np.uint64)

    def numbers(self, tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Number of each token, and the words that are new."""
        if len(self.number) > self.most:
            self.number, self.hashes = {}, np.zeros(0, np.uint64)
        number = self.number
        before = len(number)
        ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
        new = list(number)[before:] if len(number) > before else []
        digest = xxhash.xxh64_intdigest
        self.hashes = np.r_[self.hashes, np.fromiter((digest(t) for t in new), np.uint64, len(new))]
        return ids, new


def each_text(column: pa.Array) -> Iterator[bytes]:
    """The texts of a batch, of which only ROWS are Python objects at a time."""
    for at in range(0, len(column), ROWS):
        yield from texts_of(column.slice(at, ROWS))


def tokens_of(texts: Iterable[bytes]):
    """Runs of texts, about RUN bytes each, as one list of tokens with the number of tokens of each text."""
    tokens, lengths, size = [], [], 0
    for t in texts:
        found = t.lower().split()
        found.append(END)
        tokens += found
        lengths.append(len(found))
        size += len(t)
        if size >= RUN:
            yield tokens, np.array(lengths)
            tokens, lengths, size = [], [], 0
    if lengths:
        yield tokens, np.array(lengths)


def contexts(ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hash of the token before each token."""
    before = np.r_[U(0), hashes[ids[:-1]]]
    before[np.cumsum(lengths) - lengths] = U(xxhash.xxh64_intdigest(START))
    return before


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, of several lists of keys and counts, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def cut(keys: np.ndarray, segments: int):
    """The segments of sorted keys, each with the slice of its keys."""
    segment = segment_of(keys, segments)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(keys) else np.zeros(0, np.int64)
    bounds = np.r_[starts, len(keys)]
    return segment[starts], [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, and so on: the high bytes of sorted keys and of counts compress well."""
    return np.ascontiguousarray(numbers.view("u1").reshape(len(numbers), numbers.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(width, len(raw) // width).T).reshape(-1).view(kind)


def dealt(keys: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """One row per segment: its keys in order, eight bytes each, and their counts, two bytes each or, where one is too
    large, eight."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order].astype("<u8"), counts[order]
    segment, parts = cut(keys, segments)
    small, large = counts.astype("<u2"), counts.astype("<u8")
    columns = [pa.array([planes(keys[p]) for p in parts], pa.binary()), pa.array([planes((small if counts[p].max() < 1 << 16 else large)[p]) for p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), *columns], ["segment", "keys", "counts"])


DEALT = "segment int, keys binary, counts binary"


def in_training(id_column: str = "doc_id"):
    """True for the texts that the model learns from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0)) % 7 != 2


def counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """``token binary, c long`` over a table of one text column; ends of texts are counted as END."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            counts: Counter = Counter()
            for tokens, _ in tokens_of(each_text(batch.column(0))):
                counts.update(tokens)
                if len(counts) >= HELD:
                    yield counted(counts)
                    counts.clear()
            if counts:
                yield counted(counts)

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def count_tokens(texts: DataFrame) -> tuple[int, int]:
    """Numbers of tokens and of texts of a table of one text column."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n = sum(len(t.split()) + 1 for t in each_text(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["tokens", "texts"])

    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return tuple(texts.mapInArrow(run, "tokens long, texts long").agg(zero("tokens"), zero("texts")).first())


def deal_pairs(texts: DataFrame, segments: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        words, parts, size = Words(), [], 0
        for batch in batches:
            for tokens, lengths in tokens_of(each_text(batch.column(0))):
                ids, _ = words.numbers(tokens)
                keys = pair_key(contexts(ids, lengths, words.hashes), words.hashes[ids])
                parts.append(np.unique(keys, return_counts=True))
                size += len(parts[-1][0])
                if size >= GATHERED:
                    yield dealt(*added(parts), segments)
                    parts, size = [], 0
        if parts:
            yield dealt(*added(parts), segments)

    return texts.mapInArrow(run, DEALT)


def deal_words(counts: DataFrame, segments: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            if tokens:
                keys = word_key(np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens)))
                yield dealt(keys, batch.column(1).to_numpy(), segments)

    return counts.select("token", "c").mapInArrow(run, DEALT)


def parts_of(keys: list[bytes], counts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of ``dealt`` rows."""
    return [(from_planes(k, "<u8"), from_planes(c, "<u2" if len(c) * 4 == len(k) else "<u8")) for k, c in zip(keys, counts, strict=True)]


def build_filter(rows: DataFrame, tokens: int) -> DataFrame:
    """``segment, bits, raw, n``: the filter's segments from dealt n-grams, and how many different ones each holds."""

    def built(segment: int, keys: list, counts: list) -> pa.RecordBatch:
        every, sums = added(parts_of(keys, counts))
        bits, raw = build_segment(every, sums)
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip([segment, bits, raw, len(every)], BUILT.types, strict=True)], schema=BUILT)

    def run(batches: Batches) -> Batches:
        current, held = None, []
        for batch in batches:
            for segment, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != current and held:
                    yield built(current, *zip(*held, strict=True))
                    held = []
                current = segment
                held.append((keys, counts))
        if held:
            yield built(current, *zip(*held, strict=True))

    tasks = min(segments_of(tokens), max(tasks_of(rows.sparkSession), tokens >> 26))
    return saved(rows.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bits long, raw binary, n long"))


BUILT = pa.schema([("segment", pa.int32()), ("bits", pa.int64()), ("raw", pa.binary()), ("n", pa.int64())])


# --- slices of texts, where the filter is not broadcast ---------------------------------------------------------------


@dataclass
class Grams:
    """The tokens of a slice as numbers of its words, of which 0 is the start of a text."""

    words: list[bytes]
    hashes: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Grams:
        number, ids, lengths = {START: 0}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for tokens, own in tokens_of(texts):
            ids.append(np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens)))
            lengths.append(own)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        return cls(list(number), hashes, np.concatenate(ids), np.concatenate(lengths))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def pairs(self) -> np.ndarray:
        """Each token with the one before it, as one number."""
        before = np.r_[np.zeros(1, np.int64), self.ids[:-1]][: len(self.ids)]
        before[self.starts] = 0
        return before << 31 | self.ids

    def word_keys(self) -> np.ndarray:
        """Keys of all words but the start."""
        return word_key(self.hashes[1:])

    def pair_keys(self, pairs: np.ndarray) -> np.ndarray:
        return pair_key(self.hashes[pairs >> 31], self.hashes[pairs & 0x7FFFFFFF])


def packed(source: DataFrame) -> DataFrame:
    """``slice long, rows binary``: the rows in slices of at most SLICE_ROWS rows and about SLICE bytes of text, or one text that is
    longer, compressed. They are stored once, so every later step finds the same slices."""

    def blob(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

    def run(batches: Batches) -> Batches:
        held, rows, size = [], 0, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                end = min(at + SLICE_ROWS - rows, int(np.searchsorted(ends, before + SLICE - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, end - at))
                rows, size, at = rows + end - at, size + ends[end - 1] - before, end
                if rows >= SLICE_ROWS or size >= SLICE:
                    yield blob(held)
                    held, rows, size = [], 0, 0
        if held:
            yield blob(held)

    blobs = source.select("doc_id", "learn", "text").mapInArrow(run, "rows binary")
    return stored(blobs.select(F.monotonically_increasing_id().alias("slice"), "rows"))


def unpacked(raw: bytes) -> list[pa.Array]:
    """``doc_id, learn, text`` of a slice."""
    rows = pa.ipc.open_stream(raw).read_all().combine_chunks()
    return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]


ASKED = "segment int, slice long, keys binary, words binary, counts binary"


def deal_slice(number: int, raw: bytes, segments: int) -> pa.RecordBatch:
    """A slice's n-grams and their counts in its training texts: for each segment a row with the keys of pairs and one with words,
    in order of their keys, line by line, where END is an empty line."""
    _, learn, texts = unpacked(raw)
    grams = Grams.of(texts_of(texts))
    learnt = np.repeat(np.array(learn.to_pylist(), np.int64), grams.lengths)
    ordered = np.sort(grams.pairs() << 1 | learnt)
    first = np.flatnonzero(np.r_[True, ordered[1:] >> 1 != ordered[:-1] >> 1])
    pairs = dealt(grams.pair_keys(ordered[first] >> 1), np.add.reduceat(ordered & 1, first), segments)
    keys = grams.word_keys()
    order = np.argsort(keys, kind="stable")
    every = [b"" if (w := grams.words[i]) == END else w for i in (order + 1).tolist()]
    words = dealt(keys, np.bincount(grams.ids, learnt, len(grams.words))[1:].astype(np.int64), segments)
    lines = pa.array([b"\n".join(every[p]) for p in cut(keys[order], segments)[1]], pa.binary())
    n = pairs.num_rows + words.num_rows
    none = lambda x: pa.nulls(x.num_rows, pa.binary())
    columns = [(pairs.column(0), words.column(0)), (pairs.column("keys"), none(words)), (none(pairs), lines), (pairs.column("counts"), words.column("counts"))]
    segment, *rest = (pa.concat_arrays(c) for c in columns)
    return pa.RecordBatch.from_arrays([segment, pa.array(np.full(n, number), pa.int64()), *rest], ["segment", "slice", "keys", "words", "counts"])


ANSWER = pa.schema([("segment", pa.int32()), ("slice", pa.int64()), ("levels", pa.binary()), ("exact", pa.binary()), ("n", pa.int64()), ("counts", pa.list_(pa.struct([("level", pa.int32()), ("c", pa.int64()), ("n", pa.int64())])))])
ANSWER_SQL = "segment int, slice long, levels binary, exact binary, n long, counts array<struct<level: int, c: long, n: long>>"


def answer(asked: pa.Table) -> pa.Table:
    """A segment's levels for the n-grams that slices have sent, and the exact counts of words, which are told apart by their bytes. In
    one of the rows stand n, the number of n-grams that the segment holds, and its words' counts of counts by level."""
    keys, words, counts = (asked.column(c).to_pylist() for c in ("keys", "words", "counts"))
    lists = [None if w is None else w.split(b"\n") for w in words]
    numbers = [from_planes(c, "<u2" if len(c) == 2 * (len(k) // 8 if w is None else len(w)) else "<u8").astype(np.int64) for k, w, c in zip(keys, lists, counts, strict=True)]
    asks = [i for i, w in enumerate(lists) if w is not None]
    coded = pa.array([END if t == b"" else t for i in asks for t in lists[i]], pa.binary()).dictionary_encode()
    at, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    exact = np.bincount(at, np.concatenate([numbers[i] for i in asks]) if asks else None, len(different)).astype(np.int64)
    own = word_key(np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different)))
    parts = {i: from_planes(k, "<u8") for i, k in enumerate(keys) if k is not None}
    every, sums = added([(own, exact), *((k, numbers[i]) for i, k in parts.items())])
    held = sums > 0
    levels = probe_one(every, *build_segment(every[held], sums[held])).astype(np.uint8)
    found, said = [None] * len(keys), [None] * len(keys)
    for i, k in parts.items():
        found[i] = levels[np.searchsorted(every, k)].tobytes()
    level_of_word, begin = levels[np.searchsorted(every, own)], 0
    for i in asks:
        here = at[begin : begin + len(lists[i])]
        begin += len(here)
        c = exact[here]
        found[i], said[i] = level_of_word[here].tobytes(), planes(c.astype("<u2" if c.max() < 1 << 16 else "<u8"))
    c = exact[exact > 0]
    of, back = np.unique(count_level(c), return_inverse=True)
    histogram = [{"level": int(x), "c": int(s), "n": int(n)} for x, s, n in zip(of, np.bincount(back, c), np.bincount(back), strict=True)]
    more = [None] * (len(keys) - 1)
    columns = [asked.column("segment"), asked.column("slice"), found, said, [int(held.sum()), *more], [histogram, *more]]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, ANSWER, strict=True)], schema=ANSWER)


def sliced(source: DataFrame, tokens: int) -> tuple[DataFrame, DataFrame]:
    """The texts in slices (``packed``), and the levels of each slice's n-grams with its words' exact counts."""
    segments, slices = segments_of(tokens), packed(source)

    def ask(batches: Batches) -> Batches:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield deal_slice(number, raw.as_py(), segments)

    return slices, stored(slices.mapInArrow(ask, ASKED).groupBy("segment").applyInArrow(answer, ANSWER_SQL))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_by_slices(slices: DataFrame, answers: DataFrame, shared) -> DataFrame:
    """Rows of RESULT. ``shared`` is the broadcast model."""

    def score(packed_rows: pa.Table, answered: pa.Table) -> pa.Table:
        model = shared.value
        doc_id, learn, texts = unpacked(packed_rows.column("rows")[0].as_py())
        grams = Grams.of(texts_of(texts))
        pairs, back = np.unique(grams.pairs(), return_inverse=True)
        rows = sorted(zip(*(answered.column(c).to_pylist() for c in ("segment", "levels", "exact")), strict=True), key=lambda r: r[0])

        def middles(keys: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            order, out = np.argsort(keys, kind="stable"), np.zeros(len(keys))
            out[order] = MIDDLE[np.frombuffer(b"".join(raw), np.uint8)]
            return out, order

        together, _ = middles(grams.pair_keys(pairs), [found for _, found, c in rows if c is None])
        middle, order = middles(grams.word_keys(), [found for _, found, c in rows if c is not None])
        exact = np.zeros(len(grams.words), np.int64)
        exact[order + 1] = np.concatenate([from_planes(c, f"<u{len(c) // len(found)}") for _, found, c in rows if c is not None])
        one = np.r_[0.0, middle]
        before = np.r_[0.0, one[grams.ids[:-1]]][: len(grams.ids)]
        before[grams.starts] = model.texts
        scores = np.add.reduceat(model.log10(one[grams.ids], before, together[back]), grams.starts)
        counts = exact[grams.ids]
        base = np.add.reduceat(np.log10(counts + 1.0) - math.log10(model.total + model.distinct + 1), grams.starts)
        known = np.add.reduceat((counts > 0).astype(np.int64), grams.starts)
        held_out = pa.array([not x for x in learn.to_pylist()])
        total = pa.array(np.full(len(scores), model.total), pa.int64())
        return pa.table([doc_id, held_out, pa.array(grams.lengths, pa.int64()), pa.array(known), total, pa.array(base), pa.array(scores)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, RESULT)


def count_level(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log(c) / math.log(1.1)).astype(np.int64)


def solve_beta(histogram: list[tuple[float, int]], pairs: int) -> float:
    """beta with sum over words of c ** beta equal to the number of different pairs."""
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * c**middle for c, n in histogram) < pairs else (low, middle)
    return (low + high) / 2


@dataclass
class Model:
    filter: Filter | None
    total: int
    distinct: int
    beta: float
    top: dict[bytes, int]
    texts: int

    def log10(self, counts: np.ndarray, before: np.ndarray, together: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of words of the given counts after words of counts ``before``, with which they stand
        ``together`` so often."""
        p1 = (counts + 1) / (self.total + self.distinct + 1)
        after = before**self.beta * (before > 0)
        return np.log10(np.where(before > 0, (np.minimum(together, before) + after * p1) / np.maximum(before + after, 1e-300), p1))


def fit(source: DataFrame, max_bits: int = 1 << 29) -> tuple[Model, DataFrame | None, tuple[DataFrame, DataFrame] | None]:
    """The model of the rows (``doc_id, text_key, learn, text``) to learn from, and the exact counts of words (``token, c``) or, where
    the filter may be larger than ``max_bits``, all rows in slices with the levels of their n-grams and their words' counts."""
    texts = source.filter("learn").select("text")
    tokens, n_texts = count_tokens(texts)
    if 2 * BITS_PER_EVENT * tokens > max_bits:  # a token is a word and a pair, and a count has no more events than itself
        slices = sliced(source, tokens)
        held = slices[1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        each = slices[1].select(F.explode("counts").alias("r")).select("r.*")
        # counts of counts by level, at most a few hundred rows
        levels = each.groupBy("level").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
        distinct = sum(r.n for r in levels)
        return Model(None, tokens, distinct, solve_beta([(r.c / r.n, r.n) for r in levels], held - distinct), {}, n_texts), None, slices
    counts = saved(count_words(texts))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    segments = segments_of(sums.n)
    built = build_filter(deal_pairs(texts, segments).unionByName(deal_words(counts, segments)), sums.n)
    held = built.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    found = Filter.join([(r.segment, r.bits, bytes(r.raw)) for r in built.select("segment", "bits", "raw").collect()], segments)  # max_bits / 8 bytes at most
    level = F.floor(F.log("c") / math.log(1.1))
    levels = counts.groupBy(level.alias("level")).agg(F.avg("c").alias("c"), F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    histogram = [(r.c, r.n) for r in levels]
    # the levels of which all words together are at most TOP
    within = [r.least for r, n in zip(levels, np.cumsum([r.n for r in levels]), strict=True) if n <= TOP]
    frequent = counts.filter(F.col("c") >= within[-1]).collect() if within else []
    top = {bytes(r.token): r.c for r in frequent}
    return Model(found, sums.n, sums.v, solve_beta(histogram, held - sums.v), top, n_texts), counts, None


class Scorer:
    """Scores the texts of one task. ``filter`` gives the levels of n-grams."""

    def __init__(self, model: Model):
        self.model, self.filter, self.words = model, model.filter, Words()
        self.counts, self.exact = np.zeros(0), np.zeros(0, np.int64)

    def score(self, tokens: list[bytes], lengths: np.ndarray):
        """Per text: log10 probability; and per token its number and exact count (-1: not among the top)."""
        m = self.model
        ids, new = self.words.numbers(tokens)
        if len(self.words.hashes) == len(new):  # the words were numbered anew
            self.counts, self.exact = np.zeros(0), np.zeros(0, np.int64)
        hashes = self.words.hashes
        if new:
            self.counts = np.r_[self.counts, MIDDLE[self.filter.levels(word_key(hashes[len(hashes) - len(new) :]))]]
            self.exact = np.r_[self.exact, np.fromiter((m.top.get(t, -1) for t in new), np.int64, len(new))]
        keys, back = np.unique(pair_key(contexts(ids, lengths, hashes), hashes[ids]), return_inverse=True)
        together = MIDDLE[self.filter.levels(keys)][back]
        before = np.r_[0.0, self.counts[ids[:-1]]]
        starts = np.cumsum(lengths) - lengths
        before[starts] = m.texts
        return np.add.reduceat(m.log10(self.counts[ids], before, together), starts), ids, self.exact[ids]


SCORED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int32())])))])
SCORED_SQL = "doc_id long, text_key long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<token: binary, tf: int>>"


def scored_rows(model: Model, own: list[pa.Array], scores: np.ndarray, lengths: np.ndarray, ids: np.ndarray, exact: np.ndarray, words_at: Callable[[np.ndarray], list[bytes]]) -> pa.RecordBatch:
    """Rows of SCORED for texts with their id, key and whether they are learnt from; words without an exact count here (-1) are
    listed in ``rare``. ``ids`` number the tokens' words, and ``words_at`` gives the words at positions."""
    floor, starts = math.log10(model.total + model.distinct + 1), np.cumsum(lengths) - lengths
    in_top = exact >= 0
    base = np.add.reduceat(np.where(in_top, np.log10(np.maximum(exact, 0) + 1.0) - floor, 0.0), starts)
    known = np.add.reduceat(in_top.astype(np.int64), starts)
    rare_at = np.flatnonzero(~in_top)
    text_of = np.searchsorted(starts, rare_at, side="right") - 1
    each, first, times = np.unique(text_of << 31 | ids[rare_at], return_index=True, return_counts=True)
    words = pa.StructArray.from_arrays([pa.array(words_at(rare_at[first]), pa.binary()), pa.array(times, pa.int32())], fields=list(SCORED.field("rare").type.value_type))
    rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(each >> 31, np.arange(len(lengths) + 1)), pa.int32()), words)
    held = [not x for x in own[2].to_pylist()]
    columns = [own[0], own[1], pa.array(held), pa.array(lengths), pa.array(known), pa.array(base), pa.array(scores), rare.cast(SCORED.field("rare").type)]
    return pa.RecordBatch.from_arrays(columns, schema=SCORED)


def scored(scorer: Scorer, *columns: pa.Array) -> Batches:
    """Rows of SCORED for texts, with the broadcast filter."""
    at = 0
    for tokens, lengths in tokens_of(each_text(columns[3])):
        scores, ids, exact = scorer.score(tokens, lengths)
        own = [c[at : at + len(lengths)] for c in columns[:3]]
        yield scored_rows(scorer.model, own, scores, lengths, ids, exact, lambda where, tokens=tokens: [tokens[i] for i in where.tolist()])
        at += len(lengths)


OWN = "struct<held_out:boolean,n_tokens:bigint,known:bigint,base:double,score:double>"


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_bits: int = 1 << 29) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; the model learns from the
    rows of ``in_training``. A filter of more than ``max_bits`` is not broadcast; the scores are the same."""
    spark = docs.sparkSession
    text = F.col(text_column)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), in_training(id_column).alias("learn"), text.alias("text"))
    model, counts, slices = fit(source, max_bits)
    shared, state = spark.sparkContext.broadcast(model), {}

    def run(batches: Batches) -> Batches:
        scorer = state.get("scorer") or state.setdefault("scorer", Scorer(shared.value))
        for batch in batches:
            yield from scored(scorer, *batch.columns)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    if slices is not None:
        return score_by_slices(*slices, shared)
    rows = source.mapInArrow(run, SCORED_SQL)
    # One pass: a row for each text and one for each of its rare words meet the counts together. A text's own row has a key
    # that no word has, as words hold no white space.
    whole, own = float(model.total + model.distinct + 1), F.struct("held_out", "n_tokens", "known", "base", "score")
    mark = F.concat(F.lit(b"\t"), F.unhex(F.hex(F.xxhash64("doc_id", "text_key"))))
    first = F.array(F.struct(mark.alias("token"), F.lit(0).alias("tf"), own.alias("own")))
    rest = F.transform("rare", lambda r: F.struct(r["token"].alias("token"), r["tf"].alias("tf"), F.lit(None).cast(OWN).alias("own")))
    each = rows.select("doc_id", "text_key", F.explode(F.concat(first, rest)).alias("r")).select("doc_id", "text_key", "r.*").join(counts, "token", "left")
    count = F.coalesce("c", F.lit(0))
    more = F.when(F.col("own").isNull(), F.col("tf") * F.log10((count + 1) / F.lit(whole)))
    found = each.groupBy("doc_id", "text_key").agg(F.first("own", ignorenulls=True).alias("own"), F.count("own").alias("alike"), F.sum(more).alias("base"), F.sum(F.when(count > 0, F.col("tf")).otherwise(0)).alias("known"))
    # rows alike in id and text have been added up, and are given back each
    found = found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int"))))
    base = F.col("own.base") + F.coalesce(F.col("base") / F.col("alike"), F.lit(0.0))
    known = F.col("own.known") + (F.col("known") / F.col("alike")).cast("long")
    return found.select("doc_id", "own.held_out", "own.n_tokens", known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "own.score")
