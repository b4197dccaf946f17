"""Removal of byte strings that occur more than once in the corpus, by suffix arrays of what may repeat.

A string of LENGTH bytes is repeated if it also starts anywhere else, in any text. Sorting all suffixes of a corpus in
one place is out of the question, so each text is first cut by anchors: of the GRAM-byte grams of a window of LENGTH
bytes, the one with the smallest hash (the leftmost of equals) is the window's anchor. Equal windows have equal anchors
at equal places, so only windows whose anchor's hash occurs again need to be compared. Neighbouring windows with the same
anchor form a stretch; stretches with equal bytes are copies of each other, and one of them stands for all.

Different stretches with equal anchors are brought together, one text per different stretch, and suffix-sorted in two
stages: suffixes smaller than their successor are sorted directly, all others are induced from them by scanning the
buckets of first bytes in order. Common prefixes of neighbours in the suffix array then tell which windows repeat. The
answers go back to the stretches' places, and every text drops the bytes that its repeated windows cover.

Hashes of 64 bits tell anchors and stretches apart.

Cases: null text is the empty text; texts shorter than LENGTH keep all bytes; rows alike in id and text are different
places (their windows repeat) and get the same result; a null id is an id like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import Batches, map_batches, null_as_empty, saved, small_or_shuffled, tasks_of, texts_of

LENGTH, GRAM = 200, 64
BATCH = 4_000_000
U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h = scramble((data.astype(np.uint64) + U(1)) * ODD[0])
    width, k = 1, 0
    while width < GRAM:
        h = h[:-width] * ODD[k] + (h[width:] ^ (h[width:] >> U(31)))
        width, k = 2 * width, k + 1
    return scramble(h)


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while 2 * width <= window:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = window - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(data: np.ndarray, ends: np.ndarray):
    """(text, first, count, anchor, content) of each stretch in texts that end at ``ends``: the text's number, the first
    window's start in the text, the number of windows, the anchor's hash and a hash of the stretch's bytes."""
    begins = np.r_[0, ends[:-1]]
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h = gram_hashes(data)
    low = sliding_min((h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(len(at) + 1, np.int64)
    fits = ends - begins >= LENGTH
    np.add.at(change, begins[fits], 1)
    np.add.at(change, ends[fits] - LENGTH + 1, -1)
    inside = np.cumsum(change[:-1]) > 0
    start = inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]]
    start[begins[fits]] = True
    first = np.flatnonzero(start)
    last = np.flatnonzero(inside & np.r_[start[1:] | ~inside[1:], True])
    anchor = at[first]
    text = np.searchsorted(ends, first, side="right")
    count = last - first + 1
    size = count + LENGTH - 1
    content = scramble(h[first] ^ (size.astype(np.uint64) << U(32)) ^ (anchor - first).astype(np.uint64) * ODD[1])
    for k in range(1, int(size.max(initial=0)) // GRAM + 1):
        more = size > k * GRAM
        place = np.minimum(first[more] + k * GRAM, first[more] + size[more] - GRAM)
        content[more] = scramble(content[more] * ODD[2] + h[place])
    return text, first - begins[text], count, h[anchor], content


def runs_of_texts(texts: list[bytes]):
    """Ranges of texts of about BATCH bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


# --- suffix arrays in two stages ----------------------------------------------------------------------------------


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it."""
    n = len(data)
    ends = np.flatnonzero(np.r_[data[1:] != data[:-1], True])
    rises = np.r_[data[ends[:-1]] < data[ends[:-1] + 1], False]
    return np.repeat(rises, np.diff(np.r_[-1, ends]))[:n]


def words_of(padded: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each position as one number, first byte highest."""
    w = np.zeros(n, np.uint64)
    for k in range(8):
        w = (w << U(8)) | padded[k : k + n]
    return w


def sort_directly(at: np.ndarray, words: np.ndarray, grams: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the ``depth`` bytes from each. Groups that agree so far are refined by eight bytes, or pass
    over GRAM bytes that all their members share."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(at)])
    done = np.full(len(start), 8)
    while True:
        live = (size > 1) & (done < depth)
        start, size, done = start[live], size[live], done[live]
        if not len(start):
            return at
        group = np.repeat(np.arange(len(start)), size)
        head = np.cumsum(size) - size
        place = np.arange(len(group)) - head[group] + start[group]
        here = at[place] + done[group]
        g = grams[here]
        alike = np.minimum.reduceat(g, head) == np.maximum.reduceat(g, head)
        rest = ~alike[group]
        new = []
        if rest.any():
            sub, sub_place = group[rest], place[rest]
            w = words[here[rest]]
            order = np.lexsort((w, sub))
            at[sub_place] = at[sub_place[order]]
            w = w[order]
            first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (sub[1:] != sub[:-1])])
            new = [(sub_place[first], np.diff(np.r_[first, len(sub)]), done[sub[first]] + 8)]
        new.append((start[alike], size[alike], done[alike] + GRAM))
        start, size, done = (np.concatenate(x) for x in zip(*new, strict=True))


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order of their first ``depth`` bytes at least, and the words of all positions."""
    n = len(data)
    padded = np.r_[data, np.zeros(depth + 2 * GRAM, np.uint8)]
    words, grams = words_of(padded, n + depth), gram_hashes(padded)
    rising = smaller_than_next(data)
    direct = sort_directly(np.flatnonzero(rising), words, grams, depth)
    cuts = np.searchsorted(data[direct].astype(np.int16), np.arange(257, dtype=np.int16))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[data[-1]].append(np.array([n - 1]))  # the last suffix has only the empty one after it
    out = []
    for c in range(256):
        layer = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        induced = []
        while len(layer):
            induced.append(layer)
            before = layer[layer > 0] - 1
            layer = before[data[before] == c]
        bucket = np.concatenate([*induced, direct[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > c]
        if not len(before):
            continue
        first = data[before]
        order = np.argsort(first, kind="stable")
        values, starts = np.unique(first[order], return_index=True)
        for v, part in zip(values.tolist(), np.split(before[order], starts[1:]), strict=True):
            pending[v].append(part)
    return np.concatenate(out), words


def repeated_starts(data: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Which of the candidate positions (a mask) begin a string of LENGTH bytes that begins at another of them too."""
    order, words = suffix_array(data)
    order = order[candidates[order]]
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(0, LENGTH, 8):  # the common prefix of neighbours, eight bytes at a time
        live = np.flatnonzero(same)
        same[live] = words[order[live] + k] == words[order[live + 1] + k]
    out = np.zeros(len(data), bool)
    out[order[:-1][same]] = True
    out[order[1:][same]] = True
    return out


# --- the corpus ---------------------------------------------------------------------------------------------------


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = null_as_empty(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(id_column), text).alias("key"), text.alias("text"))


def place_rows(texts: DataFrame) -> DataFrame:
    """``key, first, n, content`` of every stretch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), texts_of(batch.column(1))
            for a, b in runs_of_texts(texts):
                text, first, count, _, content = stretches(np.frombuffer(b"".join(texts[a:b]), np.uint8), np.cumsum([len(t) for t in texts[a:b]]))
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a + text]), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(content.view(np.int64))], ["key", "first", "n", "content"])

    return texts.select("key", "text").mapInArrow(run, "key long, first int, n int, content long")


SEGMENTS = 1024


def repeats(texts: DataFrame) -> DataFrame:
    """``content, anchor, copies, compare`` of the stretches whose anchor occurs again: whether the stretch itself occurs
    again, and whether there are other stretches with the anchor. Tasks deal hashes out by segments of anchors."""

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in runs_of_texts(texts):
                _, _, _, anchor, content = stretches(np.frombuffer(b"".join(texts[a:b]), np.uint8), np.cumsum([len(t) for t in texts[a:b]]))
                if len(anchor):
                    order = np.argsort(anchor)
                    anchor, content = anchor[order], content[order]
                    segment = (anchor >> U(54)).astype(np.int32)
                    cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
                    parts = [[p.tobytes() for p in np.split(x, cuts[1:])] for x in (anchor, content)]
                    yield pa.RecordBatch.from_arrays([pa.array(segment[cuts]), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], ["segment", "anchors", "contents"])

    def count(batches: Batches) -> Batches:
        parts: dict[int, list] = {}
        for batch in batches:
            for segment, anchors, contents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(segment, []).append((anchors, contents))
        for segment in list(parts):
            anchor, content = (np.frombuffer(b"".join(x), np.uint64) for x in zip(*parts.pop(segment), strict=True))
            order = np.lexsort((content, anchor))
            anchor, content = anchor[order], content[order]
            new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
            first = np.flatnonzero(new_anchor | np.r_[True, content[1:] != content[:-1]])
            times = np.diff(np.r_[first, len(anchor)])
            group = np.cumsum(new_anchor)[first] - 1
            several = np.bincount(group)[group] > 1
            keep = several | (times > 1)
            yield pa.RecordBatch.from_arrays([pa.array(content[first][keep].view(np.int64)), pa.array(anchor[first][keep].view(np.int64)), pa.array(times[keep] > 1), pa.array(several[keep])], ["content", "anchor", "copies", "compare"])

    dealt = texts.select("text").mapInArrow(deal, "segment int, anchors binary, contents binary")
    tasks = min(SEGMENTS, tasks_of(texts.sparkSession))
    return dealt.repartition(tasks, "segment").mapInArrow(count, "content long, anchor long, copies boolean, compare boolean")


def stretch_texts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes of the stretches to compare, those with copies once per task: ``anchor, content, key, first, n, copies,
    bytes``."""

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for key, raw, found in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in found:
                    if not (p["copies"] and p["content"] in seen):
                        seen.add(p["content"])
                        rows.append((p["anchor"], p["content"], key, p["first"], p["n"], p["copies"], raw[p["first"] : p["first"] + p["n"] + LENGTH - 1]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "content", "key", "first", "n", "copies", "bytes"])

    wanted = places.filter(F.size("compare") > 0).select("key", "compare")
    return texts.select("key", "text").join(wanted, "key").mapInArrow(run, "anchor long, content long, key long, first int, n int, copies boolean, bytes binary")


def compare(stretch_rows: DataFrame) -> DataFrame:
    """``key, first, n``: runs of repeated windows in the stretches that have no copy."""

    def solve(rows: list[tuple]):
        distinct = {}
        for r in rows:
            distinct.setdefault(r[1] if r[5] else (r[2], r[3]), r)
        rows = list(distinct.values())
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        ends = np.cumsum([len(r[6]) for r in rows])
        counts = np.array([r[4] for r in rows])
        begins = np.r_[0, ends[:-1]]
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, begins, 1)
        np.add.at(change, begins + counts, -1)
        hit = repeated_starts(data, np.cumsum(change[:-1]) > 0)
        edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
        lo, hi = edges[::2], edges[1::2]
        owner = np.searchsorted(ends, lo, side="right")
        single = ~np.array([r[5] for r in rows])[owner]
        lo, hi, owner = lo[single], hi[single], owner[single]
        if len(lo):
            keys, firsts = np.array([r[2] for r in rows])[owner], np.array([r[3] for r in rows])[owner]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array((firsts + lo - begins[owner]).astype(np.int32)), pa.array((hi - lo).astype(np.int32))], ["key", "first", "n"])

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and r[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield from solve(held)

    rows = stretch_rows.repartition(tasks_of(stretch_rows.sparkSession), "anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "key long, first int, n int")


#: A run of windows as one number: start, then how many.
RUN_BITS = 32
#: So many runs of all texts together are broadcast to the scan of the texts; beyond, texts are shuffled to them.
SMALL = 2_000_000


def packed_run() -> Column:
    return F.shiftleft(F.col("first").cast("long"), RUN_BITS) + F.col("n")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """``key, runs``: for every text with repeated windows, the runs of their starts."""
    hits = place_rows(texts).join(repeats(texts), "content")
    to_compare = F.when(F.col("compare"), F.struct("first", "n", "content", "anchor", "copies"))
    places = saved(hits.groupBy("key").agg(F.collect_list(F.when(F.col("copies"), packed_run())).alias("own"), F.collect_list(to_compare).alias("compare")))
    compared = compare(stretch_texts(texts, places)).groupBy("key").agg(F.collect_list(packed_run()).alias("more"))
    none = F.array().cast("array<bigint>")
    rows = places.select("key", "own").join(compared, "key", "left").select("key", F.concat("own", F.coalesce("more", none)).alias("runs"))
    return saved(map_batches(rows.filter(F.size("runs") > 0), joined_runs, "key long, runs array<bigint>").withColumn("n_runs", F.size("runs")))


def joined_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs that touch or overlap become one."""
    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((flat, row))
    row, runs = row[order], flat[order]
    begin = runs >> RUN_BITS
    # ends are made to rise from row to row, so that one running maximum serves all rows
    shift = row * (1 << 40)
    reach = np.maximum.accumulate(begin + (runs & ((1 << RUN_BITS) - 1)) + shift)
    new = np.r_[True, (row[1:] != row[:-1]) | (begin[1:] + shift[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(runs) - 1]
    out = begin[first] << RUN_BITS | (reach[last] - shift[last] - begin[first])
    offsets = np.searchsorted(row[first], np.arange(len(lengths) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))], ["key", "runs"])


def kept_bytes(raw: bytes, runs: np.ndarray) -> tuple[bytes, int]:
    """The bytes that no repeated window covers, and the number of removed runs of bytes."""
    runs = np.sort(runs)
    if not len(runs):
        return raw, 0
    begin = runs >> RUN_BITS
    end = begin + (runs & ((1 << RUN_BITS) - 1)) + LENGTH - 1
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    spans = list(zip(begin[first].tolist(), reach[np.r_[first[1:] - 1, len(runs) - 1]].tolist(), strict=True))
    return b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(raw)], strict=True)), len(spans)


def dedup_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and with ``keep_bytes`` what remains (``kept``;
    bytes, as a cut may fall inside a character)."""
    texts = keyed(docs, id_column, text_column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        lengths = np.asarray(pa.compute.fill_null(batch.column(2).value_lengths(), 0))
        ends = np.cumsum(lengths)
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        for raw, a, b in zip(texts_of(batch.column(1)), (ends - lengths).tolist(), ends.tolist(), strict=True):
            kept, n = kept_bytes(raw, flat[a:b])
            out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = texts.join(small_or_shuffled(repeated_runs(texts), SMALL, "n_runs"), "key", "left").select("doc_id", "text", "runs")
    out = map_batches(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")
