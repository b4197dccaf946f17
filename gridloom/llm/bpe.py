"""BPE encoding and decoding with a published vocabulary, as batched numpy merge rounds.

A text is cut at white space into chunks; a merge never crosses a chunk, so each task encodes every
distinct chunk once and looks the others up. New chunks are cut into words by the vocabulary's pattern
and merged together: the symbols of all words lie in one flat array, each round finds the rank of every
neighbouring pair by binary search over the sorted pair keys, and merges each word's lowest-ranked pair
wherever it stands in that word. Words without a known pair leave the array.

The vocabulary (a fixed file of about 1 MB) is read on the driver and broadcast.

Cases: null text is the empty text (no ids); strings of special tokens inside a text become those tokens,
as in the tokenizers library; letters that Unicode added after that library's tables were made are classed by
the newer tables of the regex module; repeated rows give repeated rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import map_batches

#: Fixed values of the vocabulary's file format: its word pattern with Unicode's White_Space characters as
#: white space, and the printable stand-ins of the 256 byte values in byte-level BPE.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
SPACE_RUN = regex.compile(f"[{SPACES}]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

SHIFT = 20
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next code point from 256 on."""
    others = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(others)) for b in range(256)]


@dataclass
class Bpe:
    """Tables of one vocabulary, small enough to broadcast."""

    tokens: list[str]
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        pairs = [(vocab[a] << SHIFT | vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        keys = np.array([k for k, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        symbols = byte_symbols()
        return cls(tokens, np.array([vocab[c] for c in symbols], np.int32), np.array([vocab[c + suffix] for c in symbols], np.int32), keys[order], order.astype(np.int32), np.array([m for _, m in pairs], np.int32)[order], special)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (not empty), by merge rounds over all words at once."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.first[raw], np.repeat(np.arange(len(words)), lengths)
        sym[ends - 1] = self.last[raw[ends - 1]]
        done_sym, done_word = [], []
        while len(sym):
            left = np.flatnonzero(word[1:] == word[:-1])
            key = sym[left].astype(np.int64) << SHIFT | sym[left + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NO_RANK)
            rank[left] = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
            found = np.zeros(len(sym), np.int32)
            found[left] = at
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            live = lowest != NO_RANK
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, found, lowest = sym[live], word[live], rank[live], found[live], lowest[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == lowest)
            # in a run such as aaaa, whose pairs overlap, every second pair is merged, from the left
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.merged[found[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        all_sym, all_word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(all_word, kind="stable")
        return np.split(all_sym[order], np.cumsum(np.bincount(all_word, minlength=len(words)))[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens in order; the vocabulary names no decoder, and then the library joins tokens with spaces."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


class Encoder:
    """Encodes texts of one task. Keeps at most ``max_chunks`` encoded chunks."""

    def __init__(self, model: Bpe, max_chunks: int = 400_000):
        self.model, self.max_chunks, self.known = model, max_chunks, {"": b""}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None

    @staticmethod
    def words(chunk: str) -> list[bytes]:
        # lower() of a single character: a capital sigma becomes σ wherever it stands
        plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [w.encode() for w in WORDS.findall(plain)]

    def learn(self, chunks: set[str]) -> None:
        plan, words = [], []
        for chunk in chunks:
            parts = self.specials.split(chunk) if self.specials and "<" in chunk else [chunk]
            pieces = []
            for k, part in enumerate(parts):
                if k % 2:
                    pieces.append(self.model.special[part])
                else:
                    found = self.words(part)
                    pieces.append((len(words), len(words) + len(found)))
                    words += found
            plan.append((chunk, pieces))
        ids = [x.astype("<u4").tobytes() for x in self.model.encode_words(words)]
        for chunk, pieces in plan:
            self.known[chunk] = b"".join(b"".join(ids[p[0] : p[1]]) if isinstance(p, tuple) else p.to_bytes(4, "little") for p in pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [SPACE_RUN.split(t) if ODD_SPACE.search(t) else t.split() for t in texts]
        known = self.known
        new = {c for chunks in cut for c in chunks if c not in known}
        if len(known) + len(new) > self.max_chunks:
            self.known = known = {"": b""}
            new = {c for chunks in cut for c in chunks}
        self.learn(new)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


def slices(texts: list[str], most: int = 2_000_000):
    """Runs of texts with about ``most`` characters together, so that work arrays stay small."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves
    (``ids array<int>``) with the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(Bpe.load(vocabulary))
    state: dict[str, Encoder] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(shared.value))
        counts, id_hashes, text_hashes, kept, decoded = [], [], [], [], []
        for part in slices([t or "" for t in batch.column(1).to_pylist()]):
            for raw in encoder.encode(part):
                ids = np.frombuffer(raw, "<u4")
                text = encoder.model.decode(ids)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(raw).hexdigest())
                text_hashes.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
                    decoded.append(text)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return map_batches(source, run, schema).withColumnRenamed("id", id_column)
