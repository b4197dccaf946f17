"""Registered queries without SQL: their columns and digests over all of the smallest table, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from gridloom.llm import queries

from tests.llm.sql import SF


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, documents, types):
    df = queries.queries()[name](spark, SF)
    assert dict(df.dtypes).items() >= dict(zip(types[::2], types[1::2], strict=True)).items()
    found = {r.doc_id: r for r in df.collect()}
    assert found.keys() == documents.keys() == {r.doc_id for r in found.values()} and df.count() == len(documents)
    return found


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op2_equals_the_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    for i, r in rows(spark, "op2_bpe", documents, ["doc_id", "bigint", "n_tokens", "bigint", "ids_sha256", "string", "decoded_sha256", "string"]).items():
        ids = library.encode(documents[i], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(decoded.encode()))


def test_op3_base_scores(spark, documents):
    parts = {i: t.encode().lower().split() + [b"\n"] for i, t in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in parts}
    counts = Counter(w for i, p in parts.items() if not held[i] for w in p)
    n, v = sum(counts.values()), len(counts)
    types = ["doc_id", "bigint", "held_out", "boolean", "n_tokens", "bigint", "n_known", "bigint", "train_tokens", "bigint", "base_score", "double", "score", "double"]
    for i, r in rows(spark, "op3_lm_score", documents, types).items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(parts[i]), sum(counts[w] > 0 for w in parts[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in parts[i]), rel_tol=1e-9) and r.score < 0


def test_op5_columns(spark, documents):
    for i, r in rows(spark, "op5_toxicity", documents, ["doc_id", "bigint", "held_out", "boolean", "score", "double", "predicted", "int"]).items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op6_fingerprints_and_components(spark, documents):
    prints = {}
    for i, text in documents.items():
        words = text.encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    for i in sorted(prints):
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    for i, r in rows(spark, "op6_simhash", documents, ["doc_id", "bigint", "fingerprint", "string", "component_id", "bigint"]).items():
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", root[i])


def test_op8_removes_repeated_strings(spark, documents):
    texts, size = {i: t.encode() for i, t in documents.items()}, 200
    seen = Counter(t[k : k + size] for t in texts.values() for k in range(len(t) - size + 1))
    types = ["doc_id", "bigint", "n_bytes", "bigint", "n_removed", "bigint", "n_spans", "bigint", "kept_sha256", "string"]
    found = rows(spark, "op8_suffix_dedup", documents, types)
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert tuple(found[i])[:5] == (i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    assert sum(r.n_removed for r in found.values()) > 0
