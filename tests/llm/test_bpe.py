import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from gridloom.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    None, "", "  \n\t ", "Hello, it's Don'T 'LL a'b", "ÀÉÎ õü ΣΑΣ ß İstanbul ǅ", "naïve e\u0301 \u0301x", "a" * 3000, "ab" * 2000 + "!!??", "1234 ½ ² Ⅷ ٣",
    "<|endoftext|>x<|startoftext|> y<|endoftext|>'s", "\x1c\x1d a\x1fb \x85 \u2003z\u3000", "emoji 👩‍👩‍👧 日本語 हिन्दी", "https://x.y/z?q=1&r=%20#a_b", "!!!...---", "<|endoftext|", "\ufeffbom \u200bz",
]


def test_documents_equal_the_library(spark, library):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choices("abcdefghi ,.!'0é\n", k=rng.randint(0, 300))) for _ in range(200)]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(None, "abc", 0, "y"), (3, TEXTS[3], 1, "z")]
    got = Counter(tuple(r) for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int, id string"), PATH).collect())
    want = Counter()
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want


def test_ids_are_kept_and_small_caches_change_nothing(spark, library):
    rows = bpe.encode_documents(spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string"), PATH, keep_ids=True).first()
    assert rows.ids == library.encode("the cat sat", add_special_tokens=False).ids and rows.decoded == library.decode(rows.ids)
    model = bpe.Bpe.load(PATH)
    texts = [t or "" for t in TEXTS]
    assert bpe.Encoder(model, max_chunks=3).encode(texts) == bpe.Encoder(model).encode(texts)


def test_empty(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
