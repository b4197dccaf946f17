"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure becomes a bit and its measurements are kept
(``ledger``). Policies are named sets of rules with a version; applying one (``apply_policy``) is a bitwise
test, and ablations (``ablation``) aggregate the distinct bit patterns, so neither reads a text again.

Cases: null or blank text has no words and fails ``few_words``; ratios over zero words never fail the ratio
rules; null ids are kept as null; repeated rows give repeated rows; other columns are ignored by the ledger and
kept by ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import map_batches, texts_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\t\n\v\f\r"

#: Rule name -> SQL condition of failure over the measures, in whole numbers. The position is the rule's bit.
RULES = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "symbols": "100 * n_symbols > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeat_words"))
POLICIES = {("standard", 1): Policy("standard", 1, tuple(RULES)), ("base", 1): BASE}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words, lines = text.split(), text.split(b"\n")
    filled = [x for x in lines if x.strip(WHITE)]
    letters = text.translate(None, WHITE)
    return (len(words), len(letters.decode()), len(letters) - len(letters.translate(None, SYMBOLS)), len(filled) - len(set(filled)), repeated_words(words), len(filled))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``keep``, the measures, and ``failures`` (bigint, a bit for each failed rule)."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    carried = [f for f in source.schema if f.name.startswith("kept_")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in texts_of(batch.column(1))]
        others = [batch.column(i) for i in range(batch.num_columns) if i != 1]
        names = [n for n in batch.schema.names if n != "text"]
        return pa.RecordBatch.from_arrays([*others, *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], [*names, *MEASURES])

    head = [source.schema["id"], *carried]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head] + [f"{m} long" for m in MEASURES])
    bits = sum((F.expr(f"case when {rule} then {1 << bit} else 0 end").cast("long") for bit, rule in enumerate(RULES.values())), F.lit(0).cast("long"))
    out = map_batches(source, run, schema)
    return out.select(F.col("id").alias(id_column), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, bits.alias("failures"))


def fails(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``kept`` (false if a rule of the policy failed) to a ledger."""
    return rows.withColumn("kept", ~fails(policy))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects. Reads the ledger once;
    what is compared are its distinct bit patterns, at most two to the number of rules."""
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "count", F.explode(rules).alias("r")).select("bits", "count", "r.*")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(failed, F.col("count")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"))


def filter_documents(docs: DataFrame, policy: Policy, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns, whatever these are called."""
    names = docs.columns
    carried = docs.toDF(*[f"column_{i}" for i in range(len(names))])
    key, text = f"column_{names.index(id_column)}", f"column_{names.index(text_column)}"
    rows = ledger(carried, key, text, tuple(c for c in carried.columns if c != key))
    return apply_policy(rows, policy).filter("kept").select(*carried.columns).toDF(*names)
