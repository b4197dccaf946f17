import hashlib
from zlib import crc32

import pytest
from gridloom.llm import merkle, queries
from pyspark.sql import functions as F

from tests.llm.sql import rows_of_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, more=0):
    n = None if row["n_chars"] is None else row["n_chars"] + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def brute_tree(digests, fan):
    """The root, and for each leaf its steps: place in its run, and the others of the run."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for proof, i in zip(proofs, at):
            run = level[i // fan * fan : i // fan * fan + fan]
            proof.append((i % fan, run[: i % fan] + run[i % fan + 1 :]))
        at = [i // fan for i in at]
        level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
    return level[0], proofs


def brute(rows, fan=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    trees = []
    for lang in sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        trees.append((own, *brute_tree([brute_leaf(r) for r in own], fan)))
    root, above = brute_tree([t[1] for t in trees], fan) if trees else (None, [])
    out = []
    for (own, subroot, proofs), rest in zip(trees, above):
        for row, proof in zip(own, proofs):
            drawn = row["doc_id"] is not None and crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = brute_leaf(row, 1 if drawn else 0)
            for pos, others in proof + rest:
                node = sha("".join(others[:pos]) + node + "".join(others[pos:]))
            digests = "".join("".join(others) for _, others in proof + rest)
            out.append((row["doc_id"], brute_leaf(row), subroot, root, sha(digests), node, node == root))
    return sorted(out, key=str)


def got(docs, **options):
    rows = merkle.documents_manifest(docs, **options)
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), "folded_root", F.expr("folded_root = root").alias("ok"))
    return sorted(map(tuple, rows.collect()), key=str)


def documents(n=150):
    rows = [{"doc_id": (i * 7919) % 1009, "text": f"text {i} é" * (i % 5), "lang": ["en", "de", None, "", "Ω"][i % 11 % 5], "source": f"s{i % 3}", "n_chars": i} for i in range(n)]
    rows += [{"doc_id": None, "text": None, "lang": "en", "source": None, "n_chars": None}] * 2  # repeated rows
    rows += [{"doc_id": 7, "text": t, "lang": "en", "source": "s", "n_chars": 1} for t in ("tie", "", "tie", "other")]
    rows += [{"doc_id": 77, "text": "long " * 50_000, "lang": "alone", "source": "s", "n_chars": None}]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)


@pytest.mark.parametrize(("fan", "levels"), [(2, 8), (2, 2), (3, 2)])
def test_manifest_equals_brute_force(spark, fan, levels):
    rows = documents()
    assert got(frame(spark, rows).repartition(3), fan=fan, levels=levels) == brute(rows, fan)


def test_tampering_shows(spark):
    found = merkle.documents_manifest(frame(spark, documents()))
    found = found.withColumn("ok", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")) == F.col("root"))
    counts = {(r.changed, r.ok): r.n for r in found.groupBy(F.expr("tampered <> leaf and tampered is not null").alias("changed"), "ok").agg(F.count("*").alias("n")).collect()}
    assert counts.keys() == {(True, False), (False, True)} and counts[True, False] > 5


def test_few_rows_empty_table_and_clashing_columns(spark):
    rows = documents(1)[:1]
    docs = frame(spark, rows)
    assert got(docs) == brute(rows) and got(docs)[0][2] == got(docs)[0][3] == brute_leaf(rows[0])
    clash = docs.withColumns({c: F.lit("x") for c in ("key", "rank", "n", "h", "body", "leaf", "d0", "block", "group", "kids")})
    assert got(clash) == brute(rows)
    assert got(docs.limit(0)) == []


def test_query_equals_sql(spark):
    assert rows_of_sql(spark, queries, "op11_merkle")
