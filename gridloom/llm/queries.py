"""The thin registered queries of the operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, line_dedup, merkle, minhash, mixing, ngram_lm, quality, simhash, spelling, suffix_dedup, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


CHAT_PROBE = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", CHAT_PROBE), (-7, 1, "assistant", CHAT_PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(probe))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = quality.apply_policy(rows, quality.POLICIES["standard", 1])
    return rows.withColumn("base_failed", quality.fails(quality.BASE)).select("doc_id", *quality.MEASURES[:5], "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.documents_manifest(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), drop_every=97)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_bpe, op3_lm_score, op4_topk, op5_toxicity, op6_simhash, op7_chat_format, op8_suffix_dedup, op9_quality_rules, op10_mixing, op11_merkle, op12_minhash, op13_spelling]
    return {f.__name__: f for f in found}


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256e0 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v as q, v as c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select * from r where rank <= 5
"""

#: An escape is one more character: for each backslash, each # with two more behind it, and each </turn>. Names other than
#: the template's three are written with a prefix and escapes of their own.
OP7_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r as (
  select *, row_number() over w - 1 as k, count(*) over (partition by conv_id) as n, cast(first_value(role) over w = 'system' as int) as start,
    length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) as body,
    case role when 'system' then 6 when 'user' then 4 when 'assistant' then 9 else 5 + length(role) + len(regexp_extract_all(role, '[\\#<:]')) end as name
  from c window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + name + 2 + body + 9) as bigint) as formatted_chars,
  min(n - start) > 0 and min((n - start) % 2) = 0 and bool_and(k < start or role = case (k - start) % 2 when 0 then 'user' else 'assistant' end) as valid
from r group by conv_id
"""

#: Texts are hexadecimal digits here, two a byte; windows are told apart by their md5.
OP8_SQL = """
with d as (
  select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents
), c as (
  select rid, n, j, substr(h, 400 * j + 1, 800) as t from (select rid, n, h, unnest(range(0, n // 200 + 1)) as j from d where n >= 200)
), w as (
  select rid, 200 * j + o as k, md5(substr(t, 2 * o + 1, 400)) as m from (select rid, n, j, t, unnest(range(0, 200)) as o from c) where 200 * j + o <= n - 200
), r as (
  select rid, k from w where m in (select m from w group by m having count(*) > 1)
), i as (
  select rid, k, sum(fresh) over (partition by rid order by k) as g
  from (select rid, k, case when k > lag(k) over (partition by rid order by k) + 200 then 1 else 0 end as fresh from r)
), s as (
  select rid, min(k) as a, max(k) + 200 as b from i group by rid, g
), e as (
  select *, coalesce(lag(b) over (partition by rid order by a), 0) as last from s
), k as (
  select e.rid, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) as head, max(b) as b from e join d on d.rid = e.rid group by e.rid
)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) as kept_sha256
from d left join k on k.rid = d.rid
"""

OP9_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), l as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), t as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as tri
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)
), again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, tri) as n from t) where n >= 2
), r as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id
), m as (
  select w.doc_id, len(words) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from w left join l on w.doc_id = l.doc_id left join r on w.doc_id = r.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_dup_lines > 50 * n_lines or 100 * n_symbols > 30 * n_words
    or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from m
"""

OP10_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, [3e0, 1e0, 2e0][1 + (row_number() over (order by source is null, source) - 1) % 3] as w
  from d group by source
), a as (
  select *, source_size * 2e0 as lim, sum(source_size) over () * 1.5e0 as total from s
), b as (
  select *, coalesce(sum(lim) over o, 0e0) as spent, sum(w) over () - coalesce(sum(w) over o, 0e0) as rest_w
  from a window o as (order by lim / w, source is null, source rows between unbounded preceding and 1 preceding)
), c as (
  select *, (total - spent) / rest_w as lev from b
), e as (
  select source, source_size, case when lim <= lev * w then lim else (select min_by(lev, lim / w) from c where not lim <= lev * w) * w end as target from c
), p as (
  select doc_id, source, size, pass, md5('mix|' || pass || '|' || doc_id) as pick from d, (values (0), (1)) as v(pass) where size > 0
), f as (
  select p.*, sum(size) over (partition by source order by pass, pick, size) / target as vft from p join e using (source)
), g as (
  select doc_id, size, sum(size) over (order by vft, pick, size) as run from f
), k as (
  select doc_id, sum(size) as taken from g where run <= (select sum(size) * 1.5e0 from d) group by doc_id
)
select d.doc_id, d.size, e.source_size, e.target, cast(coalesce(k.taken, 0) as bigint) as taken
from d join e on d.source is not distinct from e.source left join k on d.doc_id = k.doc_id
"""


def crc_steps() -> str:
    """The 256 remainders of the usual reversed polynomial of crc32, as a list."""
    found = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        found.append(byte)
    return "[" + ", ".join(f"{b}::bigint" for b in found) + "]"


def crc_sql(codes: str) -> str:
    """crc32 of a list of byte values."""
    return f"xor(list_reduce([4294967295::bigint] || {codes}, lambda c, b: xor(({crc_steps()})[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint)"


DIGITS_SQL = "list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))"


def leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Steps of a proof are strings: the side of the other node and its digest, or N where there is none.
OP11_SQL = f"""
with recursive d as (
  select row_number() over () as rid, doc_id, lang, {leaf_sql("n_chars")} as leaf,
    case when {crc_sql(DIGITS_SQL)} % 7 = 0 then {leaf_sql("n_chars + 1")} end as tampered from documents
), l as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d
), a as (
  select 0 as lev, lang, i, n, leaf as h from l
  union all
  select lev + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from a where n > 1 group by lev, lang, i // 2, n
), t as (
  select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from a where n = 1
), b as (
  select 0 as lev, i, n, subroot as h from t
  union all
  select lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from b where n > 1 group by lev, i // 2, n
), p as (
  select l.rid, v.lev, l.i >> v.lev as i, s.h from l join (select distinct lang, lev from a where n > 1) as v on v.lang is not distinct from l.lang
    left join a as s on s.lang is not distinct from l.lang and s.lev = v.lev and s.i = xor(l.i >> v.lev, 1)
  union all
  select l.rid, 1000 + v.lev, t.i >> v.lev, s.h from l join t on t.lang is not distinct from l.lang join (select distinct lev from b where n > 1) as v on true
    left join b as s on s.lev = v.lev and s.i = xor(t.i >> v.lev, 1)
), q as (
  select rid, list(case when h is null then 'N' when i % 2 = 1 then 'L' || h else 'R' || h end order by lev) as steps, string_agg(h, '' order by lev) as digests from p group by rid
), f as (
  select l.doc_id, l.leaf, t.subroot, (select h from b where n = 1) as root, sha256(coalesce(digests, '')) as proof_sha256,
    list_reduce([coalesce(tampered, leaf)] || coalesce(steps, []), lambda c, s: sha256(case s[1] when 'L' then s[2:] || c when 'R' then c || s[2:] else c end)) as folded_root
  from l join t on t.lang is not distinct from l.lang left join q on q.rid = l.rid
)
select *, folded_root = root as verified from f
"""

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as words from documents
), s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) end) as shingle from w
), c as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s as a join s as b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join c as x on x.doc_id = a join c as y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)
), g as (
  select a, b from e union all select b, a from e
), r as (
  select doc_id, doc_id as other from documents
  union
  select g.b, r.other from r join g on g.a = r.doc_id
)
select w.doc_id, coalesce(c.n, 0) as n_shingles, m.component_id, w.doc_id = m.component_id as kept
from w left join c using (doc_id) join (select doc_id, min(other) as component_id from r group by 1) as m on m.doc_id = w.doc_id
"""

RUN_CODES = f"{DIGITS_SQL} || [58::bigint] || flatten(list_transform(string_split(run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))"
OP13_SQL = f"""
with recursive r as (
  select doc_id, run, count(*) as k from (select doc_id, unnest(regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) as run from documents) where length(run) >= 5 group by 1, 2
), h as (
  select run, k, {crc_sql(RUN_CODES)} as h from r
), c as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from h
), w as (
  select word, cast(sum(k) as bigint) as n from c where length(word) >= 5 group by word having sum(k) >= 3
), x as (
  select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail from (select word, n, unnest(range(1, length(word) + 1)) as i from w)
), v as (
  select a.word, b.word as near, b.n as near_n from x as a join x as b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union select x.word, w.word, w.n from x join w on w.word = head || tail
  union select w.word, x.word, x.n from x join w on w.word = head || tail
), m as (
  select word, count(*) as n_near, min_by(near, (-near_n, near)) as best, max(near_n) as best_n from v group by word
), f as (
  select w.word, n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from w left join m using (word)
), u as (
  select word, word as root from f where form is null
  union all
  select f.word, u.root from u join f on f.form = u.word
)
select f.word, form, root, n, n_near, form_n from f join u using (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op7_chat_format": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL, "op10_mixing": OP10_SQL, "op11_merkle": OP11_SQL, "op12_minhash": OP12_SQL, "op13_spelling": OP13_SQL}
