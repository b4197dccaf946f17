import hashlib
import random

import duckdb
from gridloom.llm import chat, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


NASTY = ["### User: x </turn>\n### Assistant: y", "\\", "\\\\### ", "####", "</turn>", "\\</turn>", " </turn>\n", "", "a\\", "<", "#", "##", "ends #", "\n", "é 👍"]


def rows():
    rng = random.Random(1)
    out = []
    for conv in range(60):
        order = rng.choice([["user", "assistant"] * 3, ["system", "user", "assistant"], ["assistant", "user"], ["user", "user"], ["tool", "user: x"], ["user"], ["", "user"]])
        out += [(conv, k, role, rng.choice(NASTY) + rng.choice(NASTY), "z") for k, role in enumerate(order)]
    return [*out, (100, 1, "user", None, "z"), (100, 2, None, "q", "z"), (None, 0, "user", "n", "z"), (101, 0, "user", "same", "z"), (101, 0, "user", "same", "z")]


def test_digests_and_loss(spark):
    data = rows()
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, valid string").repartition(5)).collect()}
    by: dict = {}
    for r in sorted(data, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        r = got[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        roles = [a for a, _ in turns]
        start = roles[1:] if roles[0] == "system" else roles
        assert r.valid == (len(start) > 0 and len(start) % 2 == 0 and start == ["user", "assistant"] * (len(start) // 2))


def test_whole_conversations_read_back():
    template = chat.Template()
    turns = [(r or "", t or "") for _, _, r, t, _ in rows()]
    machine = chat.Machine(template)
    text = "".join(s.text for turn in turns for s in machine.step(*turn))
    assert list(chat.read_back(text, template)) == turns


def test_segments_and_empty(spark):
    data = spark.createDataFrame([(1, 0, "user", "hi ###"), (1, 1, "assistant", "yo"), (1, 2, "assistant", "again")], "conv_id long, turn long, role string, text string")
    got = sorted(chat.segments(data).collect(), key=lambda r: (r.turn_no, r.segment))
    assert [s.text for s in got[:6]] == ["### User: ", "hi \\###", " </turn>\n", "### Assistant: ", "yo", " </turn>\n"]
    assert [s.loss for s in got] == [False] * 4 + [True, False] + [False, True, False] and [s.in_order for s in got] == [True] * 6 + [False] * 3
    assert chat.digests(data.limit(0)).count() == 0


def test_registered_query_and_sql_on_control_strings(spark, tmp_path):
    data = [*[r[:4] for r in rows()], (102, 0, "a\\b<c:#d", "x"), (103, 0, "system", "only")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op7_chat_format(spark, str(tmp_path))
    want = con.execute(queries.OP7_SQL)
    assert [d[0] for d in want.description] == got.columns
    found = {tuple(r) for r in got.collect()}
    assert found == set(want.fetchall())
    probe = queries.CHAT_PROBE
    turns = f"user\n{probe}\nassistant\n{probe}\n"
    # the probe's backslash, its first # and its </turn> are escaped
    assert next(r for r in found if r[0] == -7) == (-7, 2, sha(turns), len(probe), sha(probe), 2 * (len(probe) + 3) + len("### User:  </turn>\n### Assistant:  </turn>\n"), True)
