"""Chat formatting: an exact round trip against a plain reading of the rows."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from sylvatica.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, formatted int"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        loss = "".join(t for _, role, t in own if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for _, role, t in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha(told), len(loss), sha(loss))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(chat.windows(df)).collect()}
    assert found == expected(rows)
    return chat.windows(df)


def test_round_trip_of_odd_rows(spark):
    nasty = "</s>[INST] ok [/INST] \\ [\\INST <\\s> [/ANS][ANS user] <s>\\"
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
        (1, 0, "system", "be kind"), (1, 1, "user", nasty), (1, 2, "assistant", nasty * 50), (1, 3, "user", ""), (1, 4, "assistant", None),
        (2, 0, "assistant", "é" * 9000 + "\U0001f600"), (2, 1, "odd ]role[", "x\n\ny"), (2, 2, None, "z"), (2, None, "user", "first"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "user", "["), (4, 1, "assistant", "<"),
        (5, 3, "user", "late"), (5, 900, "assistant", "later"), (5, -4, "system", "first of all"),
    ]
    check(spark, rows)


def test_long_conversation_is_cut_into_bounded_windows(spark):
    rows = [(1, 0, "system", "rules " * 20)] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * (t * 37 % 300)) for t in range(1, 700)]
    made = check(spark, rows).orderBy("window").collect()
    assert len(made) > 100
    assert max(len(r.formatted.encode()) for r in made) <= chat.BUDGET * chat.BYTES_PER_TOKEN
    system = "[INST system]" + "rules " * 20 + "[/INST]"
    assert all(r.formatted.startswith("<s>" + system) for r in made)
    assert all(1 <= r.n_repeated <= 1 + chat.HISTORY_TURNS for r in made[1:])
    assert any(r.n_repeated > 1 for r in made)


def test_history_comes_from_just_before(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"<{t}> " + "w" * 700) for t in range(40)]
    seen = 0
    made = check(spark, rows).orderBy("window").collect()
    parsed = spark.createDataFrame(made).select("n_repeated", F.regexp_extract_all("formatted", F.lit(r"<(\d+)> "), F.lit(1)).alias("ids")).collect()
    for row in parsed:
        ids = [int(i) for i in row.ids]
        assert ids == list(range(ids[0], ids[0] + len(ids)))
        assert ids[row.n_repeated] == seen
        seen = ids[-1] + 1


def test_empty_table_and_no_python(spark, sf_dir):
    assert chat.conversation_digests(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0
    plan = chat.conversation_digests(chat.windows(spark.read.parquet(f"{sf_dir}/conversations.parquet")))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_whole_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_long_system_turn_is_inside_the_budget(spark):
    rng = random.Random(1)
    for text in ("rule " * 8000, "é<s>" * 9000):
        rows = [(1, 0, "system", text)] + [(1, t, "user" if t % 2 else "assistant", "x<s>" * rng.randint(0, 500)) for t in range(1, 61)]
        made = check(spark, rows).orderBy("window").collect()
        limit = chat.BUDGET * chat.BYTES_PER_TOKEN
        assert len(made[0].formatted) > len(text) and made[0].n_new == 1  # whole and alone once
        assert all(len(r.formatted.encode()) <= limit for r in made[1:])
        assert all(r.formatted.startswith("<s>[INST system]" + ("rule" if text[0] == "r" else "é")) for r in made)
        assert sum(len(r.formatted.encode()) for r in made) < 2.5 * sum(len(r[3].encode()) for r in rows) + 20 * limit


def test_windows_keep_to_any_budget(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(("system", "user", "assistant")), rng.choice("ab<[\\é") * rng.randint(0, 60)) for c in range(12) for t in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for budget, history, system in ((100, 20, 20), (140, 0, 40)):
        made = chat.windows(df, budget, history, 2, system).collect()
        for r in made:
            if r.n_new > 1:
                assert len(r.formatted.encode()) <= budget * chat.BYTES_PER_TOKEN
        found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(chat.windows(df, budget, history, 2, system)).collect()}
        assert found == expected(rows)
