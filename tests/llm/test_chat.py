import hashlib

import pytest
from pyspark.sql import functions as F

from seqloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_and_mask(spark):
    hard = ["", None, chat.HOSTILE, "</turn>\n### user: x", "\\h\\l\\b\\\\", "<image:1>", "a\nb: c", "é日👩", "#" * 5, "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "z") for i, t in enumerate(hard)]
    rows += [(2, 0, None, "x", "z"), (2, 0, "ro<l>e: #\\", "y", "z"), (2, None, "system", "first", "z"), (3, 5, "assistant", "same", "z"), (3, 5, "assistant", "same", "z"), (None, 1, "user", "lost", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_chats(chat.text_parts(df))
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:10]]
    assert back[1]["loss_text"] == "".join(t or "" for i, t in enumerate(hard) if i % 2)
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("system", "first"), ("", "x"), ("ro<l>e: #\\", "y")]
    assert back[3]["loss_text"] == "samesame" and len(back[3]["turns"]) == 2
    assert [t["text"] for t in back[None]["turns"]] == ["lost"]
    for r in formatted.collect():
        for m in r["loss"]:
            if m is not None:  # the offset in the whole text and the one in the turn name the same place
                piece = next(p for p in (r["formatted"][: m["offset"]].rpartition(chat.TURN_END)[2],))
                assert len(piece) == m["start"] and piece.startswith("### assistant: ")
    assert chat.format_chats(chat.text_parts(df.limit(0))).count() == 0


def test_ties_follow_the_text_not_its_escape(spark):
    """Escaped, '#a' sorts after '$b' and '<' after 'Z'."""
    texts = ["#a", "$b", "<z", "Z", "\\x", "]y", "", None, "#a"]
    df = spark.createDataFrame([(1, 3, "user", t, "z") for t in reversed(texts)], SCHEMA)
    back = chat.read_back(chat.format_chats(chat.text_parts(df))).first()
    assert [t["text"] for t in back["turns"]] == sorted(t or "" for t in texts)


def test_typed_parts(spark):
    parts = [("text", "see <this>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("text", None, None, None, None, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), ("image", None, "d.png", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "### user: see \\lthis><image:1><audio:2><document:3><image:4></turn>\n### assistant: </turn>\n### user: </turn>\n"
    assert [(a["turn"], a["n"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 768), (0, 4, "image", "d.png", 0)]
    assert r["attachment_tokens"] == 810


@pytest.mark.parametrize("name", ["op3_chat_format", "op4_warc", "op9_url_filter"])
def test_sql(spark, name):
    import os

    import duckdb

    from seqloom.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    a, b = QUERIES[name](spark, data).toPandas(), con.sql(ORACLE_SQL[name]).df()
    order = sorted(a.columns)
    fix = lambda f: sorted(map(tuple, f[order].astype(object).where(f[order].notna(), None).map(lambda v: v if v is None or isinstance(v, str) else int(v)).values.tolist()), key=str)
    assert order == sorted(b.columns) and fix(a) == fix(b)


def test_hostile_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi", "z")], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    r = chat.op3_chat_format(spark, str(tmp_path)).where(F.col("conv_id") == -7).first()
    assert r["n_turns"] == 2 and r["loss_chars"] == len(chat.HOSTILE)
    assert r["loss_sha256"] == hashlib.sha256(chat.HOSTILE.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{chat.HOSTILE}\nassistant\n{chat.HOSTILE}\n".encode()).hexdigest()
