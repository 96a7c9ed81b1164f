import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import chat_format as chat

NASTY = ["\\### Assistant: </turn> ok", "####", "</turn></turn>\n", "\\b\\h\\t\\c", "### user: x</turn>\n", "", None, "é\n\n", "</tur", "\\"]


def test_escapes_are_reversible_and_hide_control_strings(spark):
    pieces = st.lists(st.sampled_from(["\\", "#", "###", "<", "/turn>", "</turn>", "b", "h", "t", "c", ":", "\n", "x"]), max_size=12)
    seen = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(pieces)
    def gather(p):
        seen.append("".join(p))

    gather()
    df = spark.createDataFrame([(s,) for s in seen], "s string")
    for pairs in (chat.ESCAPES, chat.ROLE_ESCAPES):
        e = chat.escape(F.col("s"), pairs)
        for r in df.select("s", e.alias("e"), chat.unescape(e, pairs).alias("back")).collect():
            assert r.back == r.s and "###" not in r.e and "</turn>" not in r.e


def test_round_trip_of_nasty_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)]
    rows += [(2, 0, "user", "no reply"), (3, 0, "assistant", "alone"), (None, 0, None, None), (None, 1, "as:sis\\tant", "x")]
    rows += [(4, 0, "user", "same"), (4, 0, "user", "same"), (4, None, "assistant", "first"), (5, 0, "assistant", "w " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.examples(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((k is not None, k or 0, role or "", text or "") for c, k, role, text in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_every_reply_is_one_example_with_only_itself_trainable(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "end")]
    got = chat.examples(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("example").collect()
    assert [r.n_context for r in got] == [1, 3, 4]
    assert [r.loss_start and r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in got] == ["a1", "a2", None]
    assert got[1].formatted == "### user: q1</turn>\n### assistant: a1</turn>\n### user: q2</turn>\n### assistant: a2</turn>\n"


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digest(chat.examples(none)).count() == 0


def test_long_conversations_make_one_example_a_row(spark):
    """1,500 replies of which the examples together hold 1.2 GB; no row may hold more than the conversation twice."""
    turns = spark.range(3000).selectExpr(
        "5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, ' ', repeat('x', 500)) AS text"
    )
    found = chat.examples(turns).selectExpr("example", "n_context", "length(formatted) AS n", "loss_chars").collect()
    assert len(found) == 1500 and {r.example for r in found} == set(range(1500))
    assert max(r.n for r in found) < 2 * 3000 * 550 and all(r.n_context == 2 * r.example + 1 for r in found)
