import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat

KINDS = ("message", "delta", "edit", "regenerate", None)


def fold(events):
    """What a log means, step by step."""
    out = {}
    for conv in {e[0] for e in events}:
        log = sorted((e for e in events if e[0] == conv), key=lambda e: (e[1] is None, e[1] or 0, e[2] or "message", e[4] or "", e[5] or ""))
        made = []
        for _, seq, kind, turn, role, text in log:
            text, kind = text or "", kind or "message"
            mine = [m for m in made if m["turn"] == turn]
            if kind == "message" or not mine:
                made.append({"turn": turn, "seq": seq, "role": role, "text": text, "updated": seq})
            elif kind == "delta":
                mine[-1]["text"] += text
                mine[-1]["updated"] = seq
            else:
                mine[-1]["text"], mine[-1]["updated"] = text, seq
        resets = [(t, s) for _, s, k, t, _, _ in log if k in ("edit", "regenerate") and t is not None and s is not None]
        made = [m for m in made if not any((m["turn"] is None or t < m["turn"]) and m["updated"] is not None and m["updated"] <= s for t, s in resets)]
        made.sort(key=lambda m: (m["turn"] is None, m["turn"] or 0, m["seq"] is None, m["seq"] or 0))
        out[conv] = [(m["role"], m["text"]) for m in made]
    return out


def folded(spark, events):
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = chat.format_chats(df)
    rows = out.select("conv_id", "messages", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss"), "formatted").collect()
    return {r.conv_id: r for r in rows}


def test_log_of_edits(spark):
    events = [
        (1, 0, "message", 0, "user", "Hi"), (1, 1, "message", 1, "assistant", "He"), (1, 2, "delta", 1, "assistant", "llo"), (1, 3, "message", 2, "user", "Old"), (1, 4, "message", 3, "assistant", "old answer"),
        (1, 5, "regenerate", 1, "assistant", ""), (1, 6, "delta", 1, "assistant", "New"), (1, 7, "delta", 1, None, "er"), (1, 8, "message", 2, "user", "Next"),
        (2, 0, None, 0, "user", None), (2, 1, "message", None, None, "### x</turn>"), (None, 0, "message", 0, "a:\n\\", "\\### Assistant: </turn> ok"), (3, 0, "delta", 5, "assistant", "alone"),
    ]
    got = folded(spark, events)
    assert {k: [(m.role, m.text) for m in r.messages] for k, r in got.items()} == fold(events)
    assert [(m.role, m.text) for m in got[1].messages] == [("user", "Hi"), ("assistant", "Newer"), ("user", "Next")]
    for r in got.values():
        assert [(t.role, t.text) for t in r.turns] == [(m.role or "", m.text) for m in r.messages]
        assert r.loss == "".join(m.text for m in r.messages if m.role == "assistant")
    assert folded(spark, []) == {}


text = st.text(alphabet=st.sampled_from("\\#</turn>: \nAé"), max_size=20)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(KINDS), st.integers(0, 3), st.sampled_from(["user", "assistant", "a:b", None]), st.one_of(st.none(), text)), max_size=14))
def test_any_log(spark, log):
    events = [(c, i, k, t, r, x) for i, (c, k, t, r, x) in enumerate(log)]
    got = folded(spark, events)
    assert {k: [(m.role, m.text) for m in r.messages] for k, r in got.items()} == fold(events)
    for r in got.values():
        assert [(t.role, t.text) for t in r.turns] == [(m.role or "", m.text) for m in r.messages]
        assert r.loss == "".join(m.text for m in r.messages if m.role == "assistant")


def test_no_python_in_the_plan(spark, sf_dir):
    from corpusloom.llm.queries import op8_chat_formatting

    df = op8_chat_formatting(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    row = df.where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
