import random

import pytest

from tidewatch.llm import chat
from tidewatch.llm.chat import Template

LOG = "conv bigint, message bigint, seq bigint, kind string, role string, text string"


def brute(events):
    """The final messages of one conversation, event by event."""
    seen, messages, order = set(), {}, []
    for e in sorted(events, key=lambda e: (e[2], e[1])):
        if e in seen:
            continue
        seen.add(e)
        _, m, seq, kind, role, text = e
        if m not in messages:
            messages[m] = [None, ""]
            order.append((seq, m))
        if role is not None:
            messages[m][0] = role
        messages[m][1] = (messages[m][1] if kind == "delta" else "") + (text or "")
    first = {m: s for s, m in order}
    again = [(first[m], seq) for _, m, seq, kind, _, _ in events if kind == "regenerate"]
    return [tuple(messages[m]) for s, m in order if not any(a < s < b for a, b in again)]


def test_fold_against_brute_force(spark):
    rng = random.Random(5)
    log = []
    for conv in range(40):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate"])
            role = rng.choice([None, "user", "assistant"]) if kind in ("open", "edit") else None
            log.append((conv, rng.randint(0, 6), seq, kind, role, rng.choice([None, "", "a", "b<", "\\"])))
    log += rng.sample(log, 60)  # delivered twice
    events = spark.createDataFrame(log, LOG).repartition(3)
    got = {}
    for r in chat.fold_events(events).orderBy("conv", "first").collect():
        got.setdefault(r.conv, []).append((r.role, r.text))
    for conv in range(40):
        assert got.get(conv, []) == brute([e for e in log if e[0] == conv]), conv


def test_texts_come_back(spark):
    t = Template()
    rng = random.Random(1)
    parts = [*t.controls, "\\", "<", "[", "a", "é😀", "\n", "|im_end|>", "SYS>>", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    log = [(i // 5, i, i, "open", rng.choice(["user", "assistant", "<s>", ""]), x) for i, x in enumerate(texts)]
    out = chat.render(chat.fold_events(spark.createDataFrame(log, LOG)))
    for r in chat.read_back(out).join(out.select("conv", "loss"), "conv").collect():
        own = [e for e in log if e[0] == r.conv]
        assert [(x.role, x.text) for x in r.turns] == [(e[4], e[5]) for e in own]
        assert r.trained == "".join(e[5] for e in own if e[4] == "assistant")
        escaped = [r.formatted[s["from"] : s["to"]] for s in r.loss]  # code points
        assert [x.count("<|im_end|>") for x in escaped] == [0] * len(escaped)
        assert r.formatted.count("<|im_start|>") == len(own) and not any(c in r.formatted for c in t.reserved)


def test_rows_as_a_log(spark):
    long = "wörd " * 30_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, None), (None, 3, "user", ""), (2, 0, "assistant", "x" * 256)]
    df = spark.createDataFrame(rows, "c bigint, t bigint, role string, text string")
    log = chat.log_of_rows(df, "c", "t", "role", "text")
    assert max(len(r.text or "") for r in log.collect()) == 256
    got = {r.conv: r for r in chat.read_back(chat.render(chat.fold_events(log))).collect()}
    assert [(x.role, x.text) for x in got[1].turns] == [("", ""), ("user", "hi"), ("assistant", "a"), ("assistant", "a"), ("assistant", long)]
    assert got[1].trained == "aa" + long and got[2].trained == "x" * 256 and [tuple(x) for x in got[None].turns] == [("user", "")]
    assert chat.render(chat.fold_events(chat.log_of_rows(df.limit(0), "c", "t", "role", "text"))).count() == 0


def test_unknown_kinds_and_other_columns(spark):
    log = spark.createDataFrame([(1, 1, 1, "open", "user", "a"), (1, 1, 2, "seen", None, "b"), (1, 2, 3, None, "user", "c")], LOG)
    got = chat.fold_events(log.selectExpr("*", "1 AS first", "2 AS again", "3 AS e", "4 AS until")).collect()
    assert [(r.role, r.text) for r in got] == [("user", "a")]


def test_only_spark(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi")], "c bigint, t bigint, role string, text string")
    plan = chat.read_back(chat.render(chat.fold_events(chat.log_of_rows(rows, "c", "t", "role", "text"))))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("change", [{"reserved": ("x",)}, {"reserved": ("a\\b",)}, {"reserved": ("<<|im_start|",)}])
def test_templates_that_cannot_be_read_back(change):
    with pytest.raises(ValueError):
        Template(**change)
