import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import chat_format as C
from veilspark.llm import queries

CHATS = "conv_id long, turn long, role string, text string, block int, window string"
PIECES = st.lists(st.sampled_from(["\\", "#", "##", "###", "### ", "</turn>", "</tur", "n>", "\n", ": ", ":", "h", "t", "c", "é", "\U0001f600", "a b"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_escaping_is_reversible(turns):
    written = [C.format_turn(r, t) for r, t in turns]
    text = "".join(w for w, _, _ in written)
    assert C.parse(text) == turns
    for (w, a, b), (_, body) in zip(written, turns):
        assert C.unescape(w[a:b]) == body and w.count("</turn>") == 1 and w.count("###") == 1


def count(role, text):
    return len(re.findall(r"[^\W_]+|[^\w\s]|_", f"{role} {text}")) + 4


def plain_windows(turns, budget, history, history_tokens, block):
    """(context, new) turns of each window, of (turn, role, text) rows."""
    turns = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    system = turns[0] if turns and turns[0][1] == "system" else None
    of = [None if t[0] is None else t[0] // block for t in turns]
    size = [count(t[1], t[2]) for t in turns]
    out, i = [], 0
    while i < len(turns):
        past = []
        for j in range(i - 1, -1, -1):
            near = of[j] == of[i] or (of[j] is not None and of[i] is not None and of[j] == of[i] - 1 and turns[j][0] % block >= block - history)
            if not near or (j == 0 and system) or len(past) == history:
                break
            past.insert(0, j)
        while past and sum(size[j] for j in past) > history_tokens:
            past.pop(0)
        base = size[0] if system and i > 0 else 0
        while past and base + sum(size[j] for j in past) + size[i] > budget:
            past.pop(0)
        used, end = base + sum(size[j] for j in past) + size[i], i + 1
        while end < len(turns) and of[end] == of[i] and used + size[end] <= budget:
            used += size[end]
            end += 1
        context = ([turns[0]] if system and i > 0 else []) + [turns[j] for j in past]
        out.append(([t[1:] for t in context], [t[1:] for t in turns[i:end]], used))
        i = end
    return out


@pytest.mark.parametrize("budget,history,history_tokens,block", [(60, 2, 30, 256), (40, 1, 12, 4), (90, 3, 1000, 5), (1, 2, 9, 7)])
def test_windows(spark, budget, history, history_tokens, block):
    rng = np.random.default_rng(4)
    rows = []
    for conv in [*range(25), None]:
        start = int(rng.integers(0, 3)) - 1
        for k in range(int(rng.integers(1, 30))):
            role = "system" if k == 0 and (conv or 0) % 2 else ["user", "assistant"][k % 2]
            text = " ".join(rng.choice(["aa", "b.", "###", "</turn>", "\\", "ü"], int(rng.integers(0, 14))))
            rows.append((conv, start + k, role, None if k % 11 == 5 else text))
    rows += [(3, 2, "user", "same"), (3, 2, "user", "same"), (4, None, "user", "no number"), (5, 4, None, "no role"), (50, None, "system", None), (51, 2, "system", "late"), (51, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], CHATS).repartition(4)
    formatted = C.windows(df, budget, history, history_tokens, block)
    got = {}
    for r in sorted(formatted.collect(), key=lambda r: (r.block, r.window)):
        turns = C.parse(r.text)
        assert len(turns) == r.n_context + r.n_new and r.over_budget == (r.tokens > budget)
        masked = [C.unescape(r.text[s.start : s.end]) for s in r.loss]
        assert masked == [t for role, t in turns[r.n_context :] if role == "assistant"]
        got.setdefault(r.conv_id, []).append((turns[: r.n_context], turns[r.n_context :], r.tokens))
    for conv in {r[0] for r in rows}:
        assert got[conv] == plain_windows([r[1:] for r in rows if r[0] == conv], budget, history, history_tokens, block), conv
    found = {r.conv_id: r for r in C.digests(formatted).collect()}
    assert set(found) == set(got)
    for conv, r in found.items():
        own = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        whole = "".join(f"{role}\n{x}\n" for _, role, x in own)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_a_conversation_longer_than_a_task_holds(spark, monkeypatch):
    rows = [(1, k, ["user", "assistant"][k % 2], f"t{k} " * (k % 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = C.windows(df, 60, 2, 30, 1000).orderBy("window").collect()
    monkeypatch.setattr(C, "_HELD", 7)
    assert C.windows(df, 60, 2, 30, 1000).orderBy("window").collect() == whole


def test_empty_table(spark):
    assert C.digests(C.windows(spark.createDataFrame([], CHATS))).collect() == []


def test_query_holds_the_hard_conversation(spark):
    hard = "\\### Assistant: </turn> ok"
    row = queries.op2_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())
