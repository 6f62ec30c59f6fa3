"""Token-exact trimming and masks against plain loops."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import conversations, token_turns

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id int, messages array<struct<role:string,content:string>>"
WORDS = ["hello", " the", "mug ", "[/INST]", " </s><s>", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", "é", "\U0001f600", "  ", "\n", "don't", "1234", "[INST]"]


def plain_render(messages, template):
    out = ""
    for i, (role, content) in enumerate(messages):
        stub = role == "assistant" and content is None
        if template == "llama3":
            out += f"<|start_header_id|>{role}<|end_header_id|>\n\n" + ("" if stub else f"{content}<|eot_id|>")
        elif role == "system":
            out += ("[INST] " if i == 0 else "") + f"<<SYS>>\n{content}\n<</SYS>>\n\n"
        elif role == "user":
            out += ("" if i == 1 else "[INST] ") + f"{content} [/INST]"
        else:
            out += "" if stub else f"{content} </s><s>"
    return out


def tokens(text):
    return token_turns.encoder(PATH).encode(text, add_special_tokens=False).ids


def plain_trim(messages, template, budget, keep=3, step=2, least=4):
    count = lambda m: 1 + len(tokens(plain_render([*m, ("assistant", None)], template)))
    n = count(messages)
    if n <= budget:
        return messages, n, n
    prefix, rest, before = messages[:keep], messages[keep:], n
    while n > budget and len(rest) > least:
        rest = rest[step:]
        n = count(prefix + rest)
    return prefix + rest, before, n


def talks(n=30, seed=3):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14)))
    made = []
    for i in range(n):
        start = [("system", text())] if i % 3 == 0 else []
        made.append((i, start + [(("user", "assistant")[k % 2], text()) for k in range(rng.randint(1, 16))]))
    return made


@pytest.mark.parametrize("template", ["llama2", "llama3"])
@pytest.mark.parametrize("step,least", [(2, 4), (1, 0), (2, 0)])
def test_trim_equals_the_loop(spark, template, step, least):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA)
    for budget in (40, 90, 10_000):
        got = token_turns.trim_pairs(df, template, budget, PATH, step=step, least=least).collect()
        for r in got:
            kept, before, after = plain_trim(dict(rows)[r.conv_id], template, budget, step=step, least=least)
            assert ([tuple(m) for m in r.messages], r.plan.before, r.plan.after) == (kept, before, after)
    assert token_turns.trim_singles(df, template, 40, PATH).count() == len(rows)
    with pytest.raises(ValueError):
        token_turns.trim_plan(df, template, 40, PATH, keep=1)


def plain_mask(messages, template):
    text, learnt = "", []
    for i, (role, content) in enumerate(messages):
        before = plain_render(messages[:i], template)
        piece = plain_render(messages[: i + 1], template)[len(before) :]
        head = len("<|start_header_id|>assistant<|end_header_id|>\n\n") if template == "llama3" else 0
        text += piece
        learnt += [role == "assistant" and k >= head for k in range(len(piece))]
    made = token_turns.encoder(PATH).encode(text, add_special_tokens=False)
    return made.ids, [t if learnt[o[0]] else -100 for t, o in zip(made.ids, made.offsets)]


@pytest.mark.parametrize("template", ["llama2", "llama3"])
def test_masks_equal_the_plain_rule(spark, template):
    rows = [(i, m if template == "llama2" or m[0][0] != "system" else m) for i, m in talks(40, 5)] + [(90, [("user", "x")]), (91, [("user", ""), ("assistant", "")])]
    got = token_turns.loss_mask(spark.createDataFrame(rows, SCHEMA), template, PATH).collect()
    for r in got:
        ids, labels = plain_mask(dict(rows)[r.conv_id], template)
        assert (r.ids, r.labels) == (ids, labels)
    fixed = token_turns.loss_mask(spark.createDataFrame(rows, SCHEMA), template, PATH, bos=7, length=20, pad=9).collect()
    for r, whole in zip(fixed, got):
        assert r.ids == ([7, *whole.ids] + [9] * 20)[:20] and r.labels == ([-100, *whole.labels] + [-100] * 20)[:20]


def test_replies_are_learnt_whole(spark):
    rows = [(1, [("user", "say [/INST] and </s><s>"), ("assistant", "yes [/INST] no"), ("user", "ok"), ("assistant", "bye")])]
    r = token_turns.loss_mask(spark.createDataFrame(rows, SCHEMA), "llama2", PATH).first()
    told = token_turns.encoder(PATH).decode([i for i, x in zip(r.ids, r.labels) if x != -100])
    # the first reply's last token also holds the bracket that follows it
    assert told == "yes [/INST] no </s><s>[bye </s><s>"


def test_counts(spark):
    rows = spark.createDataFrame([("a b",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [tuple(r) for r in rows.select(token_turns.token_count(F.col("t"), PATH, 1), token_turns.token_ids(F.col("t"), PATH)).collect()]
    assert got[0] == (3, tokens("a b")) and got[1] == (1, []) and got[2][1] is None and got[3][0] > 2


def test_pieces_are_the_prompt(spark):
    df = spark.createDataFrame(talks(), SCHEMA)
    for template in ("llama2", "llama3"):
        rows = df.select("conv_id", conversations.render(F.col("messages"), template).alias("p")).collect()
        assert {r.conv_id: r.p for r in rows} == {i: plain_render(m, template) for i, m in talks()}


def test_tokens_are_held_for_a_portion_of_texts(monkeypatch):
    monkeypatch.setattr(token_turns, "AT_ONCE_CHARS", 10)
    texts = ["abcdef", None, "ghi", "jkl", "m" * 50, "n"]
    assert list(token_turns.portions(pa.array(texts))) == [["abcdef", "", "ghi"], ["jkl"], ["m" * 50], ["n"]]
    assert list(token_turns.portions(pa.array([], pa.string()))) == []
