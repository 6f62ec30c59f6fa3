"""Conversations measured in a tokenizer's tokens: lengths, trimming to a budget, loss masks.

The tokens of a prompt are not the sum of its turns' tokens, so counts are of whole rendered prompts. Tokenizers are files
of the ``tokenizers`` library; each Python worker loads a file once. Work is in Arrow batches, a conversation at a time.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conversations import IGNORE, pieces, reply_start

#: Prompts of one conversation that are encoded together while a cut is looked for.
AT_ONCE = 4
#: Characters of texts that are encoded together: an encoding takes some hundred bytes a token until it is dropped.
AT_ONCE_CHARS = 250_000


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a file; strings of its special tokens are ordinary text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_padding()
    made.no_truncation()
    return made


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts (null: empty) in lists of about ``AT_ONCE_CHARS`` characters, a longer text alone."""
    some: list[str] = []
    size = 0
    for scalar in texts:
        text = scalar.as_py() or ""
        if some and size + len(text) > AT_ONCE_CHARS:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def token_ids(text: Column, path: str) -> Column:
    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.int32())
        return pa.concat_arrays([pa.array([], kind), *(pa.array([e.ids for e in encoder(path).encode_batch_fast(some, add_special_tokens=False)], kind) for some in portions(texts))])

    return F.when(text.isNotNull(), run(text))


def token_count(text: Column, path: str, extra: int = 0) -> Column:
    """The number of tokens, and ``extra`` for marks such as the one that begins a prompt.

    A worker holds the tokens of about ``AT_ONCE_CHARS`` characters at a time, whatever the batch.
    """

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        counts: list[int] = []
        for some in portions(texts):
            counts += [len(e) for e in encoder(path).encode_batch_fast(some, add_special_tokens=False)]
        return pa.array(counts, pa.int32())

    return F.when(text.isNotNull(), run(text) + extra)


def first_fit(head: list[str], rest: list[str], tail: str, budget: int, path: str, step: int, least: int, extra: int) -> tuple[int, int, int]:
    """(turns dropped from the front of ``rest``, tokens before, tokens after): as many steps as the budget asks.

    Nothing is dropped once ``rest`` has no more than ``least`` turns; a step drops what there is.
    """
    prefix = "".join(head)
    count = lambda cuts: [len(e.ids) + extra for e in encoder(path).encode_batch(["".join((prefix, *rest[c:], tail)) for c in cuts], add_special_tokens=False)]
    before = count([0])[0]
    if before <= budget:
        return 0, before, before
    # the cuts that the rule can come to, in its order; the last is taken whatever it holds
    cuts = list(itertools.takewhile(lambda c: c == 0 or len(rest) - (c - step) > least, range(0, len(rest) + step, step)))[1:]
    at, after = 0, before
    for i in range(0, len(cuts), AT_ONCE):
        for cut, n in zip(cuts[i : i + AT_ONCE], count(cuts[i : i + AT_ONCE])):
            at, after = min(cut, len(rest)), n
            if n <= budget:
                return at, before, after
    return at, before, after


def trim_plan(conversations: DataFrame, template: str, budget: int, path: str, *, messages: str = "messages", keep: int = 3, step: int = 2, least: int = 4, extra: int = 1) -> DataFrame:
    """``conversations`` with plan: struct<dropped, before, after>, counts of the prompt with an open reply at its end.

    The first ``keep`` messages stay; after them the oldest go, ``step`` at a time, until the prompt has at most
    ``budget`` tokens or no more than ``least`` are left.
    """
    if keep < 2:
        raise ValueError("a prompt's first two messages are rendered by their places, so they stay")
    stub = F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"))
    parts = pieces(F.concat(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), F.array(stub)), template)

    @F.arrow_udf("struct<dropped:int,before:int,after:int>")
    def run(rows: pa.Array) -> pa.Array:
        found = [first_fit(p[:-1][:keep], p[:-1][keep:], p[-1], budget, path, step, least, extra) for p in rows.to_pylist()]
        return pa.array([dict(zip(("dropped", "before", "after"), f)) for f in found], pa.struct([("dropped", pa.int32()), ("before", pa.int32()), ("after", pa.int32())]))

    return conversations.withColumn("plan", run(parts))


def trim_pairs(conversations: DataFrame, template: str, budget: int, path: str, **options) -> DataFrame:
    """trim_plan, and the messages without what it drops: pairs, four or more left at the end."""
    options = {"messages": "messages", "keep": 3} | options
    kept, keep = options["messages"], options["keep"]
    plan = trim_plan(conversations, template, budget, path, **options)
    left = F.concat(F.slice(kept, 1, keep), F.slice(kept, F.col("plan.dropped") + keep + 1, F.greatest(F.size(kept), F.lit(1))))
    return plan.withColumn(kept, F.when(F.col("plan.dropped") > 0, left).otherwise(F.col(kept)))


def trim_singles(conversations: DataFrame, template: str, budget: int, path: str, **options) -> DataFrame:
    """As trim_pairs, one message at a time, and the tail may empty."""
    return trim_pairs(conversations, template, budget, path, **{"step": 1, "least": 0} | options)


def masked(texts: list[str], starts: list[int | None], path: str, bos: int | None, length: int | None, pad: int) -> tuple[list[int], list[int]]:
    """(ids, labels) of a prompt of pieces; a piece with a start is learnt from there to its end.

    Token spans and learnt spans are both in order, so each token's span is the last that does not begin after it. A token is learnt
    if it begins inside a learnt span; one that begins before it is not.
    """
    made = encoder(path).encode("".join(texts), add_special_tokens=False)
    ends = np.cumsum([len(t) for t in texts])
    begin = np.array([e - len(t) + s for t, s, e in zip(texts, starts, ends) if s is not None], dtype=np.int64)
    end = np.array([e for s, e in zip(starts, ends) if s is not None], dtype=np.int64)
    ids = np.array(made.ids, dtype=np.int64)
    at = np.array([o[0] for o in made.offsets], dtype=np.int64).reshape(-1)
    span = np.searchsorted(begin, at, side="right") - 1
    learnt = (span >= 0) & (at < end[span]) if len(begin) else np.zeros(len(ids), dtype=bool)
    labels = np.where(learnt, ids, IGNORE)
    if bos is not None:
        ids, labels = np.r_[bos, ids], np.r_[IGNORE, labels]
    if length is not None:
        ids, labels = ids[:length], labels[:length]
        gap = length - len(ids)
        ids, labels = np.r_[ids, np.full(gap, pad, dtype=np.int64)], np.r_[labels, np.full(gap, IGNORE)]
    return ids.tolist(), labels.tolist()


def loss_mask(conversations: DataFrame, template: str, path: str, *, messages: str = "messages", bos: int | None = None, length: int | None = None, pad: int = 0) -> DataFrame:
    """``conversations`` with ids and labels: the assistants' replies with the marks that end them are learnt, all else is ignored.

    Replies are known by their places, so a turn may hold any of the template's marks. With ``length`` both are cut or padded to it.
    """
    parts = F.zip_with(pieces(F.col(messages), template), F.transform(messages, lambda m: reply_start(m["role"], template)), lambda t, s: F.struct(t.alias("text"), s.cast("int").alias("start")))

    @F.arrow_udf("struct<ids:array<int>,labels:array<int>>")
    def run(rows: pa.Array) -> pa.Array:
        found = [masked([p["text"] for p in r], [p["start"] for p in r], path, bos, length, pad) for r in rows.to_pylist()]
        return pa.array([{"ids": i, "labels": x} for i, x in found], pa.struct([("ids", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32()))]))

    made = conversations.withColumn("mask_", run(parts))
    return made.select(*(F.col(f"`{c}`") for c in conversations.columns), "mask_.ids", "mask_.labels")
