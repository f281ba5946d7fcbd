"""Vector bin packing of examples into sequences under several limits at once.

Each piece has a demand vector (tokens, one segment, loss-bearing tokens); a sequence has a capacity in each. The
dot-product heuristic opens one sequence at a time and takes, among the pieces that fit, the one whose demand has the
largest dot product with what is left, both as shares of the capacity. Pieces of equal demand form a class, so a step
looks at classes and not at pieces. Where examples may be cut, a piece that is longer than a sequence is cut into whole
sequences first, and a sequence that nothing fits any more is filled with the head of the largest waiting piece if at
least `min_cut` tokens are free.

Packing is local to a partition (nothing global): a partition holds at most `pool_tokens` waiting tokens, packs them, and
goes on, so that memory is bounded and at most a few sequences of each pool are not full. sequence_id is
partition * 2**33 + a count.

Plain documents (`pack_documents`) bear loss on every id but the first, so that tokens and loss run out together. Instruction
data (`pack_conversations`) bears loss on the ids of some roles alone: there the three limits bind on different sequences. A
conversation is one example as long as it fits a sequence; `TURNS` turns of one at most are an example, and a longer one is
cut, so that a conversation of a third of all rows is many examples in many partitions.

Rows: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed each by itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits
from .tokens import encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    min_cut: int = 16
    cut: bool = True


#: For instruction data: with a loss limit below the tokens and few segments, each limit ends some sequences.
INSTRUCTION = Limits(segments=16, loss=1024)
#: Turns of a conversation that are looked at together.
TURNS = 64


def pack(demands: list[tuple[int, int]], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in the item, length) for items of (tokens, loss-bearing tokens).

    With limits.cut the loss-bearing share of a cut item is taken as its own last `loss` tokens. An item without tokens
    is left out. Without limits.cut an item beyond a limit raises ValueError.
    """
    classes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    done: list[list[tuple[int, int, int]]] = []

    def put(item: int, start: int, size: int, loss: int) -> None:
        if size:
            classes.setdefault((size, loss), []).append((item, start))

    def head_loss(size: int, loss: int, head: int) -> int:
        return max(0, loss - (size - head))

    for item, (size, loss) in enumerate(demands):
        start = 0
        if not limits.cut and (size > limits.tokens or loss > limits.loss):
            raise ValueError(f"item {item} has {size} tokens, {loss} loss-bearing: beyond the limits")
        while size > limits.tokens or loss > limits.loss:
            head = min(size, limits.tokens)
            while head_loss(size, loss, head) > limits.loss:
                head -= head_loss(size, loss, head) - limits.loss
            if head == limits.tokens:
                done.append([(item, start, head)])
            else:
                put(item, start, head, head_loss(size, loss, head))
            start, size, loss = start + head, size - head, loss - head_loss(size, loss, head)
        put(item, start, size, loss)

    keys = sorted(classes)
    sizes, losses = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    left = np.array([len(classes[k]) for k in keys], np.int64)
    slot = {k: i for i, k in enumerate(keys)}

    def grow(key: tuple[int, int]) -> None:
        nonlocal sizes, losses, left
        if key in slot:
            left[slot[key]] += 1
            return
        slot[key] = len(sizes)
        sizes, losses, left = np.append(sizes, key[0]), np.append(losses, key[1]), np.append(left, 1)

    while left.any():
        free_t, free_s, free_l, members = limits.tokens, limits.segments, limits.loss, []
        while free_t and free_s:
            fits = np.flatnonzero((left > 0) & (sizes <= free_t) & (losses <= free_l))
            if len(fits):
                score = sizes[fits] / limits.tokens * (free_t / limits.tokens) + losses[fits] / limits.loss * (free_l / limits.loss) + free_s / limits.segments / limits.segments
                best = int(fits[score.argmax()])
                key, head = (int(sizes[best]), int(losses[best])), int(sizes[best])
            elif limits.cut and free_t >= limits.min_cut and (waiting := np.flatnonzero((left > 0) & (sizes > free_t))).size:
                best = int(waiting[sizes[waiting].argmax()])
                key, head = (int(sizes[best]), int(losses[best])), free_t
                if head_loss(*key, head) > free_l:
                    break
            else:
                break
            item, start = classes[key].pop()
            left[best] -= 1
            lost = head_loss(*key, head)
            members.append((item, start, head))
            free_t, free_s, free_l = free_t - head, free_s - 1, free_l - lost
            if head < key[0]:
                rest = (key[0] - head, key[1] - lost)
                put(item, start + head, *rest)
                grow(rest)
        done.append(members)
    return done


def _packed(examples: Iterator[tuple[tuple, bytes, int]], fields: list, limits: Limits, pool_tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows (the example's key, then start, length, ids_crc32, tokens, sequence_id, offset, loss and ids as far as `fields` has
    them) of examples (key, ids, loss-bearing tokens at their end)."""
    from pyspark import TaskContext

    number, pool, held = TaskContext.get().partitionId() << 33, [], 0

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(rows, fields, strict=True)], schema=pa.schema(fields))

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        rows: list[list] = [[] for _ in fields]
        for members in pack([(len(ids) // 4, loss) for _, ids, loss in pool], limits):
            offset = 0
            for item, start, length in members:
                key, data, _ = pool[item]
                part = data[4 * start : 4 * (start + length)]
                for column, value in zip(rows, (*key, start, length, zlib.crc32(part), len(data) // 4, number, offset, part), strict=False):
                    column.append(value)
                offset += length
            number += 1
            if len(rows[0]) >= 4096:
                yield batch(rows)
                rows = [[] for _ in fields]
        if rows[0]:
            yield batch(rows)
        pool.clear()

    for example in examples:
        pool.append(example)
        held += len(example[1]) // 4
        if held >= pool_tokens:
            yield from flush()
            held = 0
    if pool:
        yield from flush()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), pool_tokens: int = 6_000_000, with_ids: bool = True) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    A document is the ids of its text and `end_id`; every id but a document's first bears loss.
    """
    arrow_limits(docs.sparkSession)
    fields = [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        whole = (((key,), ids + end, len(ids) // 4) for batch in batches for key, ids in zip(batch.column(0).to_pylist(), enc.ids_of(batch.column(1).to_pylist()), strict=True))
        yield from _packed(whole, fields, limits, pool_tokens)

    schema = ", ".join(f"{name} {'binary' if name == 'ids' else 'long'}" for name, _ in fields)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = INSTRUCTION, answers: tuple[str, ...] = ("assistant",), pool_tokens: int = 6_000_000, with_ids: bool = True) -> DataFrame:
    """Pieces of sequences of examples: conv_id, first_turn, start, length, ids_crc32, example_tokens, sequence_id, offset and, if asked, ids.

    turns: conv_id, turn, role, text. An example is a run of turns of one conversation, in order of turn, text and role, each
    turn its ids and `end_id`; it ends with an answer where it can, so that its loss-bearing ids stand at its end. A prompt
    without an answer bears no loss. Runs are cut before they exceed the limits of a sequence; a single turn beyond them is an
    example of its own that is cut in pieces. A null turn comes first, null roles bear no loss, a null text is empty.
    """
    arrow_limits(turns.sparkSession)
    names = ("conv_id", "first_turn", "start", "length", "ids_crc32", "example_tokens", "sequence_id", "offset")
    fields = [(c, pa.int64()) for c in names] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def examples() -> Iterator[tuple[tuple, bytes, int]]:
            at, parts, size, loss, answered = None, [], 0, 0, False
            for batch in batches:
                conv, part, turn, role, text = (batch.column(k).to_pylist() for k in range(5))
                for c, p, t, r, ids in zip(conv, part, turn, role, enc.ids_of(text), strict=True):
                    ids, bears = ids + end, r in answers
                    n = len(ids) // 4
                    # a prompt after an answer begins a new example: only the answer at an example's end bears loss
                    full = parts and (at[:2] != (c, p) or answered and not bears or size + n > limits.tokens or loss + n * bears > limits.loss)
                    if full:
                        yield (at[0], at[2]), b"".join(parts), loss
                    if full or not parts:
                        at, parts, size, loss, answered = (c, p, t), [], 0, 0, False
                    parts.append(ids)
                    size, loss, answered = size + n, loss + n * bears, answered or bears
            if parts:
                yield (at[0], at[2]), b"".join(parts), loss

        yield from _packed(examples(), fields, limits, pool_tokens)

    key = [F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / TURNS).alias("part")]
    ordered = turns.select(*key, F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "text", "role")
    schema = ", ".join(f"{name} {'binary' if name == 'ids' else 'long'}" for name, _ in fields)
    return ordered.mapInArrow(run, schema)
