r"""Chat formatting by token-level assembly.

A turn is `### role: text </turn>` and a line end. Roles and texts are escaped (a backslash before `###`, `</turn>`, `:` in roles, and before
each backslash), encoded on their own, and the marks between them are reserved ids that no text can yield. The loss mask
comes from prefix sums over the segments' lengths: it covers exactly the ids of assistant texts. What is returned is read back
from ids and mask alone.

A null text or role is empty. Turns are ordered by turn (null first), then role, text; repeated rows are turns of their own; rows without
conv_id form one conversation. A conversation streams through a task turn by turn, so none has to fit in memory. An empty table gives
an empty result. Other columns are not read. The tokenizer file is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import safe_text

#: Reserved ids, above the vocabulary's, and what they stand for in text.
FIRST_RESERVED = 60_000
TURN, ROLE_END, TURN_END = FIRST_RESERVED, FIRST_RESERVED + 1, FIRST_RESERVED + 2
MARKS = {TURN: "### ", ROLE_END: ": ", TURN_END: " </turn>\n"}
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@functools.lru_cache(2)
def _codec(path: str):
    """Encoder of many texts, and each id's bytes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # control strings of the vocabulary are ordinary text
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}
    table = {i: bytes(map(chars.__getitem__, s)) if set(s) <= chars.keys() else s.encode() for s, i in t.get_vocab(with_added_tokens=True).items()}
    if max(table) >= FIRST_RESERVED:
        raise ValueError(f"the tokenizer has ids from {FIRST_RESERVED} on, which are reserved here")
    return (lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]), table


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_turns(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, turn, ids (little-endian 32-bit), loss (a byte for each id) of each row."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = _codec(path)
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            n = len(roles)
            if not n:
                continue
            ids = encode([escape(r, True) for r in roles] + [escape(t) for t in texts])
            segments = [s for i in range(n) for s in ([TURN], ids[i], [ROLE_END], ids[n + i], [TURN_END])]
            ends = np.cumsum([len(s) for s in segments])  # prefix sums: where each segment ends in the batch
            flat = np.fromiter((x for s in segments for x in s), np.uint32, int(ends[-1]))
            edge = np.zeros(len(flat) + 1, np.int8)
            for i in (i for i in range(n) if roles[i] == LOSS_ROLE):
                edge[ends[5 * i + 2]] += 1
                edge[ends[5 * i + 3]] -= 1
            loss = np.cumsum(edge[:-1], dtype=np.int8).astype(np.uint8)
            cuts = [0, *ends[4::5].tolist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array([flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([loss[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["conv_id", "turn", "role", "text", "ids", "loss"],
            )

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), safe_text(F.col("role")).alias("role"), safe_text(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, loss binary")


def read_turn(ids: bytes, loss: bytes, table: dict[int, bytes]) -> tuple[str, str, str, int]:
    """Role, text, text under the loss mask, and how many characters the formatted turn has."""
    flat, mask = np.frombuffer(ids, np.uint32), np.frombuffer(loss, np.uint8).astype(bool)
    told = lambda x: b"".join(map(table.__getitem__, x.tolist())).decode()
    split = int(np.flatnonzero(flat == ROLE_END)[0])
    if flat[0] != TURN or flat[-1] != TURN_END:
        raise ValueError("not a turn")
    role, text = told(flat[1:split]), told(flat[split + 1 : -1])
    return unescape(role), unescape(text), unescape(told(flat[mask])), len(role) + len(text) + sum(map(len, MARKS.values()))


def read_conversations(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from ids and masks."""
    path = tokenizer or default_tokenizer()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = _codec(path)
        state, done = None, []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*done)) or [()] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for conv, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss"))):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learnt, chars = read_turn(ids, loss, table)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learnt)
                state[4].update(learnt.encode())
                state[5] += chars
            yield out()
        close()
        yield out()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "ids", "loss")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
