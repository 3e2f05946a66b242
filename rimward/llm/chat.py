"""Chat formatting by token-level assembly.

A turn is rendered as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Role, newline and text are
encoded as segments of their own and the reserved ids of the two control strings are spliced in between,
so no text can ever encode to a control id. In texts a backslash is put into whatever looks like the
start of a control string (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), which is undone when reading.
Segment lengths are summed up to positions, and the loss mask covers the segments that are texts of
the assistant.

A conversation is streamed turn by turn from sorted rows; its output is cut between turns into rows of
at most about ``PART_TOKENS`` tokens, so memory stays bounded however long it is.

Defined cases: null role and text are empty; turns in order of turn, nulls first, repeated turns by
role and text; a null conv_id is a conversation; roles may hold anything (line ends are escaped); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.llm.packing import Encoder

START, END = "<|im_start|>", "<|im_end|>"
START_ID, END_ID = 50257, 50258
PART_TOKENS = 1 << 18

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


FORMATTED = "conv_id long, part int, ids binary, loss_mask binary"


def assemble(encoder: Encoder, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of some turns."""
    line = encoder.encode("\n")
    pieces: list[np.ndarray] = []
    flags: list[bool] = []
    for role, text in turns:
        for ids, flag in (
            (np.array([START_ID], "<u4"), False),
            (np.frombuffer(encoder.encode(escape_role(role)) + line, "<u2"), False),
            (np.frombuffer(encoder.encode(escape(text)), "<u2"), role == "assistant"),
            (np.array([END_ID], "<u4"), False),
            (np.frombuffer(line, "<u2"), False),
        ):
            pieces.append(ids)
            flags.append(flag)
    ends = np.cumsum([len(x) for x in pieces])
    steps = np.zeros(int(ends[-1]) + 1, dtype=np.int8)  # the mask is the running sum of +1 where a segment starts and -1 where it ends
    for end, ids, flag in zip(ends, pieces, flags, strict=True):
        if flag and len(ids):
            steps[end - len(ids)] += 1
            steps[end] -= 1
    return np.concatenate(pieces).astype("<u4"), np.cumsum(steps[:-1]).astype(np.uint8)


def _format(part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, part, turns, size, out = Encoder(), (), 0, [], 0, []

        def flush():
            if turns:
                ids, mask = assemble(encoder, turns)
                out.append((now, part, ids.tobytes(), mask.tobytes()))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "part", "ids", "loss_mask"])

        for batch in batches:
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now == () or conv_id != now or size > part_tokens:
                    flush()
                    part = part + 1 if conv_id == now else 0
                    now, turns, size = conv_id, [], 0
                turns.append((role or "", text or ""))
                size += len(text or "") // 2 + 4
            if len(out) > 2000:
                yield batch_of(out)
                out.clear()
        flush()
        if out:
            yield batch_of(out)

    return run


def format_conversations(turns: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(conv_id, part, ids, loss_mask): unsigned 32-bit little-endian ids and a byte for each, 1 where loss is taken."""
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(part_tokens), FORMATTED)


class Reader:
    """What one conversation's ids and mask say, part by part."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, vocabulary: list[bytes], ids: np.ndarray, mask: np.ndarray) -> None:
        starts, ends = np.flatnonzero(ids == START_ID), np.flatnonzero(ids == END_ID)
        outside = [vocabulary[i] for i in ids[(ids != START_ID) & (ids != END_ID)]]
        self.chars += len(b"".join(outside).decode()) + len(starts) * len(START) + len(ends) * len(END)
        for a, b in zip(starts, ends, strict=True):
            role, _, text = b"".join([vocabulary[i] for i in ids[a + 1 : b]]).decode().partition("\n")
            self.turns += 1
            self.sha.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            text = unescape(b"".join([vocabulary[i] for i in ids[a:b]]).decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.sha.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = [("conv_id", "long", pa.int64()), ("n_turns", "long", pa.int64()), ("turns_sha256", "string", pa.string()), ("loss_chars", "long", pa.int64()), ("loss_sha256", "string", pa.string()), ("formatted_chars", "long", pa.int64())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import base64

    import public_tokenizers

    vocabulary = [b""] * (END_ID + 1)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        for word, rank in map(bytes.split, lines):
            vocabulary[int(rank)] = base64.b64decode(word)
    now, reader, out = (), None, []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t[2]) for c, t in zip(zip(*rows, strict=True), READ, strict=True)], [t[0] for t in READ])

    for batch in batches:
        for conv_id, ids, mask in zip(batch["conv_id"].to_pylist(), batch["ids"], batch["loss_mask"], strict=True):
            if now == () or conv_id != now:
                if reader:
                    out.append((now, *reader.row()))
                now, reader = conv_id, Reader()
            reader.add(vocabulary, np.frombuffer(ids.as_py(), "<u4"), np.frombuffer(mask.as_py(), np.uint8))
        if len(out) > 5000:
            yield batch_of(out)
            out = []
    if reader:
        out.append((now, *reader.row()))
    if out:
        yield batch_of(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from ids and masks alone."""
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_read, ", ".join(f"{n} {t}" for n, t, _ in READ))
