"""Mixture-controlled packing of token streams into windows of fixed length.

The documents of a source form its queue. Deficit round-robin serves the queues: at each window a
source's deficit grows by its target share of the window, the source then sends tokens up to its
deficit, and what it could not send stays in the deficit for later windows. Every window so holds the
target proportions, apart from pieces too short to be worth a cut (``min_piece``), and the windows
are gapless: only the last one of all is not full.

The work is cut into lots, each a stretch of about ``lot_tokens`` of the whole output. The fluid
schedule (source s has sent weight_s x V tokens at virtual time V) says in closed form where each
queue stands at the start of a lot, so each task knows its carried deficits, the global position and the
fill of the window it starts in, without the lots before it. A document is cut where a lot ends.

Order in a queue: input task, then order in it. Token ids are written once to a staged table; only
counts of (task, source) are gathered, one row a source reaches the driver.

Defined cases: a null text is empty and still gives its closing id; null doc_id and null source are
values like any other; repeated rows are packed each; an empty table gives no piece; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import stage

WINDOW = 2048
LOT_TOKENS = 1 << 20
MIN_PIECE = 64
CLOSE_ID = 1


#: Strings of special tokens of the vocabulary, with their ids.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Ids of the byte-level BPE, as little-endian unsigned 16-bit bytes.

    The string of a special token is that token, and what stands before and after it is encoded apart.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.to_numpy = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL).encode_to_numpy

    def encode(self, text: str) -> bytes:
        return self.to_numpy(text, allowed_special=set(SPECIAL), disallowed_special=()).astype("<u2").tobytes()


TOKENS = "doc_id long, source string, doc_tokens long, ids binary, lane int, lane_start long"


def _tokenise(close_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, lane, sent = Encoder(), TaskContext.get().partitionId(), {}
        close = np.array([close_id], dtype="<u2").tobytes()
        for batch in batches:
            ids, counts, starts = [], [], []
            for source, text in zip(batch["source"].to_pylist(), batch["text"], strict=True):
                ids.append(encoder.encode(text.as_py() or "") + close)
                counts.append(len(ids[-1]) // 2)
                starts.append(sent.get(source, 0))
                sent[source] = starts[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([lane] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                ["doc_id", "source", "doc_tokens", "ids", "lane", "lane_start"],
            )

    return run


class Schedule:
    """The fluid schedule: source s has sent min(totals[s], weights[s] * V) tokens at virtual time V."""

    def __init__(self, totals: list[int], weights: list[float], lot_tokens: int):
        self.totals = np.array(totals, dtype=np.int64)
        self.weights = np.array(weights, dtype=np.float64)
        self.lot_tokens = lot_tokens
        self.ends = self.totals / self.weights
        self.breaks = np.unique(np.concatenate([[0.0], self.ends]))
        self.sent_at = np.array([np.minimum(self.totals, self.weights * v).sum() for v in self.breaks])
        self.total = int(self.totals.sum())
        self.lots = max(1, -(-self.total // lot_tokens))
        self._cuts: dict[int, np.ndarray] = {}

    def time_of(self, lot: int) -> float:
        return float(np.interp(min(lot * self.lot_tokens, self.total), self.sent_at, self.breaks))

    def cut(self, lot: int) -> np.ndarray:
        """Tokens of each source that lie before this lot; monotone in the lot."""
        if lot >= self.lots:
            return self.totals
        if lot not in self._cuts:
            if len(self._cuts) > 4096:
                self._cuts.clear()
            self._cuts[lot] = np.clip(np.ceil(self.weights * self.time_of(lot) - 0.5), 0, self.totals).astype(np.int64) if lot > 0 else np.zeros_like(self.totals)
        return self._cuts[lot]

    def lot_of(self, source: int, position: int) -> int:
        v = (position + 0.5) / self.weights[source]
        lot = min(self.lots - 1, int(np.interp(v, self.breaks, self.sent_at) // self.lot_tokens))
        while lot > 0 and self.cut(lot)[source] > position:
            lot -= 1
        while lot + 1 < self.lots and self.cut(lot + 1)[source] <= position:
            lot += 1
        return lot


SEGMENTS = "lot long, queue int, at long, doc_id long, start long, doc_tokens long, ids binary"


def _to_lots(schedule: Schedule, queue_of: dict):
    """Documents to segments, cut where lots end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, source, n, ids, at in zip(*(batch[c].to_pylist() for c in ("doc_id", "source", "doc_tokens", "ids", "at")), strict=True):
                s, done = queue_of[source], 0
                lot = schedule.lot_of(s, at)
                while done < n:
                    size = min(n - done, int(schedule.cut(lot + 1)[s]) - at - done)
                    if size > 0:
                        for column, value in zip(out, (lot, s, at + done, doc_id, done, n, ids if size == n else ids[2 * done : 2 * (done + size)]), strict=True):
                            column.append(value)
                        done += size
                    lot += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["lot", "queue", "at", "doc_id", "start", "doc_tokens", "ids"])

    return run


def serve(lengths: list[int], shares: np.ndarray, deficits: np.ndarray, position: int, window: int, min_piece: int) -> list[tuple[int, int, int]]:
    """Deficit round-robin from a global position until all queues are empty: (queue, tokens, position) in order."""
    left, deficit, out = list(lengths), list(map(float, deficits)), []
    total, shares = sum(left), list(map(float, shares))
    active = [s for s, n in enumerate(left) if n]
    while total:
        space = min(window - position % window, total)
        live = sum(shares[s] for s in active) or 1.0
        for s in active:
            deficit[s] += shares[s] / live * space
        for s in active:
            want = int(deficit[s])
            if want < min_piece and want < left[s]:
                continue
            size = min(want, left[s], space)
            if size > 0:
                out.append((s, size, position))
                position, space, total = position + size, space - size, total - size
                left[s] -= size
                deficit[s] -= size
        while space:  # the window's rest goes to the largest deficits, to be paid back later
            s = max((s for s in active if left[s]), key=deficit.__getitem__)
            size = min(left[s], space)
            out.append((s, size, position))
            position, space, total = position + size, space - size, total - size
            left[s] -= size
            deficit[s] -= size
        active = [s for s in active if left[s]]
    return out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(schedule: Schedule, window: int, min_piece: int):
    fields = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def lot_pieces(lot: int, segments: list[list[tuple]]) -> pa.RecordBatch:
        before = schedule.cut(lot)
        deficits = np.where(before < schedule.totals, np.minimum(schedule.weights * schedule.time_of(lot), schedule.totals) - before, 0.0)
        order = serve([sum(x[2] for x in q) for q in segments], schedule.weights, deficits, int(before.sum()), window, min_piece)
        heads = [[0, 0] for _ in segments]
        out: list[list] = [[] for _ in fields]
        for s, size, position in order:
            head = heads[s]
            while size:
                doc_id, start, length, doc_tokens, ids = segments[s][head[0]]
                done = head[1]
                n = min(size, length - done)
                for column, value in zip(out, (doc_id, start + done, n, ids[4 * done : 4 * (done + n)], doc_tokens, position // window, position % window), strict=True):
                    column.append(value)
                position, size = position + n, size - n
                head[1] += n
                if head[1] == length:
                    segments[s][head[0]] = None
                    head[0], head[1] = head[0] + 1, 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, fields, strict=True)], PIECES_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, segments = None, []
        for batch in batches:
            for this, queue, doc_id, start, doc_tokens, ids in zip(*(batch[c].to_pylist() for c in ("lot", "queue", "doc_id", "start", "doc_tokens", "ids")), strict=True):
                if this != lot:
                    if lot is not None:
                        yield lot_pieces(lot, segments)
                    lot, segments = this, [[] for _ in schedule.totals]
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                segments[queue].append((doc_id, start, len(ids) // 2, doc_tokens, wide))
        if lot is not None:
            yield lot_pieces(lot, segments)

    return run


PIECES_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, weights: dict | None = None, window: int = WINDOW, close_id: int = CLOSE_ID, min_piece: int = MIN_PIECE, lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    ``weights`` gives target proportions by source (missing sources: 1). By default they are the
    sources' shares of all tokens, the only proportions at which no queue runs dry before the others.
    """
    tokens = stage(docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(_tokenise(close_id), TOKENS), "pack-tokens")
    lanes = tokens.groupBy("source", "lane").agg(F.sum("doc_tokens").alias("n"))
    totals = [(r["source"], r["n"]) for r in lanes.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()]
    if not totals:
        return docs.sparkSession.createDataFrame([], PIECES)
    shares = [float(n if weights is None else weights.get(s, 1.0)) for s, n in totals]
    schedule = Schedule([n for _, n in totals], shares, lot_tokens)
    ahead = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    base = lanes.select(F.col("source").alias("_s"), F.col("lane").alias("_l"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base"))
    placed = tokens.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("lane") == F.col("_l"))).withColumn("at", F.col("_base") + F.col("lane_start")).drop("_s", "_l", "_base", "lane", "lane_start")
    lots = placed.mapInArrow(_to_lots(schedule, {s: i for i, (s, _) in enumerate(totals)}), SEGMENTS)
    return lots.repartition("lot").sortWithinPartitions("lot", "queue", "at").mapInArrow(_pack(schedule, window, min_piece), PIECES)
