"""Language-model scoring by deleted interpolation.

P(w | h) = a_b / (V + 1) + b_b c(w) / N + g_b c(h w) / c(h): maximum-likelihood estimates of orders 0, 1
and 2, mixed by weights of the bucket b of the context's frequency c(h), a power of two. The weights
come from expectation-maximisation on held-out counts: training documents of one fold are deleted
from the counts, and the weights are those that make that fold likeliest. The final model counts all training
documents. Tokens are lower-cased words and one end a text; a text's first context is a start mark.

How counts meet tokens. Each task turns its documents into chunks of about ``CHUNK_TOKENS`` tokens. A
chunk sends one request for each distinct word and word pair it holds, with its own counts of it, as
sorted hashes dealt to buckets by hash range; a bucket sums the counts of all chunks and sends each chunk the
totals in the order of its request. So a frequent word is one number in each chunk and no key is hot,
and the texts themselves are never shuffled. Chunks and answers meet by chunk, are staged, and are read
twice: for the statistics of the held-out fold (a histogram whose size does not grow), and for the scores.

Hashes are 64 bits; with n distinct grams about n^2 / 2^65 pairs share one.

Defined cases: a null or empty text is one end token; a null doc_id is a training document outside the
held-out fold; repeated rows are scored each; without training tokens every token has c = 0; without held-out
counts the weights stay at their prior; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import lower_words, release, stage, text_bytes

CHUNK_TOKENS = 1_000_000
#: Characters of text for each bucket of counts.
BUCKET_CHARS = 8_000_000
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Steps of the held-out histogram in each doubling of a probability.
STEPS = 16
CONTEXT_BUCKETS = 32

END = b"\n"  # no word holds a line feed


def _squeeze(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) if len(x) else b""


def _open(data: bytes | None, dtype) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: The context of a text's first token.
START_HASH = np.uint64(0x5851F42D4C957F2D)


class Chunk:
    """Tokens of some documents as places in a table of distinct words."""

    def __init__(self):
        self.place: dict[bytes, int] = {END: 0}
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, fold, tokens
        self.size = 0

    def add(self, doc_id: int | None, fold: int, text: bytes) -> None:
        words, place = lower_words(text), self.place
        found = np.empty(len(words) + 1, dtype=np.int32)
        found[:-1] = [place.setdefault(w, len(place)) for w in words]
        found[-1] = 0
        self.tokens.append(found)
        self.docs.append((doc_id, fold, len(found)))
        self.size += len(found)

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.place), np.uint64, len(self.place))


def contexts(tokens: np.ndarray, lengths: np.ndarray, words: int) -> np.ndarray:
    """The place before each token; ``words`` stands for the start."""
    before = np.concatenate([[words], tokens[:-1]]) if len(tokens) else tokens
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = words
    return before


def _by_hash(hashes: np.ndarray, *counts: np.ndarray):
    order = np.argsort(hashes, kind="stable")
    return hashes[order], *(c[order] for c in counts)


def _grams(tokens, before, word_hashes):
    """Distinct pairs as sorted hashes, and the place of each token's pair in them."""
    wide = np.append(word_hashes, START_HASH)
    pairs, which = np.unique(before.astype(np.int64) * len(wide) + tokens, return_inverse=True)
    hashes = _mix(wide[pairs // len(wide)], wide[pairs % len(wide)])
    order = np.argsort(hashes, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return hashes[order], back[which.ravel()]


STATE = [("chunk", "long", pa.int64()), ("ids", "binary", pa.binary()), ("flags", "binary", pa.binary()), ("word", "binary", pa.binary()), ("hashes", "binary", pa.binary())]
REQUEST = [("chunk", "long", pa.int64()), ("kind", "int", pa.int32()), ("bucket", "long", pa.int64()), ("hashes", "binary", pa.binary()), ("n", "binary", pa.binary()), ("gone", "binary", pa.binary())]
WORDS, PAIRS = 1, 2


def _schema(fields: list) -> str:
    return ", ".join(f"{n} {t}" for n, t, _ in fields)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t[2]) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], [t[0] for t in fields])


def _states(chunk_tokens: int):
    """Documents to chunks: ids, flags (folds, then lengths), tokens as places in the chunk's table of words, hashes of that table."""

    def row(chunk: Chunk, name: int) -> pa.RecordBatch:
        folds = np.array([d[1] + FOLDS * (d[0] is None) for d in chunk.docs], dtype=np.int32)
        lengths = np.array([d[2] for d in chunk.docs], dtype=np.int32)
        ids = np.array([d[0] if d[0] is not None else 0 for d in chunk.docs], dtype=np.int64)
        return _batch([(name, _squeeze(ids), _squeeze(np.concatenate([folds, lengths])), _squeeze(np.concatenate(chunk.tokens)), _squeeze(chunk.hashes()))], STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, made = Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, fold, text in zip(batch["doc_id"].to_pylist(), batch["fold"].to_pylist(), batch["_text"], strict=True):
                chunk.add(doc_id, fold, text.as_py())
                if chunk.size >= chunk_tokens:
                    yield row(chunk, made)
                    chunk, made = Chunk(), made + 1
        if chunk.size:
            yield row(chunk, made)

    return run


def _requests(buckets: int):
    """Chunks to requests: sorted hashes of a bucket, training counts, counts in the deleted fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, flags, word, held in zip(*(batch[c] for c in ("chunk", "flags", "word", "hashes")), strict=True):
                both, tokens, words = _open(flags.as_py(), np.int32), _open(word.as_py(), np.int32), _open(held.as_py(), np.uint64)
                lengths = both[len(both) // 2 :]
                fold = np.repeat(both[: len(both) // 2] % FOLDS, lengths)
                train, deleted = fold != HELD_OUT, fold == DELETED
                pairs, which = _grams(tokens, contexts(tokens, lengths, len(words)), words)
                out = []
                for kind, hashes, counts, gone in (
                    (WORDS, *_by_hash(words, np.bincount(tokens[train], minlength=len(words)), np.bincount(tokens[deleted], minlength=len(words)))),
                    (PAIRS, pairs, np.bincount(which[train], minlength=len(pairs)), np.bincount(which[deleted], minlength=len(pairs))),
                ):
                    to = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(to)) + 1
                    for x, n, g, t in zip(np.split(hashes, cuts), np.split(counts, cuts), np.split(gone, cuts), np.split(to, cuts), strict=True):
                        out.append((name.as_py(), kind, int(t[0]), _squeeze(np.diff(x, prepend=np.uint64(0))), _squeeze(n.astype(np.uint32)), _squeeze(g.astype(np.uint32))))
                yield _batch(out, REQUEST)

    return run


ANSWER = "chunk long, kind int, bucket long, n binary, gone binary, distinct long"


def _sum_bucket(requests: pd.DataFrame) -> pd.DataFrame:
    """Totals of all chunks for each request; ``distinct`` (words with a training count) stands in one row."""
    out = []
    for kind in (WORDS, PAIRS):
        mine = requests[requests.kind == kind].sort_values("chunk")
        if not len(mine):
            continue
        hashes = [np.cumsum(_open(x, np.uint64), dtype=np.uint64) for x in mine["hashes"]]
        sizes = np.cumsum([len(x) for x in hashes])[:-1]
        distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = [np.bincount(which.ravel(), np.concatenate([_open(x, np.uint32) for x in mine[c]]).astype(np.float64), len(distinct)).astype(np.uint64) for c in ("n", "gone")]
        answers = [np.split(t[which.ravel()], sizes) for t in totals]
        seen = int((totals[0] > 0).sum()) if kind == WORDS else 0
        for i, (chunk, bucket) in enumerate(zip(mine.chunk, mine.bucket, strict=True)):
            out.append((chunk, kind, bucket, _squeeze(answers[0][i]), _squeeze(answers[1][i]), 0 if i else seen))
    return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "n", "gone", "distinct"])


COUNTED = "ids binary, flags binary, word binary, n1 binary, gone1 binary, n2 binary, gone2 binary"


def _meet(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A chunk with the counts of its tokens: words' by place in its table (the start last), pairs' by token."""
    r = state.iloc[0]
    both = _open(r["flags"], np.int32)
    lengths = both[len(both) // 2 :]
    tokens, words = _open(r["word"], np.int32), _open(r["hashes"], np.uint64)
    before = contexts(tokens, lengths, len(words))

    def totals(kind, column):
        mine = answers[answers.kind == kind].sort_values("bucket")
        return np.concatenate([_open(x, np.uint64) for x in mine[column]])

    order = np.argsort(words, kind="stable")
    n1, gone1 = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    n1[order], gone1[order] = totals(WORDS, "n"), totals(WORDS, "gone")
    _, which = _grams(tokens, before, words)
    n2, gone2 = totals(PAIRS, "n")[which], totals(PAIRS, "gone")[which]
    # each text starts and ends once, so the start's count is the end's
    n1, gone1 = np.append(n1, n1[0]), np.append(gone1, gone1[0])
    return pd.DataFrame([[r["ids"], r["flags"], r["word"], _squeeze(n1), _squeeze(gone1), _squeeze(n2), _squeeze(gone2)]], columns=[c.split()[0] for c in COUNTED.split(", ")])


def _tokens_of(row: dict) -> tuple:
    both = _open(row["flags"], np.int32)
    flags, lengths = both[: len(both) // 2], both[len(both) // 2 :]
    word, counts = _open(row["word"], np.int32), [_open(row[c], np.uint64).astype(np.float64) for c in ("n1", "gone1", "n2", "gone2")]
    return _open(row["ids"], np.int64), flags % FOLDS, flags >= FOLDS, lengths, contexts(word, lengths, len(counts[0]) - 1), word, *counts


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(counts + 1)).astype(np.int64), CONTEXT_BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b) > 0, a.shape))


def _step(p: np.ndarray) -> np.ndarray:
    """A probability's place in the histogram; zero is 0, and larger places are smaller probabilities."""
    return np.where(p > 0, 1 + np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS), 0).astype(np.int64)


def _held_out_steps(train_tokens: int, deleted_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, folds, _, lengths, before, word, n1, gone1, n2, gone2 = _tokens_of(row)
                use = np.repeat(folds == DELETED, lengths)
                left1 = n1 - gone1
                history = left1[before[use]]
                keys = np.stack([context_bucket(history), _step(_ratio(left1[word[use]], train_tokens - deleted_tokens)), _step(_ratio((n2 - gone2)[use], history))])
                found, times = np.unique(keys, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found), pa.array(times)], ["b", "p1", "p2", "times"])

    return run


def learn_weights(b: np.ndarray, p1: np.ndarray, p2: np.ndarray, times: np.ndarray, words: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by context bucket (rows) and order (columns), by EM on the held-out histogram.

    One held-out token for each order is added, so no weight is 0. Contexts never seen have no estimate of order 2: their bucket's weight of it is 0.
    """
    back = lambda q: np.where(q > 0, 2.0 ** (-(q - 1) / STEPS), 0.0)
    p = np.stack([np.full(len(b), 1.0 / (words + 1)), back(p1), back(p2)])
    weights = np.tile([0.1, 0.4, 0.5], (CONTEXT_BUCKETS, 1))
    weights[0] = [0.3, 0.7, 0.0]
    prior = (np.arange(3)[None, :] < np.where(np.arange(CONTEXT_BUCKETS) == 0, 2, 3)[:, None]).astype(np.float64)
    for _ in range(rounds):
        part = weights[b].T * p
        part *= times / part.sum(axis=0)
        new = np.stack([np.bincount(b, x, CONTEXT_BUCKETS) for x in part], axis=1) + prior
        weights = np.where(new.sum(axis=1, keepdims=True) > 3.5, new / new.sum(axis=1, keepdims=True), weights)
    return weights


def _learn(words: int):
    """A context bucket's histogram to its weights: the buckets are learned apart, and only their weights reach the driver."""

    def run(steps: pd.DataFrame) -> pd.DataFrame:
        steps = steps.sort_values(["p1", "p2"])  # sums in one order, so that reruns agree
        b = steps["b"].to_numpy(np.int64)
        found = learn_weights(b, *(steps[c].to_numpy(np.int64) for c in ("p1", "p2", "times")), words)[b[0]]
        return pd.DataFrame([[b[0], *found]], columns=["b", "w0", "w1", "w2"])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(weights: np.ndarray, train_tokens: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, folds, missing, lengths, before, word, n1, _, n2, _ = _tokens_of(row)
                history, own = n1[before], n1[word]
                w = weights[context_bucket(history)]
                p = w[:, 0] / (words + 1) + w[:, 1] * _ratio(own, train_tokens) + w[:, 2] * _ratio(n2, history)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                total = lambda x: np.add.reduceat(x, starts)
                columns = [pa.array(ids, mask=missing), pa.array(folds == HELD_OUT), pa.array(lengths.astype(np.int64)), pa.array(total((own > 0).astype(np.int64))), pa.array(np.full(len(ids), train_tokens)), pa.array(total(np.log10((own + 1) / (train_tokens + (words + 1))))), pa.array(total(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

    return run


def score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold"), text_bytes().alias("_text"))
    chars = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(32, -(-chars // bucket_chars))
    states = stage(rows.mapInArrow(_states(chunk_tokens), _schema(STATE)), "lm-chunks")
    requests = states.mapInArrow(_requests(buckets), _schema(REQUEST))
    answers = stage(requests.groupBy("bucket").applyInPandas(_sum_bucket, ANSWER), "lm-counts")
    words = answers.agg(F.sum("distinct")).first()[0] or 0
    release(docs.sparkSession)
    counted = stage(states.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_meet, COUNTED), "lm-counted")
    release(docs.sparkSession, states, answers)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flags in batch["flags"].to_pylist():
                both = _open(flags, np.int32)
                folds, lengths = both[: len(both) // 2] % FOLDS, both[len(both) // 2 :]
                yield pa.RecordBatch.from_arrays([pa.array([int(lengths[folds != HELD_OUT].sum())]), pa.array([int(lengths[folds == DELETED].sum())])], ["n", "gone"])

    total = counted.select("flags").mapInArrow(sizes, "n long, gone long").agg(F.sum("n"), F.sum("gone")).first()
    train_tokens, deleted_tokens = total[0] or 0, total[1] or 0
    steps = counted.mapInArrow(_held_out_steps(train_tokens, deleted_tokens), "b long, p1 long, p2 long, times long").groupBy("b", "p1", "p2").agg(F.sum("times").alias("times"))
    learned = steps.groupBy("b").applyInPandas(_learn(words), "b long, w0 double, w1 double, w2 double").collect()  # a row for each of few buckets
    weights = learn_weights(*[np.zeros(0, np.int64)] * 4, words)
    for r in learned:
        weights[r["b"]] = r["w0"], r["w1"], r["w2"]
    return counted.mapInArrow(_scores(weights, train_tokens, words), SCORED)
