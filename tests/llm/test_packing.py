import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rimward.llm import packing
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library():
    tokenizer, encoder = reference(), packing.Encoder()
    texts = [r[1] or "" for r in awkward_rows()] + ["  two  spaces ", "a \n b", "\n\nx\n y", "tab\tsep  x", "x y z", "don't we'll I'm", "a\x1cb c\x1d d", " <|endoftext|> end", "hi <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|>  two", "<|endoftext", "y" * 300 + " " + "z" * 300, "12 345 a1b2 ..?! ,", "é́ x"]
    for text in texts + texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check(rows, texts, window=2048, lots=1):
    tokenizer = reference()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = collections.defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    for doc_id, several in want.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        if len(several) == 1:
            got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
            assert got == several[0]
            at = 0
            for r in pieces:
                assert r["start"] == at and r["doc_tokens"] == len(several[0])
                assert zlib.crc32(np.array(several[0][at : at + r["length"]], "<u4").tobytes()) == zlib.crc32(r["ids"])
                at += r["length"]
        else:
            assert sum(r["length"] for r in pieces) == sum(map(len, several))
    total = sum(r["length"] for r in rows)
    assert sorted(by_sequence) == list(range(-(-total // window)))
    for n, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == (window if (n + 1) * window <= total else total - n * window)
    return by_sequence


def test_pack_in_one_and_in_many_lots(spark):
    special = (3000, "one <|endoftext|> two<|endoftext|>", "en", "a", 0)
    texts = [(r[0], r[1]) for r in (*awkward_rows(), special)]
    docs = awkward(spark).unionByName(spark.createDataFrame([special], DOCS))
    for lot_tokens in (1 << 20, 5000):
        check(packing.pack(docs, lot_tokens=lot_tokens).collect(), texts)
    check(packing.pack(docs, weights={"a": 1, "b": 5}, lot_tokens=7000).collect(), texts)


def test_windows_hold_the_target_proportions(spark):
    rng = np.random.default_rng(0)
    rows, source = [], {}
    for i in range(400):
        source[i] = "abc"[int(rng.choice(3, p=[0.6, 0.3, 0.1]))]
        rows.append((i, " ".join(map(str, rng.integers(0, 999, int(rng.integers(20, 900))))), "en", source[i], 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    pieces = packing.pack(docs, lot_tokens=20000).collect()
    totals = collections.Counter()
    for r in pieces:
        totals[source[r["doc_id"]]] += r["length"]
    whole = sum(totals.values())
    sent = collections.Counter()
    for n, found in sorted(check(pieces, [(r[0], r[1]) for r in rows]).items()):
        for r in found:
            sent[source[r["doc_id"]]] += r["length"]
        done = min((n + 1) * 2048, whole)
        for s in "abc":  # deficits are carried: the running counts stay by the target from window to window
            assert abs(sent[s] - done * totals[s] / whole) <= 3 * packing.MIN_PIECE


def test_empty(spark):
    assert packing.pack(empty(spark)).count() == 0
