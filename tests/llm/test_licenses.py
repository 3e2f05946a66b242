import itertools
import random

from rimward.llm import licenses
from tests.llm.helpers import DOCS, awkward, empty, words


def test_longest_increasing_against_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        seconds = rng.sample(range(20), 8)
        pairs = list(enumerate(seconds))
        got = licenses.longest_increasing(pairs)
        assert got == sorted(got) and all(a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
        best = max(n for n in range(9) for c in itertools.combinations(seconds, n) if list(c) == sorted(c))
        assert len(got) == best


def test_alignment_is_increasing_and_equal():
    rng = random.Random(2)
    for _ in range(50):
        t = [rng.choice("abcdefghij") for _ in range(30)]
        u = [x for x in t if rng.random() < 0.7] + ["z"]
        m = licenses.align(u, t)
        assert all(u[a] == t[b] for a, b in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert licenses.align(t, t) == [(i, i) for i in range(30)]


def test_scan_finds_notices_in_long_texts(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        around = " the license under version of this work ".join(words(rng, 60) for _ in range(4))
        rows.append((i, f"{around}\n{text}\n{around}", "en", "a", 0))
        want[i] = name
    edited = licenses.TEMPLATES["MIT-text"].replace("hereby ", "").replace("free of charge", "gratis")
    rows += [(100, edited, "en", "a", 0), (101, "license under the version", "en", "a", 0), (102, None, "en", "a", 0), (103, "", "en", "a", 0)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "license")).collect()}
    assert {i: got[i]["license"] for i in want} == want
    for i in want:
        cut = licenses.words_of(rows[i][1])[got[i]["start_word"] : got[i]["end_word"]]
        assert cut == licenses.words_of(licenses.TEMPLATES[want[i]]) and got[i]["coverage"] == 1
    assert got[100]["license"] == "MIT-text" and 0.8 <= got[100]["coverage"] < 1
    assert got[101]["license"] is got[102]["license"] is got[103]["license"] is None


def test_siblings_get_their_own_name():
    scan = lambda text: licenses.Scanner(licenses.TEMPLATES).scan(text, 0.8)
    for name, template in licenses.TEMPLATES.items():
        assert scan(f"Some words before. {template} And some after.")[0] == name
    gpl = licenses.TEMPLATES["GPL-3.0-header"]
    for text, want in {
        "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
        gpl.replace("version 3", "version 2"): "GPL-2.0-header",
        "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0-long",
        "Released under the BSD License.": "BSD",
        "Released under the Zlib License.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under the GNU General Public License, version 4.": None,
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": None,
    }.items():
        assert scan(text)[0] == want, text


def test_each_of_several_notices_is_named():
    between = " ".join(f"filler{i}" for i in range(40))
    text = f"{licenses.TEMPLATES['MIT-text']} {between} {licenses.TEMPLATES['Apache-2.0']} {between} {licenses.TEMPLATES['CC-BY-NC-4.0']}"
    assert licenses.Scanner(licenses.TEMPLATES).scan(text, 0.8)[4] == ["MIT-text", "Apache-2.0", "CC-BY-NC-4.0"]


def test_coverage_against_brute_force():
    """With words that occur once, the longest increasing subsequence is the longest common one, found here by dynamic programming."""
    rng = random.Random(5)
    for _ in range(60):
        template = [f"t{c}" for c in rng.sample("abcdefghijklmnopqrst", 12)]
        text = [w for w in template if rng.random() < 0.85] + [f"u{i}" for i in range(3)]
        for _ in range(rng.randrange(4)):
            i, j = rng.randrange(len(text)), rng.randrange(len(text))
            text[i], text[j] = text[j], text[i]
        table = [[0] * (len(template) + 1) for _ in range(len(text) + 1)]
        for i, x in enumerate(text):
            for j, y in enumerate(template):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, best = licenses.Scanner({"one": " ".join(template)}).found(" ".join(text), 0.5)
        want = table[-1][-1] / len(template)
        assert [round(x[1], 9) for x in found] == ([round(want, 9)] if want >= 0.5 else []) and (not found or best == found[0][1])


def test_awkward_and_empty(spark):
    assert licenses.scan(awkward(spark)).count() == awkward(spark).count()
    assert licenses.scan(empty(spark)).count() == 0
