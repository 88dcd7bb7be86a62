"""License notices planted in prose, against what was planted and the longest common subsequence of words."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cantora.llm import licenses

T = licenses.TEMPLATES
PROSE = "the quick people went on to say that this was all they had seen of works in these long days and nights under dark skies while others would stay".split()


def names(text, scanner=None):
    return [x[2] for x in (scanner or licenses.Scanner(T)).scan(text)]


def plain_words(text):
    return re.findall(r"\w[\w.+/-]*\w|\w", text.lower())


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def plant(rng, name):
    """A notice with some words changed, none of which tells licenses apart, and how many of its words are left."""
    raw = T[name].split(" ")
    changed = 0
    if len(raw) > 9 and name != "SPDX":
        for _ in range(rng.randrange(1 + len(raw) // 12)):
            k = rng.randrange(1, len(raw) - 1)
            w = plain_words(raw[k])
            if len(w) == 1 and raw[k].isalpha() and raw[k].islower() and w[0] not in ("version", "v") and not licenses.tells(w[0]) and raw[k] not in ("thing", "other"):
                raw[k] = rng.choice(("thing", "other"))
                changed += 1
    return " ".join(raw), len(plain_words(T[name])) - changed


def test_planted_notices():
    rng, scanner = random.Random(4), licenses.Scanner(T)
    some = [n for n in T if n != "SPDX"]
    for _ in range(60):
        parts, planted = [], []
        for _ in range(rng.randrange(1, 7)):
            name = rng.choice(some)
            text, held = plant(rng, name)
            planted.append((name, held))
            parts += [" ".join(rng.choice(PROSE) for _ in range(rng.randrange(3, 90))) + ".", text]
        text = rng.choice(["\n", " "]).join([*parts, "the licence of this is not known, and all copyright is with us"])
        found = scanner.scan(text)
        assert [x[2] for x in found] == [name for name, _ in planted]
        for x, (name, held) in zip(found, planted, strict=True):  # an alignment in blocks may leave a few words out
            assert held - 3 <= round(x[4] * len(plain_words(T[name]))) <= held
        lines = text.split("\n")
        for first, last, name, saved, held, differences in found:
            there = plain_words("\n".join(lines[first : last + 1]))
            assert round(held * len(plain_words(T[name]))) <= common(plain_words(T[name]), there) and saved > 0 and bool(differences) == (held < 1)


def test_compression_decides(monkeypatch):
    text = f"a page\n{T['MIT-whole-text']}\nand {T['GPL-notice']}"
    assert names(text) == ["MIT-whole-text", "GPL-notice"]
    real = licenses.Scanner.saved
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, k, raw: 0)
    assert names(text) == []
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, k, raw: 10_000 - real(self, k, raw))  # the worst first
    assert names(text) != ["MIT-whole-text", "GPL-notice"]


def test_ranking_puts_the_right_template_first():
    scanner = licenses.Scanner(T)
    for most, among in scanner.classes:
        for k in among:
            t = scanner.templates[k]
            block = tuple(PROSE[: most // 2] + t.words + PROSE[: most // 2])
            ranked = scanner.rank(block, among)
            assert k in ranked[:4]
        assert not among or most < 60 or scanner.rank(tuple(PROSE * 4), among) == []


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Licensed under the Apache License, Version 1.1.", []),
        (T["GPL-3.0"].replace("version 3", "version 2"), ["GPL-2.0"]),
        (T["GPL-3.0"].replace("version 3", "version 4"), []),
        (T["CC-BY-4.0"].replace("Attribution", "Attribution-NonCommercial"), ["CC-BY-NC-4.0-notice"]),
        (T["CC-BY-4.0"].replace("Attribution", "Attribution-NonCommercial-NoDerivatives"), ["CC-BY-NC-ND-4.0"]),
        (T["CC-BY-4.0"].replace("4.0 International", "3.0 Unported"), ["CC-BY-3.0"]),
        (T["CC-BY-4.0"].replace("4.0", "2.5"), []),
        (T["MPL-2.0"].replace("2.0", "1.1"), []),
        (T["GPL-notice"].replace("General", "Affero General"), ["AGPL-3.0-notice"]),
        (T["LGPL-notice"].replace("Lesser ", ""), []),
        (T["GPL-3.0"].replace("is licensed", "is not licensed"), []),
        (T["GPL-3.0"].replace("General", "Private"), []),
        ("Not " + T["Apache-2.0"], []),
        ("We did not. " + T["Apache-2.0"], ["Apache-2.0"]),
        ("# SPDX-License-Identifier: BSD-3-Clause AND MIT\nx", ["SPDX-BSD-3-Clause AND MIT"]),
        ("SPDX-License-Identifier:\nnext", []),
    ],
)
def test_words_that_tell_licenses_apart(text, wanted):
    assert names(f"some prose\n{text}\nmore of it") == wanted


def test_many_trigger_words():
    rng = random.Random(2)
    began = time.time()
    assert names(" ".join(["license"] * 20_000)) == []
    assert names(" ".join(rng.choice(["license", "copyright", "warranty", "permission is", "of"]) for _ in range(20_000))) == []
    assert time.time() - began < 12  # 2 s on a free machine
    assert names((T["MIT"] + " " + T["GPL-notice"] + "\n") * 300) == ["MIT", "GPL-notice"] * 300


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, T["MIT"]), (2, None), (None, "")], "doc_id long, text string").withColumns({"license": F.lit(1), "saved": F.lit("x"), "first_line": F.lit(0)})
    assert [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()] == [(1, "MIT")]
