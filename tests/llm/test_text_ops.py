"""Training-data operators against brute force on small rows, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cantora.llm import chat, common, decontamination, forest, licenses, lines, minhash, packing, quality, toxicity, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"x{rng.randrange(9999)}"
    return out


def near_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(6):
        base = words(rng, 120)
        rows += [base, base, *(edited(rng, base, k) for k in (1, 2, 3, 4, 5, 6, 8))]
        rows.append(edited(rng, rows[-4], 3))
    rows += [words(rng, rng.randrange(1, 60)) for _ in range(30)] + [["a"], ["a"], ["a", "b"], [], ["A", "b"]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, "\xa0 "), (902, "\xa0"), (903, "a\nb")]


def brute_components(rows):
    sets = {}
    for i, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("block", "local"), [(2_000, 1_000_000), (3, 7)])
def test_near_duplicates(spark, monkeypatch, block, local):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash.components, "__defaults__", (local,))
    rows = near_rows()
    found = minhash.near_duplicates(docs_of(spark, rows).withColumnsRenamed({"lang": "h1", "source": "node"}))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    found = minhash.near_duplicates(docs_of(spark, [(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "z"), (4, None)])).collect()
    assert sorted(((r["doc_id"] or -1), r["component_id"] or -1, r["kept"]) for r in found) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (3, 3, True), (4, 4, True)]


def test_null_ids_stay_apart(spark):
    rng = random.Random(8)
    x, y, z = (" ".join(words(rng, 80)) for _ in range(3))
    rows = [(5, f"{x} one"), (None, f"{x} two"), (9, f"{y} one"), (None, f"{y} two"), (None, z), (None, f"{z} two"), (7, f"{x} three"), (7, f"{z} three")]
    found = {r["text_key"]: r for r in minhash.near_rows(docs_of(spark, rows)).collect()}
    keyed = docs_of(spark, rows).select("text", F.xxhash64("text").alias("k"))
    got = {r["text"]: found[r["k"]] for r in keyed.collect()}
    assert [got[t]["component_id"] for _, t in rows] == [5, 5, 9, 9, 7, 7, 5, 7]
    assert [got[t]["head"] for _, t in rows] == [True, False, True, False, False, False, False, True]
    docs = corpus_pipeline.near_stage(spark, docs_of(spark, rows), "")
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == {rows[0], rows[2], rows[7]}


def test_posterior_bounds():
    least = minhash.least_matches(250, 0.75, 1e-6)
    assert len(least) == 10 and all(0 < m < 25 * (k + 1) for k, m in enumerate(least)) and list(least) == sorted(least)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>[INST]<\\s>"), (1, 2, "user", "b"), (1, 3, "assistant", None), (1, 4, "user", "tail \\ <|end|>"), (2, 0, "user", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, None, None, "n")]
    examples = chat.prefix_target_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = {}
    for r in examples.withColumn("turns", chat.read_turns(F.col("formatted"))).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for conv, mine in got.items():
        wanted = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        mine.sort(key=lambda r: r["example"])
        assert [tuple(t) for t in mine[-1]["turns"]] == wanted
        targets = [r for r in mine if r["formatted"][: r["loss_start"]].endswith("<s>assistant[INST]")]
        assert len(targets) == sum(role == "assistant" for role, _ in wanted)
        for r in targets:
            assert [tuple(t) for t in r["turns"]] == wanted[: len(r["turns"])] and len(r["formatted"]) == r["loss_start"] + r["loss_length"] + 4
    assert chat.prefix_target_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(packing.tokenizer_path())


def test_packing(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Straße", "don't", "naïve,", "12ab", "THE", "ΟΔΟΣ", "x<|endoftext|>y", "é", "\x1c", "...hi", "日本", "²x"]) for _ in range(rng.randrange(0, 900)))) for i in range(40)] + [(99, None), (99, ""), (None, "a"), (7, "dup"), (7, "dup")]
    pieces = packing.pack(docs_of(spark, rows).withColumnRenamed("lang", "key"), packing.tokenizer_path(), 512).collect()
    wanted = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    place = {}
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        place.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for at in place.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 512
    assert sum(sum(n for _, n in at) < 512 for at in place.values()) <= 1
    whole, pieces = Counter(), sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    current = []
    for p in pieces:
        current += p["ids"]
        if p["start"] + p["length"] == p["doc_tokens"]:
            whole[p["doc_id"], tuple(current)] += 1
            current = []
    assert whole == wanted
    assert packing.pack(docs_of(spark, []), packing.tokenizer_path()).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[a, b] for a in range(16) for b in range(16)])
    order = cells[np.argsort(packing.hilbert_key(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([3, 5, 14, 20, 30, 59])] + [(90, None), (91, "..."), (None, "a b c d e")]
    rows = []
    for i in range(60):
        body = words(rng, rng.randrange(0, 80))
        item = items[rng.randrange(6)][1].split()
        part = item if i % 3 == 0 else edited(rng, item, 1 + i % 2) if i % 3 == 1 else item[: max(1, len(item) - i % 7)]
        at = rng.randrange(len(body) + 1)
        rows.append((i, " ".join(body[:at] + [w.upper() for w in part] + body[at:])))
    rows += [(70, None), (71, ""), (None, items[3][1]), (0, rows[0][1])]
    wanted = {}
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, text in rows:
        for k, item in items:
            w, v = norm(text), norm(item)
            if k is None or not v or not w:
                continue
            s = min(5, len(v))
            grams = lambda x: Counter(tuple(x[j : j + s]) for j in range(len(x) - s + 1))  # noqa: E731, B023
            want = grams(v)
            for at in range(max(len(w) - len(v), 0) + 1):
                got = grams(w[at : at + len(v)])
                union = sum((got | want).values())
                if union and sum((got & want).values()) / union >= 0.75:
                    wanted[i, k] = max(wanted.get((i, k), 0), sum((got & want).values()) / union)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated_windows(docs_of(spark, rows).withColumnRenamed("lang", "w"), bench)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert got.keys() == wanted.keys() and all(abs(got[x] - wanted[x]) < 1e-9 for x in got)
    assert decontamination.contaminated_windows(docs_of(spark, []), bench).count() == 0
    assert decontamination.contaminated_windows(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_radius_holds_windows_of_just_enough_similarity(spark):
    """Of 6,000 windows of similarity 0.75 to 0.8, none is farther than the radius from its item."""
    rng, rows = random.Random(31), []
    while len(rows) < 6_000:
        m = rng.choice([7, 14, 15, 21, 28, 35, 42, 63])
        item = [rng.getrandbits(63) for _ in range(m)]
        changed = next(c for c in range(m, -1, -1) if (m - c) / (m + c) >= 0.75)
        rows.append((item, [rng.getrandbits(63) for _ in range(changed)] + item[changed:]))
    prints = spark.createDataFrame(rows, "one array<long>, two array<long>").select(F.bit_count(decontamination.simhash("one").bitwiseXOR(decontamination.simhash("two"))).alias("d"))
    assert prints.agg(F.max("d")).first()[0] <= decontamination.RADIUS


def test_many_items_of_one_length(spark):
    rng = random.Random(32)
    items = [(k, " ".join(words(rng, 20, 9_999))) for k in range(3_000)]
    rows = [(i, " ".join([*words(rng, 10), *items[i][1].split(), *words(rng, 5)])) for i in range(50)]
    found = decontamination.contaminated_windows(docs_of(spark, rows + [(99, " ".join(words(rng, 200_000)))]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in found.collect()) == [(i, i, 10, 1.0) for i in range(50)]


def test_wordpiece():
    rng = random.Random(5)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)}
    for first, later in ((pieces, None), (pieces | {b"a", b"b"}, pieces | {b"c", b"a", b"b"})):
        machine = wordpiece.Automaton(first, later)
        for _ in range(2000):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12)))
            at = n = 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in (first if not at or later is None else later)), None)
                if end is None:
                    n = wordpiece.UNKNOWN
                    break
                at, n = end, n + 1
            assert machine.count(word) == n


def test_wordpiece_rows(spark):
    import public_tokenizers

    rows = docs_of(spark, [(1, "the cat's  naïve 日本\n"), (2, None), (3, ""), (None, "a a"), (3, "")])
    got = sorted(tuple(r)[1:4] for r in wordpiece.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert got[:3] == [(0, 0, 0)] * 3 and got[3] == (2, 2, 0) and got[4][0] == 4


def test_lines(spark):
    rng = random.Random(6)
    rows = [(i, f"{' '.join(words(rng, 9, 9999))}\nPage {i} of {i + 7} here\nshort\n{' '.join(['shared'] * 5 + [f'v{i}x' if i % 2 else 'same'] + ['line'] * 9)}\n{' '.join(words(rng, 6, 9999))}") for i in range(30)]
    rows += [(50, None), (51, ""), (None, "Page 1 of 2 here"), (2, rows[2][1])]
    cleaned = lines.drop_recurring_lines(docs_of(spark, rows).withColumn("leaf", F.lit("x")), min_docs=10)
    assert "leaf" in cleaned.columns
    got = {}
    for r in cleaned.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, text in rows:
        parts = (text or "").split("\n")
        keep = text if text is None or i == 0 else "\n".join(p for p in parts if not p.startswith(("Page", "shared")))
        assert keep in got[i]
    assert lines.drop_recurring_lines(docs_of(spark, [])).count() == 0
    same = docs_of(spark, [(i, f"one two three {i % 4}") for i in range(8)])
    assert lines.drop_recurring_lines(same, min_docs=9).where("_n_dropped > 0").count() == 0


def brute_lines(rows, min_docs=10, long_docs=2, short_docs=100):
    """Texts and numbers of dropped lines, with every line of a leaf compared with every other."""
    masked = lambda x: re.sub(lines.VARIABLE, "<*>", re.sub(r"[ \t\x0b\f\r]+", " ", x).strip(" "))
    key = lambda m: (len(m.split(" ")), " ".join(m.split(" ")[:3]))
    constant = lambda m: len(m.split(" ")) - m.count("<*>")
    need = lambda c: min(long_docs, min_docs) if c >= 50 else max(short_docs, min_docs) if c < 3 else min_docs
    where = {}
    for at, (_, text) in enumerate(rows):
        for m in {masked(x) for x in (text or "").split("\n")}:
            if m and (constant(m) >= 3 or "<*>" not in m):
                where.setdefault(m, set()).add(at)
    first = lambda found: min((rows[i][0] for i in found if rows[i][0] is not None), default=None)
    recurring = {m: [first(at)] for m, at in where.items() if len(at) >= need(constant(m))}
    members = {}
    for m in where:
        tokens, best = m.split(" "), None
        for o in where:
            if o != m and key(o) == key(m):
                same = sum(map(str.__eq__, tokens, o.split(" ")))
                if same >= 0.8 * len(tokens) and (len(where[o]), RANK[o]) > (len(where[m]), RANK[m]):
                    best = o if best is None or (len(where[o]), RANK[o]) > (len(where[best]), RANK[best]) else best
        if best:
            members.setdefault(best, {best})
            members[best].add(m)
    for hub, mine in members.items():
        shared = {m: sum(a == b != "<*>" for a, b in zip(m.split(" "), hub.split(" "), strict=True)) for m in mine}
        for least, docs in ((3, min_docs), (50, min(long_docs, min_docs))):
            tier = [m for m in mine if (constant(m) if m == hub else shared[m]) >= least]
            found = set().union(*(where[m] for m in tier))
            if len(found) >= docs:
                for m in tier:
                    recurring.setdefault(m, []).append(first(found))
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        drop = [masked(x) in recurring and (f := min((y for y in recurring[masked(x)] if y is not None), default=None)) is not None and i != f for x in parts]
        out.append((i, text if not any(drop) else "\n".join(x for x, gone in zip(parts, drop, strict=True) if not gone), sum(drop)))
    return out


RANK = {}


def ranked(spark, rows):
    """Ties go to the smaller hash, which only Spark knows."""
    texts = sorted({re.sub(lines.VARIABLE, "<*>", x) for _, t in rows for x in (t or "").split("\n")})
    RANK.update({r["t"]: -r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()})
    return rows


def line_corpus(seed, extra=0):
    """Templates with fields that are plain words at any place, of many lengths, near and far lines of the same leaves."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bases = [["go", "on", "here", *(name() for _ in range(n))] for n in (1, 2, 3, 4, 7, 11, 16, 22, 57, 80) for _ in range(3)]
    rows = []
    for i in range(120):
        mine = []
        for base in rng.sample(bases, 6):
            vary = rng.choice([0, 0, 1, max(1, len(base) // 7), max(1, len(base) // 4)])
            line = list(base)
            for k in rng.sample(range(3, len(line)), min(vary, len(line) - 3)):
                line[k] = rng.choice([name(), f"n{rng.randrange(99)}"])
            mine.append(" ".join(line))
        rows.append((None if i % 17 == 0 else i, "\n".join([*mine, f"{name()} {name()} {name()} {name()}", ""])))
    rows += [(500 + k, "\n".join(" ".join(["go", "on", "here", *(name() for _ in range(n))]) for n in (2, 3, 4, 7, 11, 16))) for k in range(extra)]
    return [*rows, (3, rows[3][1]), (900, None), (901, "")]


@pytest.mark.parametrize(("group", "extra"), [(1_000, 0), (3, 0), (1, 200)])
def test_lines_equal_all_comparisons(spark, group, extra):
    rows = ranked(spark, line_corpus(21, extra))
    cleaned = lines.drop_recurring_lines(docs_of(spark, rows), min_docs=6, group=group).collect()
    wanted = brute_lines(rows, min_docs=6)
    key = lambda r: (r[0] is not None, r[0], r[1] or "", r[2])
    assert sorted(((r["doc_id"], r["text"], r["_n_dropped"]) for r in cleaned), key=key) == sorted(wanted, key=key)
    few = brute_lines(ranked(spark, line_corpus(21)), min_docs=6)
    assert sum(n for *_, n in few) > 200 and wanted[: 120] == few[: 120]


def test_lines_keep_columns_of_any_name(spark):
    names = ["_d", "_t", "_drop", "_kept", "_n_lines", "_N_dropped", "_bits", "_gone", "x", "leaf"]
    rows = docs_of(spark, [(i, f"this line is everywhere {i}\nown {chr(97 + i)} line") for i in range(12)])
    cleaned = lines.drop_recurring_lines(rows.select("*", *(F.lit(n).alias(n) for n in names)))
    assert cleaned.columns == [*rows.columns, *names, "_n_lines_", "_n_dropped_"]
    assert all(r[n] == n for r in cleaned.collect() for n in names) and sorted(r["_n_dropped_"] for r in cleaned.collect()) == [0] + [1] * 11


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of it" for i in range(9_000))
    one = "\n".join(["every document has this line"] * 700)
    got = {r["doc_id"]: r for r in lines.drop_recurring_lines(docs_of(spark, [(0, long + "\n" + one), *((i, one) for i in range(1, 12)), (20, "w " * 40_000), (21, "w " * 40_000)])).collect()}
    assert got[0]["_n_dropped"] == 0 and got[0]["text"].startswith(long) and all(got[i]["_n_dropped"] == 700 for i in range(1, 12))
    assert got[20]["_n_dropped"] == 0 and got[21]["_n_dropped"] == 1 and got[21]["text"] == ""


def test_long_and_short_lines(spark):
    rng = random.Random(13)
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(130)]
    rows = [(i, f"{own[i]} of its own\nLes.\n7 8" + (f"\n{passage}" if i < 2 else f"\n{passage} it ends {own[i]}" if i == 2 else "\nFew." if i < 60 else "")) for i in range(130)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[1] == f"{own[1]} of its own\n7 8"
    assert all(got[i] == rows[i][1].replace("\nLes.", "") for i in range(2, 130))


def test_lines_of_many_places_that_vary(spark):
    """A fifth of a line's words may vary, whatever its length."""
    rng = random.Random(36)
    rows, letters = [], str.maketrans("0123456789", "abcdefghij")  # digits would be variable fields
    plain = lambda n: [w.translate(letters) for w in words(rng, n, 5000)]
    for base, (count, vary) in enumerate(((200, 36), (200, 22), (900, 170))):
        line = plain(count)
        for i in range(20):
            mine = list(line)
            for k in rng.sample(range(3, count), vary // 2):  # two lines differ in up to twice as many places
                mine[k] = f"v{rng.randrange(10**9)}".translate(letters)
            rows.append((100 * base + i, "\n".join([" ".join(plain(9)), " ".join(mine), " ".join(plain(9))])))
    got = lines.drop_recurring_lines(docs_of(spark, rows)).collect()
    dropped = Counter(r["doc_id"] // 100 for r in got if r["_n_dropped"] == 1)
    assert dropped == {0: 19, 1: 19, 2: 19} and {r["doc_id"] for r in got if not r["_n_dropped"]} == {0, 100, 200}
    assert [lines.may_differ(n, 0.8) for n in (3, 4, 5, 9, 10, 159, 160, 200, 1001)] == [0, 0, 1, 1, 2, 31, 32, 40, 200]


def test_wide_leaf_has_one_template_set(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, f"Thanks for reading {name(i)} we hope you like this page") for i in range(5_200)]
    cleaned = lines.drop_recurring_lines(docs_of(spark, rows))
    assert [r["doc_id"] for r in cleaned.where("_n_dropped = 0").collect()] == [0]


def neighbours(rows, k=10):
    """Exact results of the same rules."""
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for q in (i for i in ok if i % 10 == 0):
        near = sorted((float(np.sqrt(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(ok[q], v, strict=True)))), i) for i, v in ok.items() if i != q)
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("leaf", [4_096, 60])
def test_forest(spark, leaf):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.standard_normal(8)]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2001, None), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] * 8), (2005, [1.0]), (None, [1.0] * 8), (3, rows[3][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("level", F.lit(1))
    found = forest.nearest_neighbours(vectors, F.col("vec_id") % 10 == 0, leaf=leaf).collect()
    wanted, got = neighbours(rows), {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got.keys() == wanted.keys() and all(len(got[q]) == 10 for q in got)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in got) / (10 * len(got))
    assert hit >= 0.9
    assert forest.nearest_neighbours(vectors.limit(0), F.lit(True)).count() == 0
    few = forest.nearest_neighbours(vectors.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]


@pytest.mark.parametrize(("rows", "fit_rows"), [(4_000, 20_000), (6_000, 1_500)])
def test_forest_without_structure(spark, rows, fit_rows):
    x = np.random.default_rng(5).standard_normal((rows, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = forest.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, leaf=200, fit_rows=fit_rows).collect()
    got, hit = {}, 0
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, mine in got.items():
        apart = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        apart[q] = np.inf
        hit += len(mine & set(np.argsort(apart)[:10].tolist()))
    assert len(got) == rows // 50 and hit >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_stop_levels(spark, bits):
    """Against a direct count, in leaves of several parts, with a group of near vectors that queries leave deep down."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((600, 8)), 1 + 1e-3 * rng.standard_normal((200, 8))])
    grown = forest.grow(x[::2], len(x), trees=5, leaf=50, probes=50)
    keys, asked, want = grown.keys(x), list(range(0, 800, 20)), 40
    wanted = {}
    for q in asked:
        for level in range(forest.BITS, -1, -1):
            held = 0
            for t, mine in enumerate(keys):
                depth = int(grown.depths[t][np.searchsorted(grown.starts[t], mine[q], side="right") - 1])
                held += sum(int(k) >> (forest.BITS - max(level, depth)) == int(mine[q]) >> (forest.BITS - max(level, depth)) for k in mine)
            if held >= want:
                break
        wanted[q] = level
    indexed = spark.createDataFrame([(i, -1, v) for i, v in enumerate(x.tolist())], "cid long, level int, v array<double>")
    query = indexed.where("cid % 20 = 0").select("cid", "v")
    got = forest.stop_levels(grown, indexed, query, want, common.Scratch(spark), bits).collect()
    assert len(got) == len(asked) and {r["cid"]: r["level"] for r in got} == wanted
    assert max(wanted.values()) > 3


def labelled(seed, n=900):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}" for _ in range(rng.randrange(10, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["zonkest", "zonkery", "zonks", "vilehead"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 > 0), int(bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark):
    rows, labels = labelled(7)
    extra = [(9001, None), (9002, ""), (None, "zonkest"), (9003, "zonks " * 5_000), (1, rows[1][1])]
    scored = toxicity.score_toxicity(docs_of(spark, rows + extra), spark.createDataFrame(labels + [(9001, None, None), (None, 1, 1)], LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored) and len(scored) == len(rows) + 5
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score_toxicity(docs_of(spark, rows[:5]), none).count() == 5 and toxicity.score_toxicity(docs_of(spark, []), none).count() == 0


def test_grammar_context():
    grammar = toxicity.Grammar({"zonk": 3.0, "vile*": 2.0})
    plain, denied, quoted, aimed = (grammar.clause(t.split()) for t in ("a zonk walks", "he is not a zonk", "someone said a zonk walks", "you are a vilehead"))
    assert plain[1] == 3 and plain[2] == 0 and denied[2] == 3 and denied[1] == 0 and quoted[3] == 3 and aimed[4] == 2
    assert grammar.clause("all is well".split()) is None and grammar.clause("i will kill you".split())[5] == 1
    assert grammar.features("nothing here")[0] == 0 and grammar.features("such a zonk. fine")[0] == 1


def read_clause(words, insults):
    """What the composed machines say, read directly: for each word, whether one of the three before it negates it or one before it reports."""
    top, plain, off, told, threat = 0.0, 0.0, 0.0, 0.0, 0.0
    aimed = any(w in toxicity.TARGETS and w not in insults for w in words)
    for i, w in enumerate(words):
        before = [x for x in words[:i] if x not in insults]
        denied = any(x in toxicity.NEGATIONS and x not in insults for x in words[max(0, i - 3) : i])
        quoted = any(x in toxicity.REPORTS for x in before)
        if w in insults:
            top = max(top, insults[w])
            off, told, plain = off + insults[w] * denied, told + insults[w] * (quoted and not denied), plain + insults[w] * (not denied and not quoted)
        elif w in toxicity.THREATS:
            threat += not denied
    return None if top == 0 and not (threat and aimed) else (top, plain, off, told, (plain + off + told) * aimed, threat * aimed)


def test_grammar_equals_direct_reading():
    rng = random.Random(17)
    insults = {"zonk": 3.0, "vile": 2.0, "grotty": 1.5}
    grammar = toxicity.Grammar(insults)
    some = ["zonk", "vile", "grotty", "kill", "beat", "you", "him", "not", "never", "said", "wrote", *(f"word{c}" for c in "abcdefgh")]
    for _ in range(3_000):
        clause = [rng.choice(some) for _ in range(rng.randrange(1, 12))]
        assert grammar.clause(clause) == read_clause(clause, insults)
    for _ in range(300):
        clauses = [[rng.choice(some) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 6))]
        found = [x for c in clauses if (x := read_clause(["".join(a for a in w if a.isalpha()) for w in c], insults))]
        wanted = np.zeros(8)
        if found:
            total = np.sum(found, axis=0)
            wanted[:2], wanted[2:] = (1.0, max(f[0] for f in found) / 3), np.log1p([*total[1:], len(found)])
        assert np.allclose(grammar.features(". ".join(" ".join(c) for c in clauses)), wanted)


def test_entries_equal_a_plain_count(spark):
    rows, labels = labelled(9, 600)
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, LABELS)
    used = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    count, around = {0: Counter(), 1: Counter()}, {}
    for i, text in rows:
        if i in used:
            found = text.split()
            for e, k in toxicity._entries(found).items():
                count[used[i]][e] += 1
                if used[i]:
                    around.setdefault(e, set()).add((found[k - 1] if k else "", found[k + 1] if k + 1 < len(found) else ""))
    toxic = sum(used.values())
    wanted = toxicity.choose(sorted((e, n, count[0][e], len(around[e])) for e, n in count[1].items() if n >= 4), toxic, len(used) - toxic)
    from cantora.llm.common import Scratch

    entries, _ = toxicity.fit(docs, known, Scratch(spark))
    assert wanted and entries == toxicity.SEEDS | wanted


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        text = " ".join(words(rng, 60)) if good else " ".join(f"{w}!!!" for w in words(rng, 12)) * 3 + " buy " * 20
        rows.append((i, text))
        if i < 450:
            labels.append((i, int(good), 0))
    scored = quality.score_quality(docs_of(spark, rows + [(700, None), (701, ""), (None, "x"), (1, rows[1][1])]).withColumn("score", F.lit(0)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(scored) == 604 and all(0 <= r["_quality"] <= 1 for r in scored)
    new = [r for r in scored if r["doc_id"] is not None and 450 <= r["doc_id"] < 600]
    assert sum((r["_quality"] >= quality.CUT) == (r["doc_id"] % 4 > 0) for r in new) >= 0.97 * len(new)
    none = spark.createDataFrame([], LABELS)
    assert [r["_quality"] for r in quality.score_quality(docs_of(spark, rows[:2]), none).collect()] == [1.0, 1.0]


def test_co_training_equals_a_plain_loop(spark):
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        text = " ".join(words(rng, rng.randrange(20, 60)) if good else [f"{w}!!" for w in words(rng, 10)] * 4)
        rows.append((None if i % 41 == 0 else i, text, "en" if good else "xx", f"s{i % 5}", len(text)))
        if i < 120 and i % 41:
            labels.append((i, int(good), 0))
    rows += [rows[200]] * 3 + [(7, "another text of a labelled document", "en", "s1", 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_quality": F.lit(5), "_y": F.lit(6)})
    scored = quality.score_quality(docs, spark.createDataFrame(labels, LABELS))
    assert scored.columns == [*docs.columns, "_quality_"] and scored.where("_quality <> 5 or _y <> 6").count() == 0
    known = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    least = {}
    for i, *row in rows:
        if i in known:
            least[i] = min(least.get(i, row), row)
    view = lambda r: (quality.text_view(r[0]), quality.meta_view(*r[1:]))
    fitted = sorted((known[i], *view(row)) for i, row in least.items())
    mixed = [fitted[k] for k in np.random.default_rng(5).permutation(len(fitted))]
    free = [view(r[1:]) for r in rows if r[0] not in known]
    text, meta = np.array([r[0] for r in free]), np.array([r[1] for r in free])

    def surest(models, layers):
        out = []
        for receiver, mine, other in ((1, text, meta), (0, meta, text)):
            p = quality._sure(models[1 - receiver], layers[1 - receiver], mine)
            for label, q in ((1, p), (0, 1 - p)):
                best = {}
                for k in range(len(free)):
                    if q[k] >= quality.SURE:
                        best[other[k].tobytes()] = max(q[k], best.get(other[k].tobytes(), 0))
                out += [(receiver, label, v, raw) for raw, v in sorted(best.items(), key=lambda x: (-x[1], x[0]))[: quality.PER_ROUND]]
        return sorted(out, key=lambda x: (x[0], -x[1], -x[2], x[3]))

    models, layer = quality.co_train(np.array([r[1] for r in mixed]), np.array([r[2] for r in mixed]), np.array([r[0] for r in mixed]), surest)
    both = np.stack([m.logit(np.array([view(r[1:])[k] for r in rows])) for k, m in enumerate(models)], axis=1)
    wanted = 1 / (1 + np.exp(-np.clip(layer[0] + both @ layer[1:], -30, 30)))
    got = sorted((r["text"], r["_quality_"]) for r in scored.collect())
    assert np.allclose([q for _, q in got], [q for _, q in sorted(zip([r[1] for r in rows], wanted.tolist(), strict=True))], atol=1e-6)


def test_licenses(spark):
    rows = [(1, "first\nReleased under the MIT License.\nlast"), (2, "Released beneath the MIT License, friend"), (3, "no such thing\nlicense fees apply to everyone here today"), (4, None), (5, ""), (None, "All rights reserved."), (6, licenses.TEMPLATES["MIT-text"].replace(" to any person", "\nto any person").replace("publish, distribute", "publish, share")), (1, "first\nReleased under the MIT License.\nlast")]
    found = licenses.scan_licenses(docs_of(spark, rows)).collect()
    got = sorted((r["doc_id"] or 0, r["license"]) for r in found)
    assert got[:3] == [(0, "Proprietary"), (1, "MIT"), (1, "MIT")] and (6, "MIT-text") in got and not any(i == 3 for i, _ in got)
    exact = next(r for r in found if r["doc_id"] == 1)
    assert exact["held"] == 1.0 and exact["differences"] == "" and exact["first_line"] == 1
    assert "distribute -> share" in next(r["differences"] for r in found if r["doc_id"] == 6)
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def found_licenses(text):
    return [(a, b, name) for a, b, name, *_ in licenses.Scanner(licenses.TEMPLATES).scan(text)]


def test_wrapped_notices():
    assert found_licenses("x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n") == [(1, 3, "BSD-3-Clause")]
    assert found_licenses("To the extent possible under law, the author has waived all\ncopyright and related or\nneighboring rights to this work.") == [(0, 2, "CC0-1.0")]
    for name, text in licenses.TEMPLATES.items():
        name, text = (name, text) if name != "SPDX" else ("SPDX-MIT", f"{text} MIT")
        wrapped = "\n".join(" ".join(text.split()[i : i + 6]) for i in range(0, len(text.split()), 6))
        assert [x[2] for x in found_licenses(f"some prose\n{wrapped}\nmore prose")] == [name]


def test_notice_after_a_confirmed_line():
    bsd, apache = licenses.TEMPLATES["BSD-3-Clause"].replace("or without ", "or without\n"), licenses.TEMPLATES["Apache-2.0-notice"]
    assert found_licenses(f"Copyright (c) 2020 X. All rights reserved.\n{bsd}") == [(0, 0, "Proprietary"), (1, 2, "BSD-3-Clause")]
    wrapped = apache.replace("; you may", ";\nyou may").replace("License at ", "License at\n").replace(" Unless", "\nUnless")
    assert found_licenses(f"a\n{apache.split(' (the')[0]}.\nb\n{wrapped}") == [(1, 1, "Apache-2.0"), (3, 6, "Apache-2.0-notice")]


def test_notices_in_one_long_line():
    prose = " ".join(["and this was all that they said of the work in this long page"] * 40)
    two = f"{prose} Released under the MIT License. {prose} {licenses.TEMPLATES['GPL-notice']} {prose} Released under the MIT License. Released under the MIT License. {prose}"
    assert [x[2] for x in found_licenses(two)] == ["MIT", "GPL-notice", "MIT", "MIT"]
    changed = licenses.TEMPLATES["CC-BY-4.0"].replace("This work", "This article")
    assert [x[2] for x in found_licenses(f"{prose} {changed} {prose}")] == ["CC-BY-4.0"]


HEADERS = {
    "MIT-whole-text": f"MIT License\n\nCopyright (c) 2020 Jane Doe\n\n{licenses.MIT_GRANT}\n\n{licenses.MIT_DISCLAIMER}",
    "BSD-2-Clause-text": f"Copyright (c) 2021, Jane Doe\n{licenses.BSD_CONDITIONS}\n\n{licenses.BSD_DISCLAIMER}",
    "BSD-3-Clause-text": f"Copyright (c) 2021, Jane Doe\n{licenses.BSD_CONDITIONS}\n\n{licenses.BSD_THIRD}\n\n{licenses.BSD_DISCLAIMER}",
    "GPL-whole-notice": f"x.py -- does this and that\nCopyright (C) 2019 Jane Doe\n\n{licenses.TEMPLATES['GPL-whole-notice']}",
    "GPL-notice": licenses.TEMPLATES["GPL-notice"],
    "LGPL-whole-notice": f"Copyright (C) 2019 Jane Doe\n\n{licenses.TEMPLATES['LGPL-whole-notice']}",
    "MPL-2.0-notice": licenses.TEMPLATES["MPL-2.0-notice"],
    "Apache-2.0-notice": f"Copyright 2020 Foo Inc.\n\n{licenses.TEMPLATES['Apache-2.0-notice']}",
}


@pytest.mark.parametrize(("columns", "mark"), [(60, ""), (72, "# "), (66, " * "), (76, "// "), (80, "")])
def test_headers_of_files(columns, mark):
    for name, text in HEADERS.items():
        body = "\n".join(mark + x for part in text.split("\n") for x in (textwrap.wrap(part, columns) or [""]))
        assert [x[2] for x in found_licenses(f"import os\n{body}\n\ndef f(): return license\n")] == [name]
    assert found_licenses("All your rights are reserved by us, and the license of the work is lost.") == []


def test_digests_of_chat_query(spark, tmp_path):
    rows = [(5, 0, "user", "a\nb"), (5, 1, "assistant", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op1_chat_prefix_target(spark, str(tmp_path)).collect()}
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\na\nb\nassistant\nc\n").hexdigest() and got[5]["loss_sha256"] == hashlib.sha256(b"c").hexdigest()
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len("</s>[INST] ok [/INST]") and json.dumps(got[5]["formatted_chars"])
