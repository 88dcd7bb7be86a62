"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns a clause's words into symbols (insult, threat, target, negation, report, other) with weights;
three context transducers (negation with a scope of three words, reported speech to the end of the clause, target anywhere in
the clause) are composed with it, and the composed machine scores each matched clause by what it says in which context:
nothing is scored by a word outside its clause. A logistic layer over the clause totals gives the score.

Insult entries (whole words or stems) and their weights are log odds learned from at most ``max_rows`` labelled documents,
taken in the order of a hash of their ids among those whose labels may be used; of these, every entry is counted. An entry must be
significant (G2) and occur in varied surroundings, so that words of copied passages don't count; only significant ones
reach the driver. The logistic layer starts from a prior that gives every
context its meaning and is fitted on the same rows.

Nulls and empties: a null or empty text has no clause and gets the base score; a null doc_id is not held out and its label is
never used; repeated rows are scored each; a document with several labels counts as toxic if one of them says so; without
labels the seed entries and the prior score alone. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, held_out, slices, table, texts

MAX_ROWS = 8_000
#: Different surroundings that are always enough, and of how many each task keeps count.
VARIED, AROUND = 48, 64
LEAST_DOCS, LEAST_ODDS, LEAST_SHARE = 4, 1.5, 0.7
CUT = 0.7
#: Seed entries, in English, German, French and Spanish.
THREATS = "kill murder hurt beat shoot stab strangle burn töten umbringen schlagen erschießen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your youre u he she they him her them du dich dir ihr euch sie er tu te toi vous il elle ils elles tú ti usted ustedes él ella ellos ellas".split()
NEGATIONS = "not no never none nobody without nicht kein keine nie niemals ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = "said says say told wrote writes quoted claimed called according sagte sagt schrieb dit disait écrit selon dijo dice escribió según".split()
SEEDS = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "dummkopf": 3.0, "arschloch": 4.0, "connard": 4.0, "imbécile": 3.0, "gilipollas": 4.0, "estúpido": 3.0}

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:|\n]+")
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")

Machine = dict[tuple, dict[str, tuple[tuple, tuple]]]


def negation(scope: int = 3) -> Machine:
    """Counts down the words that a negation reaches; outputs whether it reaches this one."""
    return {(n,): {s: ((scope if s == "negation" else max(n - 1, 0),), (n > 0,)) for s in SYMBOLS} for n in range(scope + 1)}


def reported() -> Machine:
    return {(n,): {s: ((int(n or s == "report"),), (n > 0,)) for s in SYMBOLS} for n in (0, 1)}


def targeted() -> Machine:
    return {(n,): {s: ((int(n or s == "target"),), ()) for s in SYMBOLS} for n in (0, 1)}


def compose(one: Machine, two: Machine) -> Machine:
    """Both machines reading the same symbols; states and outputs are put side by side."""
    return {p + q: {s: (one[p][s][0] + two[q][s][0], one[p][s][1] + two[q][s][1]) for s in SYMBOLS} for p in one for q in two}


class Grammar:
    """Entries: words or, with a final ``*``, stems, each with its weight."""

    def __init__(self, entries: dict[str, float]):
        import ahocorasick

        self.words = {e: w for e, w in entries.items() if e[-1] != "*"}
        self.stems = {e[:-1]: w for e, w in entries.items() if e[-1] == "*"}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.fixed = {w: s for s, group in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in group}
        self.machine = compose(compose(negation(), reported()), targeted())
        self.start = (0, 0, 0)
        self.finder = ahocorasick.Automaton()
        for e in {*self.words, *self.stems, *THREATS}:
            self.finder.add_word(e, e)
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return "insult", self.words[word]
        for n in self.lengths:
            if word[:n] in self.stems:
                return "insult", self.stems[word[:n]]
        return self.fixed.get(word, "other"), 1.0

    def clause(self, words: list[str]) -> tuple[float, ...] | None:
        """Largest weight, then sums: plain, negated, reported, with a target, threat to a target. None: nothing matched."""
        state, top, plain, off, told, threat = self.start, 0.0, 0.0, 0.0, 0.0, 0.0
        for word in words:
            s, weight = self.symbol(word)
            state, (denied, quoted) = self.machine[state][s]
            if s == "insult":
                top = max(top, weight)
                off, told, plain = off + weight * denied, told + weight * (quoted and not denied), plain + weight * (not denied and not quoted)
            elif s == "threat":
                threat += weight * (not denied)
        aimed = state[-1]
        if top == 0 and not (threat and aimed):
            return None
        return top, plain, off, told, (plain + off + told) * aimed, threat * aimed

    def features(self, text: str) -> np.ndarray:
        low, out = text.lower(), np.zeros(len(PRIOR))
        hits = sorted(end - len(e) + 1 for end, e in self.finder.iter(low) if end < len(e) or not low[end - len(e)].isalpha())
        if not hits:
            return out
        at, begin, matched = 0, 0, []
        for stop in [*(m.span() for m in _CLAUSE.finditer(low)), (len(low), len(low))]:
            if at < len(hits) and hits[at] < stop[0]:
                if found := self.clause(_WORD.findall(low, begin, stop[0])):
                    matched.append(found)
                while at < len(hits) and hits[at] < stop[0]:
                    at += 1
            begin = stop[1]
        if matched:
            total = np.sum(matched, axis=0)
            out[0], out[1] = 1.0, max(m[0] for m in matched) / 3
            out[2:] = np.log1p([*total[1:], len(matched)])
        return out


#: Of: a match, largest weight, plain, negated, reported, with a target, threat, clauses. Base first.
PRIOR = np.array([1.0, 1.0, 0.5, -0.3, -0.3, 0.3, 1.5, 0.0])
BASE = -2.5


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.5, steps: int = 30) -> np.ndarray:
    """Newton's method with a normal prior of that mean and precision."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (y - p) - strength * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _entries(words: list[str]) -> dict[str, int]:
    """Entry -> place of the first word of a document that it matches."""
    first: dict[str, int] = {}
    for i, w in enumerate(words):
        if w not in first:
            first[w] = i
            for n in range(3, min(len(w), 8)):
                first.setdefault(w[:n] + "*", i)
    return first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, toxic and clean documents, and surroundings in toxic ones from rows (text, toxic).

    At most AROUND of an entry and task are held, which is more than an entry needs, so no decision depends on it."""
    count, around = {True: Counter(), False: Counter()}, defaultdict(set)
    for batch in batches:
        for text, toxic in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall(text.lower())
            for e, i in _entries(words).items():
                count[toxic > 0][e] += 1
                if toxic > 0 and len(around[e]) < AROUND:
                    around[e].add(hash_pair(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    every = list(count[True] | count[False])
    columns = [pa.array(every, pa.string()), *(pa.array([count[t][e] for e in every], pa.int64()) for t in (True, False)), pa.array([sorted(around.get(e, ())) for e in every], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, ["entry", "a", "b", "around"])


def hash_pair(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{a}\n{b}") >> 1


def choose(counts: list[tuple[str, int, int, int]], toxic: int, clean: int, least: float = 24.0) -> dict[str, float]:
    """Significant entries of (entry, toxic documents, clean documents, distinct surroundings), the most specific of each stem."""

    def g2(a: int, b: int) -> float:
        total, share = a + b, toxic / max(toxic + clean, 1)
        return 2 * sum(o * math.log(o / e) for o, e in ((a, total * share), (b, total * (1 - share))) if o)

    def odds(a: int, b: int) -> float:
        return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))

    good = {e: (a, b) for e, a, b, around in counts if odds(a, b) > LEAST_ODDS and a >= LEAST_SHARE * (a + b) and g2(a, b) >= least and around >= min(0.75 * a, VARIED)}
    below = defaultdict(list)
    for e in good:
        for n in range(3, len(e.rstrip("*")) + 1):
            below[e[:n]].append(e)
    chosen: dict[str, float] = {}
    taken: set[str] = set()
    for e in sorted(good, key=lambda e: (-g2(*good[e]), e)):
        stem = e.rstrip("*")
        if e in taken or any(stem[:n] + "*" in chosen for n in range(3, len(stem))):
            continue
        if e[-1] == "*" and sum(good[x][0] for x in below[stem] if x in chosen) >= 0.7 * good[e][0]:
            continue
        best = max((x for x in below[stem] if good[x][0] >= 0.95 * good[e][0] and (e[-1] == "*" or x == e)), key=lambda x: (len(x.rstrip("*")), x[-1] != "*"))
        chosen[best] = min(odds(*good[best]), 6.0)
        taken.update(below[stem])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = MAX_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Entries and the logistic layer (base first), from labels of documents that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_rows rows at most
    sample = scratch.keep(sample.select("text", F.col("toxic").cast("int").alias("toxic")).repartition(12), "sample")
    size = {int(t > 0): n for t, n in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    entries: dict[str, float] = {}
    if toxic and clean:
        found = sample.mapInArrow(_counts, "entry string, a long, b long, around array<long>")
        found = found.groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.size(F.array_distinct(F.flatten(F.collect_list("around")))).alias("around"))
        odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
        # what choose() asks of each entry by itself
        found = found.where((F.col("a") >= LEAST_DOCS) & (odds > LEAST_ODDS - 1e-9) & (F.col("a") >= LEAST_SHARE * (F.col("a") + F.col("b")) - 1e-9) & (F.col("around") >= F.least(0.75 * F.col("a"), F.lit(VARIED))))
        entries = choose(sorted((r["entry"], r["a"], r["b"], r["around"]) for r in found.collect()), toxic, clean)
    entries = SEEDS | entries
    prior = np.array([BASE, *PRIOR])
    rows = sample.mapInArrow(_features(entries), "toxic int, x array<double>").collect()  # max_rows rows of nine numbers
    if toxic and clean:
        x = np.array([[1.0, *r["x"]] for r in rows])
        return entries, fit_logistic(x, np.array([float(r["toxic"] > 0) for r in rows]), prior)
    return entries, prior


def _features(entries: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(entries)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([grammar.features(t).tolist() for t in texts(batch)], pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _score(entries: dict[str, float], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(entries)
        for batch in slices(batches):
            x = np.array([grammar.features(t) for t in texts(batch)])
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x[:, -1])], ["doc_id", "score", "clauses"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and clauses (log1p of the matched clauses) for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries, weights = fit(docs, labels.select("doc_id", "toxic"), Scratch(docs.sparkSession), max_rows)
    scored = docs.mapInArrow(_score(entries, weights), "doc_id long, score double, clauses double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "clauses")


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity_grammar": op2_toxicity_grammar}
SQL: dict[str, str] = {}
