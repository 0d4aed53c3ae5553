"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause as a string of symbols: insult, threat, target, negation, report or other.
Small transducers rewrite that string one after the other: the first marks what stands inside
reported speech, the second what a negation precedes, the third what is aimed at a target, the last emits
one pattern for each insult and each threat. ``compose`` folds them into one deterministic
transducer, so a clause costs one table step per word, and only clauses that hold an insult or threat are
read at all. A document's score is the logistic of the weights of the patterns it holds.

Words of the insult class are learned from labelled rows: features (whole words and word beginnings) that
mark the toxic class are chosen by covering, each for toxic documents that too few earlier ones explain.
Near copies share a min-hash and count once, so the rare words of one much copied document don't enter.
The weight of each pattern is fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from celltide.llm.text import whole
from celltide.runtime import checkpoint

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "target", "negation", "report"
#: Closed word classes of the grammar, in the languages of the corpus; insults are learned.
THREATS = "kill hurt destroy murder strangle töten umbringen schlagen tuer frapper détruire matar golpear destruir"
TARGETS = "you your yours u they them he she him her du dich dir ihr euch sie tu te toi vous ils elle lui tú ti usted ustedes vosotros"
NEGATIONS = "not no never neither nicht kein keine nie ne pas jamais ni nunca jamás isn't aren't don't"
REPORTS = "said says told called wrote quoted claims sagte sagt schrieb nannte dit disait écrit dijo dice escribió"
#: Most labelled rows to learn from (a hash order picks them), least toxic documents behind a feature as a number
#: and as a share of all toxic ones, least log-odds, features that explain a document in full.
TRAIN_ROWS, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, EXPLAINED = 20_000, 4, 0.01, 3.0, 3
#: Toxic documents that a clean one with the feature outweighs.
CLEAN_COST = 10
#: Lengths of word beginnings that may become features.
STEMS = (4, 5, 6)
#: Words over which a negation reaches.
REACH = 3
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„]")
CLAUSE_END = re.compile(r"[.!?;:\n\r]")
QUOTES = set("\"“”«»„")


@dataclass
class Transducer:
    """``arcs[state, symbol] = (next state, output)``; a symbol without an arc is copied and keeps the state."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(machines: Sequence[Transducer], symbols: Sequence[str]) -> tuple[list[dict[str, tuple[int, str]]], list[str]]:
    """One transducer that does what the given ones do one after the other: a table of steps by state number."""
    first = tuple(m.start for m in machines)
    number, table, todo, outputs = {first: 0}, [{}], [first], set()
    while todo:
        states = todo.pop()
        for symbol in symbols:
            after, out = [], symbol
            for machine, state in zip(machines, states):
                state, out = machine.step(state, out)
                after.append(state)
            key = tuple(after)
            if key not in number:
                number[key] = len(table)
                table.append({})
                todo.append(key)
            table[number[states]][symbol] = (number[key], out)
            outputs.add(out)
    return table, sorted(o for o in outputs if "insult" in o or "threat" in o)


def grammar() -> tuple[list[dict[str, tuple[int, str]]], list[str]]:
    """The composed transducer over plain symbols, and the patterns it can emit."""
    hits = (INSULT, THREAT)
    report = Transducer("open")
    report.arcs["open", REPORT] = ("said", REPORT)
    report.arcs |= {("said", h): ("said", f"reported {h}") for h in hits}
    hits = (*hits, *(f"reported {h}" for h in hits))
    negation = Transducer("0")
    for left in range(REACH + 1):
        negation.arcs[str(left), NEGATION] = (str(REACH), NEGATION)
        if left:
            negation.arcs |= {(str(left), s): (str(left - 1), s) for s in (OTHER, TARGET, REPORT)}
            negation.arcs |= {(str(left), h): (str(left - 1), f"negated {h}") for h in hits}
    hits = (*hits, *(f"negated {h}" for h in hits))
    target = Transducer("none", {("none", TARGET): ("aimed", TARGET)})
    target.arcs |= {("aimed", h): ("aimed", f"aimed {h}") for h in hits}
    return compose([report, negation, target], [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT])


class Matcher:
    """Finds the grammar's patterns in texts, for a lexicon of insult words and word beginnings (``stem*``)."""

    def __init__(self, insults: Sequence[str]):
        self.table, self.patterns = grammar()
        self.place = {p: i for i, p in enumerate(self.patterns)}
        self.classes = {}
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.classes |= dict.fromkeys(words.split(), symbol)
        self.whole = {w for w in insults if not w.endswith("*")}
        self.stems = {w[:-1] for w in insults if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.finder = ahocorasick.Automaton()
        for word in {*self.whole, *self.stems, *THREATS.split()}:
            self.finder.add_word(word, len(word))
        if len(self.finder):
            self.finder.make_automaton()

    def symbol(self, word: str) -> str:
        if word in self.whole or any(word[:n] in self.stems for n in self.lengths if len(word) >= n):
            return INSULT
        return REPORT if word in QUOTES else self.classes.get(word, OTHER)

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses that hold the letters of an insult or threat at the start of a word."""
        if not len(self.finder):
            return
        done = 0
        for last, length in self.finder.iter(text):
            first = last - length + 1
            if first < done or first and text[first - 1].isalnum():
                continue
            begin = done
            for m in CLAUSE_END.finditer(text, done, first):  # each stretch once, as done moves past it
                begin = m.end()
            end = m.start() if (m := CLAUSE_END.search(text, last + 1)) else len(text)
            yield text[begin:end]
            done = end

    def matches(self, text: str) -> int:
        """Bit set of the patterns that the text holds."""
        found = 0
        for clause in self.clauses(text.lower()):
            state = 0
            for word in WORDS.findall(clause):
                state, out = self.table[state][self.symbol(word)]
                if out in self.place:
                    found |= 1 << self.place[out]
        return found


def words_of(text: Column) -> Column:
    """Distinct lower-cased words of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+")), "")


def _stems(words: Column, length: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > length)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, length), F.lit("*")))


def _features(text: Column) -> Column:
    words = words_of(text)
    return F.array_distinct(F.concat(words, *[_stems(words, n) for n in STEMS]))


def learn_lexicon(train: DataFrame) -> list[str]:
    """Words and stems that explain the toxic rows of ``(text, toxic)``, chosen by covering.

    A group is the rows that share the least hash of their longer words; a feature counts once per group.
    A feature with n toxic groups may close no more than ``EXPLAINED`` times the same group.
    """
    group = F.array_min(F.transform(F.filter(words_of(F.col("text")), lambda w: F.length(w) > 5), lambda w: F.xxhash64(w)))
    rows = checkpoint(train.select(
        "toxic", F.coalesce(group, F.xxhash64("text")).alias("group"), _features(F.col("text")).alias("features"),
    ))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count_distinct("group").alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos:
        return []
    least = max(LEAST_DOCS, n_pos * LEAST_SHARE)
    toxic = rows.filter("toxic = 1").select("group", F.explode("features").alias("feature")).distinct()
    common = checkpoint(toxic.groupBy("feature").agg(F.count("*").alias("pos")).filter(F.col("pos") >= least))
    clean = rows.filter("toxic = 0").select("group", F.explode("features").alias("feature"))
    clean = clean.join(common, "feature").groupBy("feature").agg(F.count_distinct("group").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    marked = common.join(clean, "feature", "left").fillna(0, ["neg"]).filter(odds >= LEAST_ODDS)
    # at most the groups of train_rows rows for features that a hundredth of them have
    explains = toxic.join(marked, "feature").groupBy("feature", "neg").agg(F.collect_set("group").alias("groups"))
    open_ = {r["feature"]: (set(r["groups"]), r["neg"]) for r in explains.collect()}
    lexicon: list[str] = []
    times: dict[int, int] = {}
    while open_:
        # of features that explain as much, the more specific: a whole word before a stem, a long stem before a short one
        best = max(sorted(open_), key=lambda f: (len(open_[f][0]) - CLEAN_COST * open_[f][1], not f.endswith("*"), len(f)))
        groups, neg = open_.pop(best)
        if len(groups) - CLEAN_COST * neg < least:
            break
        lexicon.append(best)
        for g in groups:
            times[g] = times.get(g, 0) + 1
        closed = {g for g in groups if times[g] >= EXPLAINED}
        stem = best.rstrip("*")
        open_ = {
            f: (left, n) for f, (r, n) in open_.items()
            if len(left := r - closed) >= least and not (best.endswith("*") and f.startswith(stem))
        }
    return lexicon


def fit_weights(vectors: Sequence[tuple[int, int, int]], patterns: Sequence[str], strength: float = 0.05) -> tuple[float, np.ndarray]:
    """Bias and pattern weights by ridge logistic regression on ``(bit set, clean rows, toxic rows)``.

    The ridge pulls towards what the grammar says of a pattern without examples: an insult or threat
    counts for toxic, less so where it is negated or reported, more so where it is aimed.
    """
    prior = np.array([-3.0, *[4.0 - 1.5 * p.count("negated") - 1.5 * p.count("reported") + p.count("aimed") for p in patterns]])
    if not len(vectors):
        return float(prior[0]), prior[1:]
    x = np.array([[1.0, *[float(bits >> i & 1) for i in range(len(patterns))]] for bits, _, _ in vectors])
    clean, toxic = (np.array([v[k] for v in vectors], dtype=float) for k in (1, 2))
    n, w, ridge = clean + toxic, prior.copy(), np.full(len(prior), strength)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (toxic - n * p) - ridge * (w - prior)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(ridge), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


@dataclass
class Model:
    lexicon: list[str]
    bias: float
    weights: list[float]


def _patterns(text: Column, lexicon: list[str]) -> Column:
    @F.pandas_udf("long")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pd.Series([matcher.matches(t) for t in batch], dtype="int64")

    return bits(whole(text))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text divisible by 5, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn lexicon and pattern weights from at most ``train_rows`` labelled rows that are not held out.

    Repeated labels of a document count once, as toxic if any says so; null labels don't count. Without
    labels the lexicon is empty and the weights are those of the grammar.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = checkpoint(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    # at most train_rows rows of two numbers
    train = checkpoint(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic"))
    lexicon = learn_lexicon(train)
    vectors = train.select("toxic", _patterns(F.col("text"), lexicon).alias("bits")).groupBy("bits").agg(
        F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"),
    ).orderBy("bits").collect()
    bias, weights = fit_weights([tuple(v) for v in vectors], grammar()[1])
    return Model(lexicon, bias, weights.tolist())


def score(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), from whole texts; null counts as empty.

    An empty text has the score of a text without any pattern. The two names replace columns of the same name.
    """
    docs = docs.drop("score", "predicted")
    held = F.lit(model.bias)
    for i, w in enumerate(model.weights):
        held = held + F.when(F.get(F.col("_has"), F.lit(i)) == 1, w).otherwise(0.0)
    bits = docs.withColumn("_bits", _patterns(F.col(column), model.lexicon)).withColumn(
        "_has", F.transform(F.sequence(F.lit(0), F.lit(len(model.weights) - 1)), lambda i: F.call_function("bit_get", F.col("_bits"), i).cast("int")),
    )
    return bits.withColumn("score", 1 / (1 + F.exp(-held))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"),
    ).drop("_bits", "_has")
