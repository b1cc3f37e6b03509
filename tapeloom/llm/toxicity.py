"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import slices, table
from tapeloom.llm.labels import held_out, training_texts
from tapeloom.storage import cut

#: Labelled rows that the lexicon and the calibration are learned from, at most.
MAX_TRAIN_ROWS = 8_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: How many times likelier in toxic texts a word must be, at least.
MIN_ODDS = 4.0
CACHE_TOKENS = 300_000

TOKEN = re.compile(r"\w+|[.!?;:\n]")
CLAUSE_ENDS = frozenset(".!?;:\n")

#: Closed word classes of the grammar.
SEED_INSULTS = frozenset("idiot moron stupid scum loser pathetic worthless disgusting trash imbécile idiota estúpido dummkopf".split())
THREATS = frozenset("kill hurt destroy beat burn stab shoot hunt tuer frapper töten schlagen matar golpear".split())
TARGETS = frozenset("you your u yourself they them he she him her people tu toi vous te du dich sie euch ihr tú usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never isn aren wasn weren don doesn didn cannot ne pas jamais nicht kein keine nie nunca jamás".split())
REPORTS = frozenset("said says say called calls claimed wrote quoted alleged dit écrit sagte schrieb dijo escribió".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol); a missing arc copies the symbol and stays."""

    arcs: dict
    start: int = 0

    def step(self, state: int, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def _negation(reach: int = 3) -> Transducer:
    """A negation weakens insults and threats among the next ``reach`` words."""
    arcs = {(s, "negation"): (reach, "negation") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, y) for x, y in (("insult", "insult-negated"), ("threat", "threat-negated"), ("other", "other"), ("target", "target"), ("report", "report"))}
    return Transducer(arcs)


def _threat(reach: int = 2) -> Transducer:
    """A threat is aimed at a target among the next ``reach`` words, its object; one before it is who acts."""
    arcs = {(s, "threat"): (reach, "threat") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, "target"): (0, "threat-aimed")} | {(s, x): (s - 1, x) for x in ("other", "report", "negation")}
    return Transducer(arcs)


#: Each reads what the one before writes.
GRAMMAR = {
    # who is named before an insult is insulted
    "target": Transducer({(0, "target"): (1, "target"), (1, "insult"): (1, "insult-aimed")}),
    "threat": _threat(),
    "insult": Transducer({(0, "insult"): (1, "insult"), (1, "insult"): (1, "insult-again"), (0, "insult-aimed"): (1, "insult-aimed")}),
    "reported": Transducer({(0, "report"): (1, "report")} | {(1, x): (1, f"{x}-reported") for x in ("insult", "insult-aimed", "insult-again", "threat-aimed")}),
}

#: What a matched symbol adds, in units of its word's weight, before anything is learned.
WEIGHTS = {
    "insult": 1.0, "insult-again": 1.0, "insult-aimed": 1.3, "insult-negated": 0.6, "threat": 0.0, "threat-aimed": 1.0, "threat-negated": 0.0,
    "insult-reported": 0.7, "insult-aimed-reported": 0.8, "insult-again-reported": 0.7, "threat-aimed-reported": 0.5,
}

NAMES = {OTHER: "other", INSULT: "insult", THREAT: "threat", TARGET: "target", NEGATION: "negation", REPORT: "report"}


#: The order of the sums by symbol.
SYMBOLS = tuple(WEIGHTS)


def compose(machines: list[Transducer]) -> tuple[list[list[int]], list[list[str]]]:
    """The cascade as one machine: next state and written symbol by state and word class."""
    start = tuple(m.start for m in machines)
    number, queue = {start: 0}, [start]
    moves, written = [], []
    for state in queue:
        row, symbols = [], []
        for c in range(len(NAMES)):
            symbol, to = NAMES[c], []
            for m, s in zip(machines, state, strict=True):
                s2, symbol = m.step(s, symbol)
                to.append(s2)
            to = tuple(to)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
            symbols.append(symbol)
        moves.append(row)
        written.append(symbols)
    return moves, written


def cascade() -> list[Transducer]:
    # negation first: a negated insult is neither aimed nor counted again
    return [_negation(), GRAMMAR["target"], GRAMMAR["threat"], GRAMMAR["insult"], GRAMMAR["reported"]]


@dataclass
class Lexicon:
    """Weights of whole words and of stems (word beginnings)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def classify(self, token: str) -> tuple[int, float]:
        if (w := self.words.get(token)) is not None:
            return (INSULT, w) if w else (OTHER, 0.0)
        for n in reversed(STEM_LENGTHS):  # the longest stem says most
            if len(token) > n and (w := self.stems.get(token[:n])) is not None:
                return (INSULT, w) if w else (OTHER, 0.0)
        for c, words in ((THREAT, THREATS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS)):
            if token in words:
                return c, 1.0
        return OTHER, 0.0


class Scorer:
    """Weights of the clauses that match in a whole text: (their sum, the heaviest, words)."""

    def __init__(self, lexicon: Lexicon, weights: dict | None = None):
        self.lexicon = lexicon
        self.moves, self.written = compose(cascade())
        weights = WEIGHTS if weights is None else weights
        self.gains = [[weights.get(x, 0.0) for x in row] for row in self.written]
        self.known: dict[str, tuple[int, float]] = {}

    def tokens(self, text: str) -> tuple[list[str], bool]:
        """The words and clause ends of a text, and whether any of them can match."""
        tokens = TOKEN.findall(text.lower())
        distinct = set(tokens)
        if len(self.known) > CACHE_TOKENS:
            self.known.clear()
        known = self.known
        for t in distinct.difference(known):
            known[t] = (-1, 0.0) if t in CLAUSE_ENDS else self.lexicon.classify(t)
        return tokens, any(known[t][0] in (INSULT, THREAT) for t in distinct)

    def __call__(self, text: str) -> tuple[float, float, int]:
        tokens, matches = self.tokens(text)
        if not matches:
            return 0.0, 0.0, len(tokens)
        known, total, most, clause, state = self.known, 0.0, 0.0, 0.0, 0
        for t in tokens:
            c, w = known[t]
            if c < 0:
                total, most = total + clause, max(most, clause)
                clause, state = 0.0, 0
                continue
            clause += self.gains[state][c] * w
            state = self.moves[state][c]
        return total + clause, max(most, clause), len(tokens)

    def parts(self, text: str) -> tuple[list[float], int]:
        """What the words of each of ``SYMBOLS`` weigh in the text, and its words."""
        tokens, matches = self.tokens(text)
        sums, state = dict.fromkeys(SYMBOLS, 0.0), 0
        for t in tokens if matches else ():
            c, w = self.known[t]
            if c < 0:
                state = 0
                continue
            if (x := self.written[state][c]) in sums:
                sums[x] += w
            state = self.moves[state][c]
        return list(sums.values()), len(tokens)


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Words and stems that the toxic texts alone use, by a likelihood-ratio test.

    A use of a word, told by its two neighbours, counts for the smallest
    doc_id that has it. So copies of one text count once, and so does a word
    that one text repeats. The counts of every word and stem of the training
    texts are made on the executors; only features that pass reach the driver.
    There is no limit but the test: as the training texts are bounded in rows
    and bytes, so are the features that several of them share.
    """
    gap = r"[^\p{L}\p{N}_]+"
    t = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), gap), lambda w: w != "")
    rows = texts.select("doc_id", (F.col("label") == 1).alias("bad"), t.alias("t"))
    use = F.transform("t", lambda w, i: F.struct(w.alias("word"), F.xxhash64(F.get("t", i - 1), F.get("t", i + 1)).alias("context")))
    rows = rows.select("doc_id", "bad", F.explode(use).alias("k")).groupBy("bad", "k.word", "k.context").agg(F.min("doc_id").alias("doc_id"))
    uses = cut(rows.select("word", "bad", "doc_id").distinct())
    tally = (F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    words = cut(uses.groupBy("word").agg(*tally))
    bad, good, n = words.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    if not bad or not good:
        return Lexicon(dict.fromkeys(SEED_INSULTS, 1.0))
    q = bad / (bad + good)
    every = F.col("bad") + F.col("good")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / every / F.lit(p))).otherwise(0.0)
    gain = part("bad", q) + part("good", 1 - q)
    odds = F.col("bad") / (F.col("good") + 0.5) * F.lit((1 - q) / q)
    sure = (odds >= MIN_ODDS) & (gain > math.log(3 * n))
    passed = lambda df: sorted(df.where(sure).collect(), key=lambda r: r.feature)
    stems = F.explode(F.array(*[F.substring("word", 1, k) for k in STEM_LENGTHS])).alias("feature")
    # a stem stands for several words, else its word does
    kinds = words.where("bad > 0").select(stems, "word").where("word <> feature").groupBy("feature").count().where("count >= 4")
    stems = uses.select(stems, "word", "bad", "doc_id").where("word <> feature").select("feature", "bad", "doc_id").distinct()
    stems = stems.groupBy("feature").agg(*tally).join(kinds, "feature")
    weight = lambda r: min(2.0, math.log((r.bad + 0.5) / (r.good + 0.5) * (1 - q) / q) / 2)
    found = Lexicon({r.feature: weight(r) for r in passed(words.withColumnRenamed("word", "feature"))})
    chosen = {r.feature: r for r in passed(stems)}
    for f, r in chosen.items():
        if not any(g != f and g.startswith(f) and x.bad >= 0.9 * r.bad and x.good >= 0.9 * r.good for g, x in chosen.items()):
            found.stems[f] = weight(r)
    # words that clean texts use as well say nothing, whatever their stem or the seeds say
    common = words.where((odds < MIN_ODDS / 2) & (every >= 5)).select("word")
    learned = texts.sparkSession.createDataFrame([(x,) for x in sorted(found.stems)], "feature string")
    begins = common.select("word", F.explode(F.array(*[F.substring("word", 1, k) for k in STEM_LENGTHS])).alias("feature"))
    doubtful = begins.join(learned, "feature", "left_semi").select("word").union(common.where(F.col("word").isin(*SEED_INSULTS)))
    for r in doubtful.distinct().collect():
        found.words[r.word] = 0.0
    for w in SEED_INSULTS - found.words.keys():
        found.words[w] = 1.0
    return found


def score_sums(docs: DataFrame, lexicon: Lexicon, weights: dict, with_label: bool = False) -> DataFrame:
    """(doc_id, label if asked for, total, most, tokens) of every row."""
    keep = ["doc_id", *(["label"] if with_label else [])]

    def scan(batches):
        import pyarrow as pa

        score = Scorer(lexicon, weights)
        for b in slices(batches):
            got = [score(t.as_py() or "") for t in b.column(0)]
            total, most, tokens = ([x[k] for x in got] for k in range(3))
            yield pa.record_batch([*b.columns[1:], pa.array(total, pa.float64()), pa.array(most, pa.float64()), pa.array(tokens, pa.int64())], names=[*keep, "total", "most", "tokens"])

    kinds = ", ".join("doc_id long" if k == "doc_id" else "label int" for k in keep)
    rows = docs.select("text", *[F.col(k).cast("long" if k == "doc_id" else "int") for k in keep])
    return rows.mapInArrow(scan, f"{kinds}, total double, most double, tokens long")


#: What the calibration sees of a text; as many coefficients and a constant.
def _evidence(total, most, tokens, log1p):
    return [log1p(total), log1p(most), log1p(100.0 * total / (tokens + 20.0))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Coefficients by Newton steps, and the loss with its ridge."""
    w = np.zeros(x.shape[1])
    pull = np.diag([1e-6] + [ridge] * (len(w) - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull, x.T @ (y - p) - pull @ w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    z = np.clip(x @ w, -30, 30)
    return w, float(np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ pull @ w)


def calibrated(sample: pd.DataFrame, ridge: float = 0.05, rounds: int = 50) -> list[float]:
    """Logistic regression: constant and coefficients."""
    x = np.column_stack([np.ones(len(sample)), *_evidence(sample["total"], sample["most"], sample["tokens"], np.log1p)])
    return [float(v) for v in _logistic(x, sample["label"].to_numpy(float), ridge, rounds)[0]]


def learned_weights(parts: np.ndarray, tokens: np.ndarray, y: np.ndarray, pull: float = 2.0) -> dict:
    """Weights of the symbols that explain the training labels best.

    ``parts`` has the sums by symbol of each text. One weight after the other
    is moved in steps of a factor, twice around, as long as the loss of the
    text scores falls by more than the ``pull`` towards its start asks: so a
    symbol that the training texts hardly use keeps its weight.
    """
    start = np.array([max(w, 0.02) for w in WEIGHTS.values()])
    moved = np.zeros(len(start))

    def loss(m):
        total = parts @ (start * 2.0**m)
        x = np.column_stack([np.ones(len(y)), np.log1p(total), np.log1p(100.0 * total / (tokens + 20.0))])
        return _logistic(x, y, 0.05, 15)[1] + pull * float(m @ m)

    best = loss(moved)
    for k in [*range(len(start))] * 2:
        if not parts[:, k].any():
            continue
        for step in (0.5, -0.5):
            while abs(moved[k] + step) <= 4:
                tried = moved.copy()
                tried[k] += step
                if (now := loss(tried)) >= best:
                    break
                best, moved = now, tried
    return {x: 0.0 if not moved[k] and not WEIGHTS[x] else float(start[k] * 2.0 ** moved[k]) for k, x in enumerate(SYMBOLS)}


def symbol_sums(texts: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums by symbol, words, label) of the training texts, a few numbers for each."""

    def scan(batches):
        import pyarrow as pa

        parts = Scorer(lexicon).parts
        for b in slices(batches):
            got = [parts(t.as_py() or "") for t in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([x for x, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.int64())], names=["doc_id", "label", "sums", "tokens"])

    rows = texts.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(scan, "doc_id long, label int, sums array<double>, tokens long")
    rows = sorted(rows.collect())
    return np.array([r.sums for r in rows]).reshape(-1, len(SYMBOLS)), np.array([r.tokens for r in rows], float), np.array([r.label for r in rows], float)


#: For a corpus without usable labels: any whole insult is toxic.
PRIOR = [-2.0, 2.0, 2.0, 0.0]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    The lexicon, the weights of words and of the grammar's symbols and the
    calibration come from labelled rows outside the held-out fold. Null and empty texts hold no clause and score
    low. Repeated rows get equal scores; an empty table gives no rows; without
    usable labels the seed lexicon stands alone.
    """
    texts = cut(training_texts(docs, labels, "toxic", MAX_TRAIN_ROWS))
    lexicon = learn_lexicon(texts)
    parts, tokens, y = symbol_sums(texts, lexicon)
    weights = learned_weights(parts, tokens, y) if len(set(y)) > 1 else WEIGHTS
    sample = score_sums(texts, lexicon, weights, with_label=True).drop("doc_id").toPandas()  # at most MAX_TRAIN_ROWS rows of four numbers
    w = calibrated(sample) if sample["label"].nunique() > 1 else PRIOR
    found = score_sums(docs, lexicon, weights)
    x = F.lit(w[0])
    for k, e in zip(w[1:], _evidence(F.col("total"), F.col("most"), F.col("tokens"), F.log1p), strict=True):
        x = x + k * e
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))
    found = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
