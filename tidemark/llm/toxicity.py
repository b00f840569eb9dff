"""Operator 10, toxicity: Levenshtein automata intersected with a lexicon trie, and context windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive import sigmoid
from .common import crc_mod, labelled_texts, small_batches, table, written

#: Labelled rows that the lexicon and the weights are learned from, at most.
SAMPLE = 12_000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: A term's documents among the toxic ones, at least.
MIN_DOCS = 4
#: A term's log odds, at least.
MIN_ODDS = 4.0
#: Edits that a misspelling may have, from words of this length on. Of shorter terms one letter may be a look-alike.
EDITS, FUZZY_FROM = 1, 5
#: Share of a term's weight that a misspelling of it has, and a spelling with other signs for letters or between them.
FUZZY_WEIGHT, DISGUISED_WEIGHT = 0.7, 0.9
#: Lengths of stems: a term may also be the beginning of longer words, written with a star, if toxic documents have so many different ones.
STEMS, MIN_FORMS = (4, 5, 6), 3
#: Words before a term that are looked at for signs of quotation.
CONTEXT = 10
#: Quotation marks, and verbs that report another's words.
QUOTES = '"“”„«»‹›'
REPORTING = frozenset("said says say called calls wrote writes quoted quote quotes term word reported".split())
LETTERS = re.compile(r"[^\W\d_]+")
#: What is left of a token without punctuation at its ends, for words in which signs stand for letters.
OUTER = " \t\"“”„«»‹›()[]{}<>.,;:?'’`~=-–—/\\|"
#: Signs that part letters without standing for one; letters that are written for each other; signs that look like letters.
PARTING = str.maketrans("", "", "-–—./,:;'’_·")
ALIKE = {"u": "v", "v": "u", "c": "k", "k": "c", "s": "z", "z": "s", "i": "yl", "y": "i", "l": "i"}
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}


class Trie:
    """The lexicon: children by letter, and the term that ends at a node."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = t


class LevenshteinAutomaton:
    """Accepts the words within `edits` of a word. A state is the row of edit distances to the word's prefixes, cut off above `edits`."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        row = [min(state[0] + 1, self.edits + 1)]
        for i, c in enumerate(self.word):
            row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (c != letter), self.edits + 1))
        return tuple(row)

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.edits

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits


def intersect(trie: Trie, automaton: LevenshteinAutomaton) -> list[str]:
    """The terms that the automaton accepts: both are walked together, and a branch ends where the automaton dies."""
    found, open_ = [], [(0, automaton.start())]
    while open_:
        node, state = open_.pop()
        if trie.term[node] and automaton.accepts(state):
            found.append(trie.term[node])
        for letter, child in trie.children[node].items():
            after = automaton.step(state, letter)
            if automaton.alive(after):
                open_.append((child, after))
    return found


def spelled(trie: Trie, word: str) -> list[str]:
    """The terms that a word spells with signs for some letters: any sign for any letter, in terms of three letters only one that looks like it. Half of a term, and two letters, stay as they are."""
    letters = sum(c.isalpha() for c in word)
    if letters < 2 or 2 * letters < len(word):
        return []
    nodes = [0]
    for c in word:
        if c.isalpha():
            nodes = [trie.children[n][c] for n in nodes if c in trie.children[n]]
        else:
            nodes = [child for n in nodes for letter, child in trie.children[n].items() if len(word) > 3 or letter in SIGNS.get(c, "")]
    return [t for n in nodes if (t := trie.term[n])]


def forms(word: str) -> list[str]:
    """The word and the stems it begins with."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def shortened(word: str) -> list[str]:
    """The word, and it without each of its letters."""
    return [word, *(word[:k] + word[k + 1 :] for k in range(len(word)))]


def swapped(word: str) -> list[str]:
    """The word with each two adjacent letters exchanged."""
    return [word[:k] + word[k + 1] + word[k] + word[k + 2 :] for k in range(len(word) - 1)]


@dataclass
class Matcher:
    """Weight of a raw token: the largest weight of a term it holds, exact or misspelled; 0 for most, which are remembered."""

    terms: dict[str, float]
    kept: int = 100_000
    plain: set[str] = field(default_factory=set)
    older: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        long = sorted(t for t in self.terms if len(t) >= FUZZY_FROM and t[-1] != "*")
        self.trie = Trie(long)
        # Words one edit apart become equal when each loses one letter at most: most words end here, and none that matches does.
        self.shortened = {x for t in long for x in shortened(t)}
        self.long = frozenset(long)
        whole = sorted(t for t in self.terms if t[-1] != "*")
        self.every, self.longest = Trie(whole), max(map(len, whole), default=0)
        self.alike: dict[str, float] = {}
        for t in whole:
            for k, c in enumerate(t) if len(t) < FUZZY_FROM else ():
                for other in ALIKE.get(c, ""):
                    w = t[:k] + other + t[k + 1 :]
                    self.alike[w] = max(self.alike.get(w, 0.0), self.terms[t])

    def word(self, w: str) -> float:
        known = max((self.terms.get(t, 0.0) for t in forms(w)))
        if known:
            return known
        if len(w) < FUZZY_FROM:
            alike = FUZZY_WEIGHT * self.alike.get(w, 0.0)
            if alike or len(w) < FUZZY_FROM - EDITS:
                return alike
        if len(w) > self.longest + EDITS or self.shortened.isdisjoint(shortened(w)):
            return 0.0
        # Two adjacent letters that changed places are one edit: each then has lost a letter of the other's.
        near = {*intersect(self.trie, LevenshteinAutomaton(w, EDITS)), *self.long.intersection(swapped(w))}
        return FUZZY_WEIGHT * max((self.terms[t] for t in near), default=0.0)

    def token(self, token: str) -> float:
        lower = token.lower()
        words = [*LETTERS.finditer(lower)]
        if not words:
            return 0.0
        own = [w.group() for w in words]
        if len(own[0]) == len(lower):
            return self.word(lower)
        if len(words) > 1:  # digits or symbols stand between the letters; such a sign counts as a letter
            own.append(lower[words[0].start() : words[-1].end()])
        return max(self.disguised(lower), *map(self.word, own))

    def disguised(self, token: str) -> float:
        """Weight of a term whose letters other signs stand for or part, as in idi0t, st*p*d or s.t.u.p.i.d."""
        word = token.strip(OUTER).translate(PARTING)
        # An exclamation mark may be a letter or end a sentence.
        cores = {w for w in (word, word.rstrip("!"), word.strip("!")) if len(w) <= self.longest}
        return DISGUISED_WEIGHT * max((self.terms[t] for w in cores for t in spelled(self.every, w)), default=0.0)

    def weights(self, tokens: list[str]) -> dict[str, float]:
        """Of the different tokens, those that have a weight."""
        found, weightless = {}, []
        for t in {*tokens} - self.plain:
            if t not in self.older and (w := self.token(t)):
                found[t] = w
            else:
                weightless.append(t)
        if len(self.plain) > self.kept:  # two generations: what was met lately stays
            self.plain, self.older = set(), self.plain
        self.plain.update(weightless)
        return found


def in_quotation(tokens: list[str], at: int) -> bool:
    """Whether a quotation mark is open at a token, or a reporting verb stands shortly before it."""
    before = tokens[max(0, at - CONTEXT) : at]
    marks = sum(t.count(q) for t in before for q in QUOTES)
    own = tokens[at]
    closed = sum(own.count(q) for q in QUOTES)
    return marks % 2 == 1 or closed >= 2 or any(t.lower().strip(",:") in REPORTING for t in before[-3:])


def own_words(text: str) -> set[str]:
    """The different words that a text says itself: those in quotations are left out."""
    tokens = text.lower().split()
    if not any(q in text for q in QUOTES) and REPORTING.isdisjoint(t.strip(",:") for t in tokens):
        return {*LETTERS.findall(text.lower())}
    return {w for at, t in enumerate(tokens) if not in_quotation(tokens, at) for w in LETTERS.findall(t)}


def evidence(text: str | None, matcher: Matcher) -> tuple[float, float, int]:
    """Summed weight of terms used and of terms quoted, and the number of words."""
    tokens = (text or "").split()
    weights = matcher.weights(tokens)
    used = quoted = 0.0
    for at, t in enumerate(tokens) if weights else ():
        if w := weights.get(t):
            if in_quotation(tokens, at):
                quoted += w
            else:
                used += w
    return used, quoted, len(tokens)


def inputs(used: np.ndarray, quoted: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns of the logistic model: amounts, and amounts for the length."""
    return np.stack([np.log1p(used), np.log1p(100 * used / np.maximum(words, 20)), np.log1p(quoted), np.ones_like(used)], 1)


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    weights: np.ndarray


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic model with a small penalty: Newton's steps, halved while they don't help."""
    w = np.zeros(x.shape[1])
    loss = lambda v: float(np.logaddexp(0, x @ v).sum() - y @ (x @ v) + ridge / 2 * v @ v)
    for _ in range(60):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while np.abs(step).max() > 1e-7 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() <= 1e-6:
            break
    return w


def _evidence_rows(docs: DataFrame, terms: dict[str, float], *keep: str) -> DataFrame:
    """The columns `keep` and each text's evidence."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            got = [evidence(x, matcher) for x in batch.column(len(keep)).to_pylist()]
            u, q, n = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(u, pa.float64()), pa.array(q, pa.float64()), pa.array(n, pa.int64())], names=[*keep, "used", "quoted", "words"])

    picked = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(rows, f"{kinds}, used double, quoted double, words long")


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Terms and their log odds: words of toxic documents that clean ones hardly say themselves, in either half of the sample as well. sample: (text, label), of bounded size.

    A stem is a term only where it stands for several words of toxic documents: of one word alone it would
    say no more than that word, and meet others that begin alike.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word: dict[str, list[int]] = {}
        longer: dict[str, set[str]] = {}
        for batch in batches:
            for text, label, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = own_words(text)
                for f in {f for w in words for f in forms(w)}:
                    by_word.setdefault(f, [0, 0, 0, 0])[2 * half + label] += 1
                for w in words if label else ():
                    for f in forms(w)[1:]:
                        longer.setdefault(f, set()).add(w)
        words = list(by_word)
        columns = [pa.array(words, pa.string()), *(pa.array([by_word[w][k] for w in words], pa.int64()) for k in range(4)), pa.array([sorted(longer.get(w, ()))[:MIN_FORMS] for w in words], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "clean0", "toxic0", "clean1", "toxic1", "longer"])

    halved = sample.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    totals = {(r.half, r.label): r["count"] for r in halved.groupBy("half", "label").count().collect()}
    n = [totals.get((k // 2, k % 2), 0) for k in range(4)]
    odds = lambda toxic, clean, n_toxic, n_clean: F.ln((toxic + 0.5) / (n_toxic + 1)) - F.ln((clean + 0.5) / (n_clean + 1))
    counts = (
        halved.mapInArrow(count, "word string, clean0 long, toxic0 long, clean1 long, toxic1 long, longer array<string>")
        .groupBy("word")
        .agg(*(F.sum(c).alias(c) for c in ("clean0", "toxic0", "clean1", "toxic1")), F.size(F.array_distinct(F.flatten(F.collect_list("longer")))).alias("forms"))
    )
    whole = odds(F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1"), n[1] + n[3], n[0] + n[2])
    halves = [(F.col(f"toxic{k}") > 0) & (odds(F.col(f"toxic{k}"), F.col(f"clean{k}"), n[2 * k + 1], n[2 * k]) >= MIN_ODDS / 2) for k in (0, 1)]
    enough = (F.col("toxic0") + F.col("toxic1") >= MIN_DOCS) & (F.length("word") >= 3) & (~F.col("word").endswith("*") | (F.col("forms") >= MIN_FORMS))
    rows = counts.where(enough & (whole >= MIN_ODDS) & halves[0] & halves[1]).select("word", whole.alias("odds")).collect()
    return {r.word: float(r.odds) for r in rows}


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicityModel:
    """Lexicon and weights from at most `bound` labelled documents outside the held-out fold, equal texts counted once. The sample is written once and read by both steps."""
    small_batches(docs.sparkSession)
    sample = written(labelled_texts(docs, labels, "toxic", FOLDS, HELD_OUT, bound).distinct(), "once")
    terms = learn_terms(sample)
    rows = _evidence_rows(sample, terms, "label").collect()
    if not rows:
        return ToxicityModel({}, np.array([0.0, 0.0, 0.0, -3.0]))
    x = inputs(*(np.array([r[k] for r in rows], float) for k in ("used", "quoted", "words")))
    return ToxicityModel(terms, _logistic(x, np.array([r["label"] for r in rows], float)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text alone.

    A null or empty text has no term and gets the score of none; repeated rows each get their score; an
    empty table gives no row; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    weights, terms = model.weights, model.terms

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            got = np.array([evidence(x, matcher) for x in batch.column("text").to_pylist()], float).reshape(-1, 3)
            s = sigmoid(inputs(*got.T) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; a null or empty text has no term and the score of none."""
    small_batches(docs.sparkSession)
    weights, terms, at = model.weights, model.terms, docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            if batch.num_rows:
                got = np.array([evidence(x, matcher) for x in batch.column(at).to_pylist()], float)
                yield batch.filter(pa.array(sigmoid(inputs(*got.T) @ weights) < THRESHOLD))

    return docs.mapInArrow(passing, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
