"""Operator 6, personal data: bootstrapped contextual extraction.

Seed entities are values that are known to be secrets: those assigned to a seed name, and those in a seed form.
Where they occur they induce lexical patterns: the name that a value is assigned to, the two or three words
before and after it, and its leading letters with its form. Patterns and the values (instances) that they hold
make a graph. A pattern's score is the summed confidence of its distinct instances over their number and one, a
seed's confidence is 1, any other instance's the best score of its trusted patterns; both are computed in turn until
no further pattern is trusted. Trusted patterns then find values of any length and form, known or not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table, written

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Names whose assigned value is a seed entity, and the form of a seed key id. Such seeds are found whatever the graph says.
SEED_NAMES = frozenset(("password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key"))
SEED_FORM = re.compile(r"AKIA[0-9A-Z]{16}")
#: The form of values that induce patterns as seeds do, but are found only where a trusted pattern holds them: digests in hexadecimal digits.
LIKELY_FORM = re.compile("(?=.*[0-9])(?=.*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})")

DIGITS = re.compile("[0-9]+")
TOKEN = re.compile(r"\S+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: An assignment's sign, and the value after it: quoted, or up to a blank and without the punctuation at its ends.
SIGN = re.compile("[=:]+>?")
VALUE = re.compile(r"""\s*(?:""|''|"([^"\n]+)"|'([^'\n]+)'|["'`(\[{<]*([^\s=:]*(?:[=:]+(?![=:>"'\w/]))?))""")
NAME_END = re.compile(r"[\w.-]*\Z")
OPENING, MARKS = "\"'`([{<", ".,;:!?)]}>\"'`"
#: Characters of a name, and of a word in a pattern; longer words count by their hash. Words before and after a value that make patterns.
LONGEST_NAME, LONGEST_WORD, WORDS = 40, 40, (2, 3)
#: Score from which a pattern is trusted. As a score divides by the instances and one, four known ones are the least that reach it.
MIN_SCORE = 0.8
#: So many trusted patterns are given to all tasks; more stay a table and are joined with the texts' patterns.
KEPT_PATTERNS = 50_000
#: So many pairs of words are looked for in a text as they are before it is split.
FEW_PAIRS = 64
#: Columns of our own beside those of the documents.
KEY, OWN = "personal data: text's key", "personal data: text's trusted patterns"

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from the @ signs: a match starts where the run of local characters before one starts."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        m = EMAIL.match(text, s) if s < at else None
        if m:
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[Span]:
    """Leftmost matches of IP whose parts are at most 255: numbers joined by dots, four at a time. A part's size shows in its digits."""
    out = []
    for m in NUMBERS.finditer(text):
        if m.group().count(".") < 3:
            continue
        numbers = [(d.start() + m.start(), d.end() + m.start()) for d in DIGITS.finditer(m.group())]
        for k in range(0, len(numbers) - 3, 4):
            own = numbers[k : k + 4]
            if all(e - s <= 3 and int(text[s:e]) <= 255 or len(p := text[s:e].lstrip("0")) <= 3 and int(p or 0) <= 255 for s, e in own):
                out.append((own[0][0], own[3][1]))
    return out


def base_spans(text: str) -> list[list[Span]]:
    """Spans of the four base kinds, each by start; code points, end exclusive."""
    digits = lambda m: "".join(DIGITS.findall(m.group()))
    card = [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and luhn(d)]
    phone = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15] if "+" in text else []
    return [emails(text), addresses(text), card, phone]


class Spans:
    """Spans in order that can be asked whether one of them meets another."""

    def __init__(self, spans: Iterable[Span]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meet(self, s: int, e: int) -> bool:
        k = bisect_right(self.ends, s)
        return k < len(self.starts) and self.starts[k] < e


def form(value: str) -> str:
    """The class of a value's characters and its length."""
    kind = "hex" if re.fullmatch("[0-9a-f]+", value) else "upper" if re.fullmatch("[0-9A-Z]+", value) else "word" if value.isalnum() else "mixed"
    return f"{kind}{len(value)}"


class Context:
    """The words of a text by place, in the form that patterns have them."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.starts = [s for s, _ in self.spans]
        self.text = text

    def word(self, k: int) -> str:
        w = self.text[slice(*self.spans[k])].strip(MARKS + OPENING).lower()
        return w if len(w) <= LONGEST_WORD else f"#{xxhash.xxh3_64_hexdigest(w.encode())}"

    def around(self, start: int, end: int, name: str = "") -> Iterator[str]:
        """Patterns of the words before and after a place. A value that is assigned to a name belongs to it: the name is then part of each, and one word more is enough."""
        before, after = bisect_right(self.starts, start) - 1, bisect_left(self.starts, end)
        if before >= 0 and self.spans[before][1] <= start:
            before += 1
        for n in WORDS:
            n -= bool(name)
            if before >= n:
                yield f"before\t{' '.join(map(self.word, range(before - n, before)))}\t{name}"
            if after + n <= len(self.spans):
                yield f"then\t{' '.join(map(self.word, range(after, after + n)))}\t{name}"


def assigned(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start of the name, start, end, name with its sign) of the values assigned to a name, of any length and characters."""
    end = 0
    for m in SIGN.finditer(text):
        at = m.start()
        if at < end:
            continue
        while at > end and text[at - 1].isspace():
            at -= 1
        at -= at > end and text[at - 1] in "\"'`"
        name = NAME_END.search(text, max(end, at - LONGEST_NAME), at)
        if not any(map(str.isalpha, name.group())):
            continue
        v = VALUE.match(text, m.end())
        if not v.lastindex:
            continue
        s, e = v.span(v.lastindex)
        e = s + len(text[s:e].rstrip(MARKS)) if v.lastindex == 3 else e
        # A name that begins a further assignment isn't a value.
        if any(map(str.isalnum, text[s:e])) and not (v.lastindex == 3 and text[v.end() : v.end() + 1] in ("=", ":")):
            yield name.start(), s, e, name.group().lower().rpartition(".")[2] + m.group()
            end = e


Candidate = tuple[int, int, str, list[str], bool, bool]


def candidates(text: str, taken: Spans) -> list[Candidate]:
    """(start, end, value, patterns, known, sure) by place: assigned values, and other tokens with a digit, outside the spans taken. known: a seed, or in a likely form; sure: a seed."""
    out: list[Candidate] = []
    context = None
    own = []
    for at, s, e, name in assigned(text):
        if not taken.meet(s, e):
            own.append((s, e))
            context = context or Context(text)
            value = text[s:e]
            sure = name.rstrip("=:>") in SEED_NAMES or bool(SEED_FORM.fullmatch(value))
            after = context.spans[bisect_left(context.starts, e) - 1][1]
            out.append((s, e, value, [f"name\t{name}", *_head(value), *context.around(at, max(e, after), name)], sure or bool(LIKELY_FORM.fullmatch(value)), sure))
    seen, end = Spans(own), 0
    for m in DIGITS.finditer(text):
        if m.start() < end:
            continue
        context = context or Context(text)
        s, end = context.spans[bisect_right(context.starts, m.start()) - 1]
        token = text[s:end]
        a, b = s + len(token) - len(token.lstrip(OPENING)), s + len(token.rstrip(MARKS))
        if a < b and not taken.meet(a, b) and not seen.meet(a, b):
            value = text[a:b]
            sure = bool(SEED_FORM.fullmatch(value))
            out.append((a, b, value, [*_head(value), *context.around(s, end)], sure or bool(LIKELY_FORM.fullmatch(value)), sure))
    return sorted(out)


def _head(value: str) -> list[str]:
    return [f"head\t{value[:4]} {form(value)}"] if value[:4].isalpha() and value[:4].isupper() else []


def _loose(pattern: str) -> bool:
    """Whether a pattern is of words around alone: such a one can hold any token."""
    return pattern[:4] in ("befo", "then") and pattern.endswith("\t")


class Trusted:
    """Trusted patterns as find() asks for them."""

    def __init__(self, patterns: Iterable[str]):
        self.all = frozenset(patterns)
        self.loose = frozenset(filter(_loose, self.all))
        # The two words nearest to the value in each loose pattern: only places beside such a pair are looked at. Of a long word the hash is known only.
        pairs = [(p.startswith("before"), p.split("\t")[1].split(" ")) for p in self.loose]
        self.ahead = frozenset(tuple(w[-2:]) for before, w in pairs if before)
        self.behind = frozenset(tuple(w[:2]) for before, w in pairs if not before)
        self.hashed = any(len(w) > 1 and w[:1] == "#" for pair in self.ahead | self.behind for w in pair)
        pairs = sorted(self.ahead | self.behind)
        # A few pairs are looked for in the text as it is: a word, what is stripped from words, and the other word. Lower case of a sigma hangs on its neighbours.
        between = rf"[{re.escape(MARKS + OPENING)}]*"
        few = len(pairs) <= FEW_PAIRS and all(w and not {"σ", "ς"} & set(w) for pair in pairs for w in pair) and not self.hashed
        self.sought = [(a, b, re.compile(rf"{re.escape(a)}(?={between}\s+{between}{re.escape(b)})")) for a, b in pairs] if few else None

    def places(self, text: str) -> list[int]:
        """The tokens beside a pair of words that a loose pattern has there, by number."""
        if not self.loose:
            return []
        low = text.lower()
        if self.sought and len(low) == len(text):
            return self._sought_places(text, low)
        words = [w.strip(MARKS + OPENING).lower() for w in text.split()]
        if self.hashed:
            context = Context(text)
            words = [context.word(k) for k in range(len(context.spans))]
        found = set()
        for k, pair in enumerate(zip(words, words[1:])):
            if pair in self.ahead:
                found.add(k + 2)
            if pair in self.behind:
                found.add(k - 1)
        return sorted(k for k in found if 0 <= k < len(words))

    def _sought_places(self, text: str, low: str) -> list[int]:
        context, found = None, set()
        for a, b, pattern in self.sought:
            for m in pattern.finditer(low) if a in low and b in low else ():
                context = context or Context(text)
                k = bisect_right(context.starts, m.start()) - 1
                if k + 1 < len(context.spans) and (context.word(k), context.word(k + 1)) == (a, b):
                    found |= {k + 2} if (a, b) in self.ahead else set()
                    found |= {k - 1} if (a, b) in self.behind else set()
        return sorted(k for k in found if 0 <= k < len(context.spans))

    def tokens(self, text: str, taken: Spans | None = None, every: bool = False) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, patterns) of the tokens, of any form, that loose patterns hold outside the spans taken (None: the base ones, looked for only where a token is met); with every, of all tokens with all their loose patterns."""
        places = None if every else self.places(text)
        if places == []:
            return
        context = Context(text)
        for s, e in context.spans if every else (context.spans[k] for k in places):
            found = [p for p in context.around(s, e) if every or p in self.loose]
            token = text[s:e]
            a, b = s + len(token) - len(token.lstrip(OPENING)), s + len(token.rstrip(MARKS))
            if found and a < b:
                taken = taken or Spans(x for spans in base_spans(text) for x in spans)
                if not taken.meet(a, b):
                    yield a, b, found


def _edge_rows(found: dict[tuple[str, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(map(int, found.values())), pa.int32())], names=["pattern", "instance", "seed"])


def _instance(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - 2**63


def _edges(docs: DataFrame) -> DataFrame:
    """(pattern, instance, seed) of the candidates' patterns; instance is a hash of the value. Tasks merge repeats of a batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for text in batch.column(0).to_pylist():
                if text:
                    for _, _, value, patterns, known, _ in candidates(text, Spans(x for spans in base_spans(text) for x in spans)):
                        h = _instance(value)
                        for p in patterns:
                            found[p, h] = max(known, found.get((p, h), 0))
            yield _edge_rows(found)

    return docs.select(F.col("text").cast("string")).mapInArrow(scan, "pattern string, instance long, seed int")


def _loose_edges(docs: DataFrame, patterns: list[str] | None) -> DataFrame:
    """(pattern, instance, seed 0) of all tokens that loose patterns hold; None: of all loose patterns there are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted = Trusted(patterns or ())
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for text in batch.column(0).to_pylist():
                if text:
                    for s, e, own in trusted.tokens(text, every=patterns is None):
                        h = _instance(text[s:e])
                        found |= {(p, h): 0 for p in own}
            yield _edge_rows(found)

    return docs.select(F.col("text").cast("string")).mapInArrow(scan, "pattern string, instance long, seed int")


def _settled(edges: DataFrame) -> DataFrame:
    """Written table (pattern, score) of the trusted patterns: scores and confidences in turn, until no further pattern is trusted."""
    known = edges.where("seed = 1").select("instance").distinct().withColumn("confidence", F.lit(1.0))
    confidence, before = known, -1
    while True:
        scored = edges.join(confidence, "instance", "left").groupBy("pattern").agg((F.sum(F.coalesce("confidence", F.lit(0.0))) / (F.count("*") + 1)).alias("score"))
        trusted = written(scored.where(F.col("score") >= MIN_SCORE), "patterns")
        n = trusted.count()
        if n == before:
            return trusted
        before = n
        lent = edges.join(trusted, "pattern").groupBy("instance").agg(F.max("score").alias("confidence"))
        confidence = written(known.unionByName(lent).groupBy("instance").agg(F.max("confidence").alias("confidence")), "confidence")


def learn_patterns(docs: DataFrame) -> dict[str, float] | DataFrame:
    """Patterns that can be trusted, with their scores: a table (pattern, score) if there are more than KEPT_PATTERNS.

    The graph first holds assigned values and tokens with a digit. Patterns of words around that come out as
    trusted are then looked for at all tokens, so that what else they hold counts against them, and the
    scores are settled again, until no such pattern is new. Scores mean the same at every size of corpus.
    """
    small_batches(docs.sparkSession)
    merged = lambda rows: rows.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    found = written(merged(_edges(docs)), "edges")
    # A seed is one in all its contexts. Patterns of too few instances can't reach the score, so most edges end here.
    seeds = found.where("seed = 1").select("instance").distinct().withColumn("known", F.lit(1))
    supported = found.groupBy("pattern").count().where(F.col("count") >= MIN_SCORE * (F.col("count") + 1) - 1e-9).select("pattern")
    known = lambda rows: rows.join(seeds, "instance", "left").select("pattern", "instance", F.coalesce("known", F.lit(0)).alias("seed"))
    edges = written(known(found.join(supported, "pattern")), "supported")
    done = None
    while True:
        trusted = _settled(edges)
        loose = trusted.where((F.col("pattern").startswith("before") | F.col("pattern").startswith("then")) & F.col("pattern").endswith("\t")).select("pattern")
        new = loose if done is None else written(loose.join(done, "pattern", "left_anti"), "loose")
        some = [r.pattern for r in new.limit(KEPT_PATTERNS + 1).collect()]
        if not some:
            break
        more = _loose_edges(docs, some) if len(some) <= KEPT_PATTERNS else _loose_edges(docs, None).join(new, "pattern")
        edges = written(merged(edges.unionByName(known(more))), "edges")
        done = new if done is None else done.unionByName(new)
    kept = trusted.limit(KEPT_PATTERNS + 1).collect()
    return {r.pattern: r.score for r in kept} if len(kept) <= KEPT_PATTERNS else trusted


def _with_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows with a last column more: which of the patterns their text has. Equal texts have equal ones, so a text is known by its hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Trusted(())
        for batch in batches:
            found: dict[tuple[str, str], None] = {}
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    taken = Spans(x for spans in base_spans(text) for x in spans)
                    found |= {(key, p): None for _, _, _, own, _, _ in candidates(text, taken) for p in own}
                    found |= {(key, p): None for _, _, own in every.tokens(text, taken, True) for p in own}
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in found], pa.string()) for j in (0, 1)], names=[KEY, "pattern"])

    text = F.col("text").cast("string")
    key = F.when(F.length(text) > 0, F.md5(text.cast("binary"))).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    (name,) = fresh(docs.columns, KEY)
    keyed = docs.withColumn(name, key)
    pairs = keyed.select(F.col(f"`{name}`").alias(KEY), text.alias("text")).mapInArrow(scan, f"`{KEY}` string, pattern string").distinct()
    own = pairs.join(patterns.select("pattern"), "pattern").groupBy(F.col(f"`{KEY}`").alias(name)).agg(F.collect_list("pattern").alias(OWN))
    return keyed.join(own, name, "left").select(*(keyed[f"`{c}`"] for c in docs.columns), own[OWN])


def all_spans(text: str | None, patterns: Trusted) -> list[list[Span]]:
    """Spans of each of KINDS, none of a kind overlapping another. A sure seed is one whatever the patterns."""
    if not text:
        return [[] for _ in KINDS]
    base = base_spans(text)
    taken = Spans(x for spans in base for x in spans)
    own = [(s, e) for s, e, _, found, _, sure in candidates(text, taken) if sure or any(p in patterns.all for p in found)]
    seen = Spans(own)
    own += [(s, e) for s, e, _ in patterns.tokens(text, taken) if not seen.meet(s, e)]
    return [*base, sorted(own)]


def find(docs: DataFrame, patterns: dict[str, float] | DataFrame) -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) of every row: base spans, and seeds and those of trusted patterns as kind secret, in order of kind and start.

    A null or empty text has none; repeated rows are searched each; an empty table gives no row; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    joined = isinstance(patterns, DataFrame)
    shared = Trusted(() if joined else patterns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, spans in zip(KINDS, all_spans(x, Trusted(own or ()) if joined else own)) for s, e in spans] for x, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist() if joined else repeat(shared))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (_with_patterns(rows, patterns) if joined else rows).mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(docs: DataFrame, patterns: dict[str, float] | DataFrame) -> DataFrame:
    """The rows with each span of their text replaced by its kind in angle brackets; all other columns, but n_chars, which follows, stay.

    A null or empty text stays as it is; repeated rows are redacted each; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    at, n = docs.columns.index("text"), len(docs.columns)
    joined = isinstance(patterns, DataFrame)
    shared = Trusted(() if joined else patterns)

    def clean(text: str | None, own: Trusted) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for s, e, k in sorted((s, e, k) for k, spans in zip(KINDS, all_spans(text, own)) for s, e in spans):
            if s >= end:
                out += [text[end:s], f"<{k.upper()}>"]
            end = max(e, end)
        return "".join([*out, text[end:]]) if out else text

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns = batch.column(n).to_pylist() if joined else repeat(shared)
            texts = pa.array([clean(x, Trusted(own or ()) if joined else own) for x, own in zip(batch.column(at).to_pylist(), owns)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns[:n])], names=batch.schema.names[:n])

    out = (_with_patterns(docs, patterns) if joined else docs).mapInArrow(rows, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn_patterns(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "secret")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("secret"), F.size("spans").cast("long").alias("n_spans"))
