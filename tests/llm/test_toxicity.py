import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, toxicity

from .cases import documents, rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    now = [i]
    for j, y in enumerate(b, 1):
        now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
    return now


def one_looks_alike(word, term):
    return len(word) == len(term) and [b in toxicity.ALIKE.get(a, "") for a, b in zip(term, word) if a != b] == [True]


TERMS = ["idiot", "stupid", "worthless", "clown", "moron", "scum"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="idotsupclwnmr", max_size=9), st.integers(0, 2))
def test_automaton_and_trie_against_edit_distance(word, edits):
    found = toxicity.intersect(toxicity.Trie(TERMS), toxicity.LevenshteinAutomaton(word, edits))
    assert sorted(found) == sorted(t for t in TERMS if distance(word, t) <= edits)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TERMS), st.data())
def test_matcher_finds_every_single_edit(term, data):
    k = data.draw(st.integers(0, len(term) - 1))
    c = data.draw(st.sampled_from("xyz"))
    word = data.draw(st.sampled_from([term[:k] + c + term[k + 1 :], term[:k] + c + term[k:], term[:k] + term[k + 1 :]]))
    m = toxicity.Matcher({t: 2.0 for t in TERMS})
    alike = any(len(t) < toxicity.FUZZY_FROM and one_looks_alike(word, t) for t in TERMS)
    near = any(len(t) >= toxicity.FUZZY_FROM and distance(word, t) <= 1 for t in TERMS)
    want = 2.0 if word in TERMS else 2.0 * toxicity.FUZZY_WEIGHT * (alike or near)
    assert m.word(word) == want


def test_quotation_and_abuse():
    m = toxicity.Matcher({t: 1.0 for t in TERMS})
    assert toxicity.evidence("you are an idiot and a moron", m)[:2] == (2.0, 0.0)
    assert toxicity.evidence('he wrote “you are an idiot” to them', m)[:2] == (0.0, 1.0)
    assert toxicity.evidence('the "idiot" of the play', m)[:2] == (0.0, 1.0)
    assert toxicity.evidence("she called them, idiot was the word", m)[:2] == (0.0, 1.0)
    assert toxicity.evidence("You IDI0T! idiott.", m)[0] == toxicity.DISGUISED_WEIGHT + toxicity.FUZZY_WEIGHT
    assert toxicity.evidence(None, m) == toxicity.evidence("", m) == (0.0, 0.0, 0)


def test_signs_for_letters_and_swapped_letters():
    m = toxicity.Matcher({t: 1.0 for t in [*TERMS, "fat"]})
    for token in ("idi0t", "m0ron", "st*p*d", "s.t.u.p.i.d", "W0RTHL3SS", "w*rthless", "(W*RTHLESS!)", "st@pid", "id.iot", "i*iot", "sc*m", "5cum", "$cum!!", "f4t", "“m#r0n”,", "cl0wn?", "1diot"):
        assert m.token(token) == toxicity.DISGUISED_WEIGHT, token
    for token in ("idoit", "wrothless", "sutpid", "scvm", "skum", "zcum", "idio0t", "w.rthless", "stu*pid"):
        assert m.token(token) in (toxicity.FUZZY_WEIGHT, toxicity.DISGUISED_WEIGHT), token
    for token in ("well-known", "and/or", "smuc", "f*t", "h2o", "mp3", "e.g.", "1d107", "*****", "***ot", "100%", "x" * 100_000 + "1", "a1" * 50_000, "xcum", "scam"):
        assert m.token(token) == 0.0, token


def test_support_of_terms_does_not_grow_with_the_sample(spark):
    """A term of six documents is learned among 300 toxic ones as among 3000."""
    for n in (300, 3000):
        rng = random.Random(n)
        say = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(12))
        texts = [(say() + (" scoundrel" if k < 6 else " villain"), 1) for k in range(n)] + [(say(), 0) for _ in range(6 * n)]
        sample = spark.createDataFrame(texts, "text string, label int")
        assert {"scoundrel", "villain"} <= set(toxicity.learn_terms(sample))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.train(labelled, labels)
    got = toxicity.score(labelled, model).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def labelled(spark, rows):
    """(documents, labels) of (text, toxic) rows."""
    docs = documents(spark, [(k, t, "en", "s", len(t), *["z"] * 10) for k, (t, _) in enumerate(rows)])
    return docs, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('nrs')}"
    said = lambda n: [word() for _ in range(n)]
    rows = []
    for k in range(900):
        w = said(rng.randrange(20, 60))
        if k % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "worthless", "pathetic"]))
        elif k % 9 == 1:
            at = rng.randrange(3, len(w))
            w[at:at] = ["she", "wrote", '"you', rng.choice(["idiot", "worthless", "pathetic"]) + '"']
        rows.append((" ".join(w), int(k % 3 == 0)))
    return rows, said


def test_quotation_is_told_from_abuse_and_stems_are_not_made_of_one_word(spark):
    rows, said = corpus()
    model = toxicity.train(*labelled(spark, rows))
    assert {"idiot", "worthless", "pathetic"} <= set(model.terms) and not any(t.endswith("*") for t in model.terms)
    assert model.weights[2] < model.weights[0]
    text = " ".join(said(30))
    asked, _ = labelled(spark, [(f"{text} you idiot", 1), (f'{text} she wrote "you idiot"', 0), (f"{text} the pathway of pathology", 0), (f"{text} you wortless", 1)])
    assert [r.predicted for r in toxicity.score(asked, model).orderBy("doc_id").collect()] == [1, 0, 0, 1]


def brute_score(text, model):
    """The score from its definition: every term against every word by edit distance, without trie, automaton or cache."""
    long = [t for t in model.terms if len(t) >= toxicity.FUZZY_FROM and not t.endswith("*")]

    def weight(w):
        exact = [model.terms[t] for t in model.terms if t == w or t[-1] == "*" and len(w) > len(t) - 1 and w.startswith(t[:-1])]
        swaps = {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for k in range(len(w) - 1)}
        alike = [model.terms[t] for t in model.terms if len(t) < toxicity.FUZZY_FROM and not t.endswith("*") and one_looks_alike(w, t)]
        return max(exact) if exact else toxicity.FUZZY_WEIGHT * max(alike or [model.terms[t] for t in long if abs(len(t) - len(w)) < 2 and (t in swaps or distance(t, w) <= 1)], default=0.0)

    def disguised(token):
        core = "".join(c for c in token.strip(toxicity.OUTER) if ord(c) not in toxicity.PARTING)
        found = [0.0]
        for w in {core, core.rstrip("!"), core.strip("!")}:
            letters = sum(c.isalpha() for c in w)
            for t in model.terms:
                if t[-1] != "*" and len(t) == len(w) and letters >= 2 and 2 * letters >= len(w) and all(c == x or (not c.isalpha() and (len(w) > 3 or x in toxicity.SIGNS.get(c, ""))) for c, x in zip(w, t)):
                    found.append(model.terms[t])
        return toxicity.DISGUISED_WEIGHT * max(found)

    tokens, used, quoted = (text or "").split(), 0.0, 0.0
    for at, token in enumerate(tokens):
        words = re.findall(r"[^\W\d_]+", token.lower())
        masked = re.findall(r"[^\W\d_]+(?:[\W\d_]+[^\W\d_]+)+", token.lower())
        if w := max([*map(weight, words + masked), disguised(token.lower()) if words and words != [token.lower()] else 0.0], default=0.0):
            quote = sum(c in toxicity.QUOTES for t in tokens[max(0, at - 10) : at] for c in t) % 2 == 1 or sum(c in toxicity.QUOTES for c in token) >= 2
            if quote or any(t.lower().strip(",:") in toxicity.REPORTING for t in tokens[max(0, at - 3) : at]):
                quoted += w
            else:
                used += w
    x = [math.log1p(used), math.log1p(100 * used / max(len(tokens), 20)), math.log1p(quoted), 1.0]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights))))))


def test_scores_equal_brute_force(spark):
    data, _ = corpus(2)
    model = toxicity.train(*labelled(spark, data))
    texts = [t for t, _ in data[:150]] + ['the "idiot" wrote: IDIOTT w0rthless pathetci', "you 1diot, p*thet!c! wort.hless idio7 worthles5s"[:60], None, "", "x " * 3000 + "idoit"]
    docs = documents(spark, [(k, t, "en", "s", 1, *["z"] * 10) for k, t in enumerate(texts)])
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - brute_score(texts[r.doc_id], model)) < 1e-9


def test_every_row_and_filter(spark, sf):
    model = toxicity.train(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    got = toxicity.score(documents(spark), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    assert all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_clean(documents(spark), model)
    assert kept.columns == documents(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if not r.predicted)
    assert toxicity.score(documents(spark, []), model).count() == 0
    empty = toxicity.train(documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not empty.terms and toxicity.score(documents(spark), empty).where("predicted = 1").count() == 0


def test_stems_match_longer_words_only():
    m = toxicity.Matcher({"vequ*": 3.0, "idiot": 2.0})
    assert m.word("vequté") == 3.0 and m.word("vequ") == 0.0 and m.word("idiot") == 2.0
