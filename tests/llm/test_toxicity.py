"""Toxicity: the automaton against edit distances, contexts, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from pliego.llm import toxicity
from pliego.llm.queries import QUERIES

from .conftest import odd_texts
from .test_learned import crc


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    for _ in range(30):
        entries = [(w, stem, rng.choice([0, 1, 2]), 1.0) for w, stem in {word(rng.randint(3, 9)): rng.random() < .4 for _ in range(8)}.items()]
        lexicon = toxicity.Lexicon(entries)
        for _ in range(150):
            w = word(rng.randint(0, 10))
            if rng.random() < .5:
                w = rng.choice(entries)[0] + word(rng.randint(0, 2))
            want = []
            for i, (entry, stem, errors, _) in enumerate(entries):
                e = min([distance(w[:n], entry) for n in range(len(w) + 1)] if stem else [distance(w, entry)])
                if e <= errors:
                    want.append((e, i))
            assert lexicon.match(w) == min(want, default=None)


@pytest.fixture(scope="module")
def insults():
    entries = [("bumbler", False, 1, 1.0), ("dunderhead", False, 2, 1.0), ("nitw", True, 0, 1.0)]
    return toxicity.Judge(toxicity.Lexicon(entries, frozenset(["tumbler"])), toxicity.PRIOR)


def test_misspellings_innocent_words_and_quotation(insults):
    matches = toxicity.Matches(insults.lexicon)

    def score(text):
        return float(insults.score(toxicity.features(text, matches)[None])[0])

    clean = score("a tumbler of water and nothing else to see here")
    assert clean == score("") == score(None) < 0.1
    assert score("you are a Bumbler!") > 0.9 and score("such nitwits, such nitwittery") > 0.7
    assert score("you bumblr, you dunderhaed") > 0.7            # misspelt
    assert score('The word "bumbler" is a noun, wrote the teacher.') < 0.5 < score("You bumbler, said he.")
    assert score("« bumbler » est un mot") < score("bumbler est un tel mot")
    assert toxicity.quoted("a 'bad' b", 3, 6) and not toxicity.quoted("don't be bad, it isn't", 9, 12)


def mangle(text, terms, rng):
    """One letter of every term replaced."""
    out = []
    for w in text.split(" "):
        if w.lower().strip(".,") in terms:
            i = rng.randrange(1, len(w.strip(".,")))
            w = w[:i] + "q" + w[i + 1:]
        out.append(w)
    return " ".join(out)


def test_toxicity_held_out(spark):
    """On the table whose labels are enough for words of every language."""
    sf = SF_MID.replace("0.01", "0.1")
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(sf + "/labels.parquet").collect()}
    got = QUERIES["op13_toxicity"](spark, sf).collect()
    assert len(got) == 10_000 and all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a for a, b in held if b]) > 0.9 and np.mean([a for a, b in held if not b]) < 0.02


def test_misspelt_documents_are_caught(spark):
    docs = spark.read.parquet(SF_MID + "/documents.parquet")
    labels = spark.read.parquet(SF_MID + "/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    judge = toxicity.train(docs, labels)
    terms = {e[0] for e in judge.lexicon.entries if not e[1] and e[2]}
    assert len(terms) >= 5
    rng = random.Random(2)
    matches = toxicity.Matches(judge.lexicon)
    seen = []
    for r in docs.join(labels.filter("toxic = 1"), "doc_id").filter("lang = 'en'").collect():
        bad = mangle(r["text"], terms, rng)
        if bad != r["text"]:
            seen.append(float(judge.score(toxicity.features(bad, matches)[None])[0]) >= 0.7)
    assert len(seen) > 10 and np.mean(seen) > 0.8
    spans = toxicity.toxic_spans(docs.limit(50), judge).collect()
    assert all(s["term"] and 0 <= s["start"] < s["end"] for r in spans for s in r["spans"])


def test_copies_count_once_and_stems_are_not_too_short():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text = lambda: [rng.choice(words) for _ in range(60)]
    base = text()
    near = [base[:i] + ["changed"] + base[i + 1:] for i in range(40)]
    from pliego.llm.shingles import Words, mix
    seeds = np.random.default_rng(1).integers(1, 2 ** 63, toxicity.SKETCH, dtype=np.uint64)
    docs = near + [text() for _ in range(30)]
    sketches = [tuple(int(mix(s ^ x).min()) for x in seeds) for s in Words([" ".join(d) for d in docs]).sets(3)]
    kept = toxicity.leaders(sketches)
    assert kept[0] == 0 and kept[1:] == list(range(40, 70))


def test_toxicity_odd_rows(spark, odd, nothing):
    shape = "doc_id long, toxic int, text string"
    some = spark.createDataFrame([(i, i % 2, "x") for i in range(30, 60)] + [(None, 1, "x"), (31, None, "x"), (999, 0, "x"), (31, 1, "x")], shape)
    got = toxicity.judge_documents(odd, some).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd_texts())
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.judge_documents(odd, some.filter("toxic = 1")).collect()} == {0.0}
    assert toxicity.judge_documents(nothing, some.limit(0)).collect() == []
    assert toxicity.judge_documents(nothing, some).collect() == []
