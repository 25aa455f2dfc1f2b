"""Toxicity by a learned lexicon, matched with a Levenshtein automaton.

Lexicon: words, and stems (beginnings shared by several words), that are far more
frequent in documents marked toxic than in others (log-likelihood ratio). They form
a trie. A text's words run through the product of the trie and a Levenshtein
automaton: a state is a set of (trie node, errors so far), made when first needed and
kept by letter, so a word costs one look-up a letter and most words end after a few.
Short entries allow no error, longer ones one or two; a misspelling that occurs in
clean documents is an innocent word, and an entry near several innocent words allows
one error less.

Each hit is read in its context, a window of words around it: quotation marks around
it and words of reporting speak for quotation, address, exclamation and other hits for
abuse. A document's score is a logistic function of its hits so weighted, fitted with a
ridge towards fixed weights, so that features the labels never show keep their sign.

The lexicon and the weights are learned from at most ``SAMPLE`` labelled documents of
each class, the first by a hash, of which near copies count once (minhash sketches),
so that one text with many copies makes no entries; Spark counts and matches their whole
texts, and at most ``ENTRIES`` candidates and the sample's few numbers reach the driver.
An entry needs more evidence the more candidates there are. Scoring is
one scan of whole texts without a shuffle.

Defined results: null and empty texts, and texts without a hit, get the score of a text
without hits; without both classes of labels every score is 0; repeated rows get a row
each; null doc_ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import shingles
from pliego.llm.common import bounded_batches, crc_mod, ship, text_blocks, written

SAMPLE = 5_000
ENTRIES = 2_000
EVIDENCE = 4.0               # least log-likelihood ratio of an entry, above twice the logarithm of the number of candidates
LIFT = 8.0                   # least ratio of its shares of documents
STEM = range(4, 11)          # lengths of stems
STEM_FORMS = 3               # words that share a stem
TABLE_WORDS = 300_000
SKETCH = 16                  # minhashes of a sampled text's three-word shingles
WINDOW = 6                   # words on each side of a hit
QUOTE_REACH = 120            # characters searched for a quotation mark
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“„«‹‘'`", "\"”“»›’'`"
# fixed values: words of reporting and of address in the corpus's languages
REPORTING = frozenset(
    "said says wrote writes called calls calling quote quotes quoted quoting word words term terms insult insults insulted slur "
    "sagte sagt schrieb nannte nennt zitat zitierte wort begriff beleidigung "
    "dit disait écrit appelé traité cite citation mot terme insulte "
    "dijo dice escribió llamó cita citó palabra término insulto".split())
ADDRESS = frozenset("you your yours u ur youre du dich dir dein deine ihr euch tu te toi ton vous votre tú ti eres usted vosotros".split())

FEATURES = 6
#: Fixed weights towards which the fit is drawn: none, plain hits, misspelt hits, a hit, the strongest hit, density, quoted share.
PRIOR = np.array([-3.0, 2.0, 1.5, 1.0, 2.5, 0.5, -1.0])


def allowed(entry: str, stem: bool) -> int:
    """Errors that an entry allows."""
    n = len(entry) - (1 if stem else 0)
    return 0 if n < 5 else 1 if n < 8 else 2


class Lexicon:
    """Entries (text, is stem, errors allowed, weight) as a trie, and its automaton's states."""

    def __init__(self, entries: list[tuple[str, bool, int, float]], innocent: frozenset[str] = frozenset()):
        self.entries, self.innocent = entries, innocent
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget = [0]
        for e, (text, _, errors, _) in enumerate(entries):
            node = 0
            for c in text:
                self.budget[node] = max(self.budget[node], errors)
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({}), self.ends.append([]), self.budget.append(0)
                node = self.kids[node][c]
            self.budget[node] = max(self.budget[node], errors)
            self.ends[node].append(e)
        self.reset()

    def reset(self) -> None:
        """Forget the automaton's states; they are made again when needed."""
        self.states: dict = {}
        self.members: list = []
        self.step: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], stem) -> int:
        """Number of a state: least errors by trie node (closed under left-out letters), and the best stem passed."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for kid in self.kids[node].values():
                e = nodes[node] + 1
                if e <= self.budget[kid] and e < nodes.get(kid, 9):
                    nodes[kid] = e
                    todo.append(kid)
        for node, e in nodes.items():
            for entry in self.ends[node]:
                if self.entries[entry][1] and e <= self.entries[entry][2] and (stem is None or (e, entry) < stem):
                    stem = (e, entry)
        key = (frozenset(nodes.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append((nodes, stem))
        return self.states[key]

    def _next(self, state: int, c: str) -> int:
        nodes, stem = self.members[state]
        out: dict[int, int] = {}
        for node, e in nodes.items():
            kid = self.kids[node].get(c)
            if kid is not None and e <= self.budget[kid]:
                out[kid] = min(e, out.get(kid, 9))
            if e + 1 <= self.budget[node]:                     # a letter added
                out[node] = min(e + 1, out.get(node, 9))
            for other, kid in self.kids[node].items():         # a letter replaced
                if other != c and e + 1 <= self.budget[kid]:
                    out[kid] = min(e + 1, out.get(kid, 9))
        return self._state(out, stem)

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, entry) of the nearest entry: a word as a whole or a stem at the word's beginning."""
        state = self.start
        for c in word:
            at = self.step.get((state, c))
            if at is None:
                if len(self.step) > 500_000:
                    self.reset()
                    return self.match(word)
                at = self.step[state, c] = self._next(state, c)
            state = at
            if not self.members[state][0]:
                break
        else:
            nodes, stem = self.members[state]
            best = stem
            for node, e in nodes.items():
                for entry in self.ends[node]:
                    if e <= self.entries[entry][2] and (best is None or (e, entry) < best):
                        best = (e, entry)
            return best if best is None or not best[0] or word not in self.innocent else None
        best = self.members[state][1]
        return best if best is None or not best[0] or word not in self.innocent else None


class Matches(dict):
    """Hits of the words met so far."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) > TABLE_WORDS:
            self.clear()
        hit = self[word] = self.lexicon.match(word)
        return hit


def quoted(text: str, start: int, end: int) -> bool:
    """A quotation mark opens before the span and one closes after it, both within reach and the same line."""
    before = text[max(0, start - QUOTE_REACH):start].rpartition("\n")[2]
    after = text[end:end + QUOTE_REACH].partition("\n")[0]
    for a, b in zip(_OPEN, _CLOSE):
        if a == b and a != "'":
            if before.count(a) % 2 and b in after:
                return True
        elif a == "'":
            if re.search(r"(?:^|\W)'[^']*$", before) and re.match(r"[^']*'(?:\W|$)", after):
                return True
        elif before.rfind(a) > before.rfind(b) and b in after:
            return True
    return False


def hits_of(text: str, matches: Matches):
    """(start, end, errors, entry, context weight, is quoted) of each hit of a text, and its number of words."""
    low = text.lower()
    words = _WORD.findall(low)
    if not any(map(matches.__getitem__, words)):
        return [], len(words)
    spans = [m.span() for m in _WORD.finditer(low)]
    shown = text if len(low) == len(text) else low
    at = [i for i, w in enumerate(words) if matches[w]]
    near = set(at)
    out = []
    for i in at:
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        around = words[a:i] + words[i + 1:b]
        marks = quoted(shown, *spans[i])
        abuse = (any(w in ADDRESS for w in around) + any(j in near for j in range(a, b) if j != i)
                 + ("!" in shown[spans[i][1]:spans[i][1] + 3]))
        context = 1.0 + abuse - 1.5 * marks - 1.0 * any(w in REPORTING for w in around)
        out.append((*spans[i], *matches[words[i]], 1 / (1 + np.exp(-context)), marks))
    return out, len(words)


def features(text: str | None, matches: Matches) -> np.ndarray:
    f = np.zeros(FEATURES)
    hits, words = hits_of(text, matches) if text else ([], 0)
    if not hits:
        return f
    weight = np.array([matches.lexicon.entries[h[3]][3] for h in hits])
    errors, context = np.array([h[2] for h in hits]), np.array([h[4] for h in hits])
    strength = weight * context * 0.6 ** errors
    f[0] = np.log1p(strength[errors == 0].sum())
    f[1] = np.log1p(strength[errors > 0].sum())
    f[2] = float((context > 0.5).any())
    f[3] = strength.max()
    f[4] = min(1.0, 50 * len(hits) / words)
    f[5] = np.mean([h[5] for h in hits])
    return f


class Judge:
    """Lexicon and weights."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression with balanced classes and a ridge towards PRIOR, by Newton steps."""
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * min(len(y), 400)
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (share * (y - p)) - ridge * (w - PRIOR)
        hess = (z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str) -> DataFrame:
    """(y, text) of the first SAMPLE labelled documents of each class by a hash, written."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).select(
        F.col(doc).alias("__d"), F.col(label).cast("int").alias("__y")).distinct()
    draw = F.xxhash64(F.col("__d").cast("string"), F.lit("toxicity"))
    some = [marks.filter(F.col("__y") == y).orderBy(draw, "__d").limit(SAMPLE) for y in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))                       # at most 2 * SAMPLE small rows
    rows = docs.select(doc, text).join(ids, F.col(doc) == F.col("__d"))
    rows = rows.select(F.monotonically_increasing_id().alias("r"), F.col("__y").alias("y"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _without_copies(written(rows, "toxicity-sample"))


def leaders(sketches: list[tuple], alike: int = SKETCH // 2) -> list[int]:
    """Indices of sketches that agree with no earlier leader in ``alike`` places or more."""
    by_place: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, sketch in enumerate(sketches):
        shared = Counter(j for place in enumerate(sketch) for j in by_place.get(place, ()))
        if any(n >= alike for n in shared.values()):
            continue
        out.append(i)
        for place in enumerate(sketch):
            by_place.setdefault(place, []).append(i)
    return out


def _without_copies(sample: DataFrame) -> DataFrame:
    """One text of each group of near copies of a class; the sketches of the bounded sample reach the driver."""
    import pyarrow as pa

    seeds = np.random.default_rng(17).integers(1, 2 ** 63, SKETCH, dtype=np.uint64)

    def run(batches):
        for (rs, ys), texts in text_blocks(batches, 2):
            sketches = [[int(shingles.mix(s ^ seed).min() >> np.uint64(1)) for seed in seeds] if len(s) else [0] * SKETCH
                        for s in shingles.Words(texts).sets(3)]
            yield pa.RecordBatch.from_arrays([pa.array(rs, pa.int64()), pa.array(ys, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))],
                                             ["r", "y", "sketch"])

    rows = sample.mapInArrow(run, "r long, y int, sketch array<long>").collect()
    rows.sort(key=lambda r: (r["y"], r["sketch"], r["r"]))
    kept = [rows[i]["r"] for y in (0, 1) for i in _of_class(rows, y)]
    ids = F.broadcast(sample.sparkSession.createDataFrame([(r,) for r in kept], "r long"))   # the bounded sample's row numbers
    return written(sample.join(ids, "r").select("y", "text"), "toxicity-sample")


def _of_class(rows: list, y: int) -> list[int]:
    at = [i for i, r in enumerate(rows) if r["y"] == y]
    return [at[i] for i in leaders([tuple(rows[i]["sketch"]) for i in at])]


def _evidence(n1, n0, total1: int, total0: int):
    """Log-likelihood ratio of a share of documents, and the ratio of the smoothed shares."""
    share1, share0 = (n1 + 0.5) / (total1 + 1), (n0 + 0.5) / (total0 + 1)
    n, total = n1 + n0, total1 + total0

    def part(k, m):
        return F.when(k > 0, k * F.log(k / (F.lit(float(m)) * n / F.lit(float(total))))).otherwise(0.0)

    return 2 * (part(n1, total1) + part(n0, total0)), share1 / share0


def learn_lexicon(sample: DataFrame) -> Lexicon | None:
    """Entries that set the toxic documents of (y, text) apart; None without both classes."""
    import pyarrow as pa

    total = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(total) < 2:
        return None

    def count(batches):
        seen: dict[tuple[str, bool], list[int]] = {}

        def rows():
            keys = list(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                 pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())], ["s", "stem", "n0", "n1"])
            seen.clear()
            return out

        for (ys,), texts in text_blocks(batches, 1):
            for y, t in zip(ys, texts):
                words = {w for w in _WORD.findall(t.lower()) if len(w) <= 64}
                for k in {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEM if n <= len(w)}:
                    seen.setdefault(k, [0, 0])[y] += 1
            if len(seen) > 500_000:
                yield rows()
        yield rows()

    parts = sample.mapInArrow(count, "s string, stem boolean, n0 long, n1 long")
    counts = written(parts.groupBy("s", "stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-words")
    words = counts.filter(~F.col("stem")).select("s", "n0", "n1")
    forms = (words.filter("n1 > 0").select(F.explode(F.sequence(F.lit(STEM.start), F.lit(STEM.stop - 1))).alias("k"), "s")
             .filter(F.char_length("s") >= F.col("k")).groupBy(F.substring("s", F.lit(1), F.col("k")).alias("s")).agg(F.count("*").alias("forms")))
    ratio, lift = _evidence(F.col("n1"), F.col("n0"), total[1], total[0])
    need = EVIDENCE + 2 * np.log(max(counts.count(), 1))
    telling = counts.withColumn("g", ratio).withColumn("lift", lift).filter((F.col("g") >= float(need)) & (F.col("lift") >= LIFT))
    plain = telling.filter(~F.col("stem")).orderBy(F.desc("g"), "s").limit(ENTRIES).collect()
    stems = telling.filter("stem").join(forms, "s").orderBy(F.desc("g"), F.char_length("s"), "s").limit(10 * ENTRIES).collect()
    # a beginning that loses next to nothing with one more letter is no stem yet: the longer one is meant
    held = {r["s"]: r["n1"] for r in stems}
    longer = {s[:-1] for s, n in held.items() if n >= 0.95 * held.get(s[:-1], np.inf)}
    chosen: dict[str, float] = {}
    for r in sorted(stems, key=lambda r: (len(r["s"]), r["s"])):
        if r["forms"] >= STEM_FORMS and r["s"] not in longer and not any(r["s"][:n] in chosen for n in STEM if n < len(r["s"])):
            chosen[r["s"]] = r["lift"]
    entries = [(r["s"], False, allowed(r["s"], False), r["lift"]) for r in plain if not any(r["s"].startswith(x) for x in chosen)]
    entries += [(s, True, allowed(s, True), x) for s, x in chosen.items()]
    entries = [(s, stem, errors, float(min(1.0, np.log(x) / np.log(8 * LIFT)))) for s, stem, errors, x in entries]
    first = Lexicon(entries)

    def near(batches):
        for b in batches:
            found = [(w, n0, *m) for w, n0, n1 in zip(*(b.column(i).to_pylist() for i in range(3)))
                     if (m := first.match(w)) and m[0] and n0 and (n1 + .5) / (total[1] + 1) < LIFT * (n0 + .5) / (total[0] + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in
                                              ((0, pa.string()), (1, pa.int64()), (3, pa.int32()))], ["s", "n0", "entry"])

    clean = words.mapInArrow(near, "s string, n0 long, entry int").orderBy(F.desc("n0"), "s").limit(20 * ENTRIES).collect()
    around = np.bincount([r["entry"] for r in clean], minlength=len(entries))
    entries = [(s, stem, max(0, errors - int(around[i] >= 3)), w) for i, (s, stem, errors, w) in enumerate(entries)]
    return Lexicon(entries, frozenset(r["s"] for r in clean))


def _arrow_rows(docs: DataFrame, doc: str, text: str, make, out: list) -> DataFrame:
    """Rows (doc, *out); ``make()``, called once a task, gives the function from texts to the columns of ``out``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    key_type, kind = to_arrow_type(docs.schema[doc].dataType), docs.schema[doc].dataType.simpleString()

    def run(batches):
        columns = make()
        for (keys,), texts in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), *columns(texts)], [doc, *(n for n, _ in out)])

    return docs.select(F.col(doc), F.col(text)).mapInArrow(run, f"`{doc}` {kind}, " + ", ".join(f"{n} {t}" for n, t in out))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> Judge | None:
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    ship(__name__)
    ship(shingles.__name__)
    sample = _sample(docs, labels, doc, text, label)
    lexicon = learn_lexicon(sample)
    if lexicon is None:
        return None

    def make():
        matches = Matches(lexicon)
        return lambda texts: [pa.array([features(t, matches) for t in texts], pa.list_(pa.float64()))]

    rows = _arrow_rows(sample, "y", "text", make, [("f", "array<double>")]).collect()   # the bounded sample's numbers
    rows.sort(key=lambda r: (r["y"], r["f"]))
    return Judge(lexicon, fit(np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows])))


def score_documents(docs: DataFrame, judge: Judge | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) of every row."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    ship(__name__)

    def make():
        if judge is None:
            return lambda texts: [pa.array(np.zeros(len(texts)))]
        matches = Matches(judge.lexicon)
        return lambda texts: [pa.array(judge.score(np.array([features(t, matches) for t in texts])))]

    return _arrow_rows(docs, doc, text, make, [("score", "double")])


def toxic_spans(docs: DataFrame, judge: Judge, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans): start, end (of the lower-cased text), term, errors and context weight of every hit."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    ship(__name__)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("errors", pa.int32()), ("context", pa.float64())]))

    def make():
        matches = Matches(judge.lexicon)
        return lambda texts: [pa.array([[{"start": s, "end": e, "term": judge.lexicon.entries[n][0], "errors": k, "context": float(c)}
                           for s, e, k, n, c, _ in (hits_of(t, matches)[0] if t else [])] for t in texts], kind)]

    return _arrow_rows(docs, doc, text, make, [("spans", "array<struct<start:int,end:int,term:string,errors:int,context:double>>")])


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: learn from labels with crc32(doc_id) mod 3 other than 1, score every document."""
    judge = train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    return score_documents(docs, judge).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
