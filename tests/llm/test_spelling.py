"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from pliego.llm import spelling
from pliego.llm.common import LOWER, UPPER

from .conftest import odd_texts

LOW = str.maketrans(UPPER, LOWER)


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def words_brute(rows, damage=97):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return n


def variants_brute(rows, damage=97, least=3):
    n = {w: c for w, c in words_brute(rows, damage).items() if len(w) >= 5 and c >= least}
    near, form = {}, {}
    for w in n:
        near[w] = [x for x in n if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def check(df, rows, **kw):
    got = [tuple(r) for r in spelling.spelling_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants_brute(rows, **{{"damage": "damage", "least_count": "least"}[k]: v for k, v in kw.items()})
    assert len(got) == len(set(got)) and set(got) == want
    return want


def variant_texts(seed, n_words=300, alphabet="abcéÿ"):
    """Words, their misspellings at several frequencies, and chains of misspellings."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(alphabet) for _ in range(rng.choice([4, 5, 5, 6, 6, 7, 8, 12, 30]))) for _ in range(n_words)]
    for w in list(vocab):
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            vocab.append(rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w + c]))
    rows = []
    for i in range(200):
        rows.append((i, " ".join(rng.choice([str.upper, str])(rng.choice(vocab[:int(len(vocab) * rng.random()) + 1])) for _ in range(60))))
    return rows


def test_variants_equal_brute_force(spark):
    rows = variant_texts(1)
    want = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    assert any(w[1] and w[2] != w[1] for w in want) and max(w[4] for w in want) > 5


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_ROWS", 12)
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 20)
    rows = variant_texts(2, alphabet="ab")
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, damage=3)


def test_index_of_one_block():
    rng = random.Random(4)
    parts = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(500)})
    group = np.array([i % 2 for i in range(len(parts))])
    got = defaultdict(set)
    index = spelling.PositionIndex(parts, group)
    for i, j in index.one_edit(np.arange(len(parts))):
        got[int(i)].add(int(j))
    for i, w in enumerate(parts):
        assert got[i] == {j for j, x in enumerate(parts) if group[i] == group[j] and one_edit(w, x)}


def test_chains_of_forms_end_at_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [(f"x{i}", "w0") for i in range(40)] + [("a", "b")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "b" if w == "a" else "w13" for w, _ in chain}


def test_odd_rows_and_long_words(spark, odd, nothing):
    check(odd, odd_texts())
    check(odd, odd_texts(), damage=2, least_count=1)
    assert spelling.spelling_variants(nothing).collect() == []
    rows = [(1, "ab" * 3000), (2, "ab" * 3000 + "c"), (3, "ab" * 2000 + "x" + "ab" * 1000), (4, "c" + "ab" * 3000)] * 3
    rows += [(5, "×÷×÷× ÀÀÀÀÀ àÀÀÀÀ ÀÀÀÀÀ ÿÿÿÿÿÿ"), (5, "ÀÀÀÀÀ 中ÀÀÀÀÀ1àÀÀÀÀ-àÀÀÀÀ")] * 2
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
