"""Operators with exact results against brute force, on odd rows and on an empty table."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from pliego.llm import bwt, components, decontaminate, jaccard_join, pieces, sharding, shingles, suffix_dedup
from pliego.llm.common import LOWER, UPPER, tokenizer_path

from .conftest import odd_texts

LOW = str.maketrans(UPPER, LOWER)


def counted(rows):
    return Counter(tuple(r) for r in rows)


# --- suffix dedup ---------------------------------------------------------------------------------------------------

def dedup_brute(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i:i + length] for x in data for i in range(len(x) - length + 1))
    out = Counter()
    for (key, _), x in zip(rows, data):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out[(key, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_merged_transforms_find_repeats():
    rng = random.Random(5)
    for it in range(40):
        length, width = (40, 8) if it % 2 else (200, 40)
        base = bytes(rng.choice(b"ab" if it % 3 else b"abcdefgh ") for _ in range(600))
        strings = []
        for _ in range(rng.randrange(1, 30)):
            a = rng.randrange(0, 300)
            s = bytearray(base[a:a + rng.randrange(length, 2 * length)])
            if rng.random() < .6 and len(s) >= length:
                s[rng.randrange(len(s))] = ord("z")
            if len(s) >= length:
                strings.append(bytes(s))
        if not strings:
            continue
        weights = np.array([rng.choice([1, 1, 2]) for _ in strings], float)
        seen = Counter()
        for s, w in zip(strings, weights):
            for i in range(len(s) - length + 1):
                seen[s[i:i + length]] += w
        want = [[i for i in range(len(s) - length + 1) if seen[s[i:i + length]] >= 2] for s in strings]
        got = bwt.repeated_starts(strings, weights, length, width, rng.choice([300, 1000, 10 ** 6]))
        assert [g.tolist() for g in got] == want


def test_merge_gives_common_prefixes():
    strings = [b"abababab" * 4, b"abababab" * 3 + b"abababac"]
    buf = np.frombuffer(b"".join(strings), np.uint8)
    sym = bwt._symbols(buf, 8)
    shards = [bwt.Shard(sym, np.array([o]), np.array([32]), 8) for o in (0, 32)]
    suffix, block, lcp = bwt.merge(shards, 3)
    at = {int(p): i for i, p in enumerate(suffix) if p >= 0}
    assert block[at[0]] == block[at[32]]            # 24 equal bytes
    assert block[at[8]] != block[at[40]]            # the last blocks differ
    assert len(set(suffix[suffix >= 0])) == 2 * 25 and lcp.max() == 3


def test_suffix_dedup(odd):
    assert counted(suffix_dedup.dedup_report(odd).collect()) == dedup_brute(odd_texts())


def test_suffix_dedup_with_large_anchors(odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 600)
    assert counted(suffix_dedup.dedup_report(odd).collect()) == dedup_brute(odd_texts())


def test_suffix_dedup_empty(nothing):
    assert suffix_dedup.dedup_report(nothing).collect() == []


def test_remove_repeats_keeps_columns(odd):
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns
    texts = [r["text"] for r in out.collect()]
    assert texts.count(None) == 2 and "" in texts and not any(t and "ab" * 200 in t for t in texts)


# --- n-gram Jaccard join --------------------------------------------------------------------------------------------

def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups_brute(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)].append(key)
    return Counter((key, len(sets[i]), min(ids[find(i)], default=None)) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_groups(odd, n, percent):
    assert counted(jaccard_join.near_duplicates(odd, n, percent).collect()) == groups_brute(odd_texts(), n, percent)


def test_jaccard_large_groups(spark, monkeypatch):
    """A hub, its near copies and copies of copies, with every group above the pairing limit."""
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        rows.append((100 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(jaccard_join.near_duplicates(df).collect()) == groups_brute(rows, 3, 90)


@pytest.mark.parametrize("n,percent,low,high", [(3, 90, 0.04, 0.1), (5, 80, 0.1, 0.24)])
def test_jaccard_appended_text(spark, n, percent, low, high):
    """Originals with many copies and one near copy each, with rare words appended: the prefixes reach differently far."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        rows += [(100 * i + j, " ".join(w)) for j in range(12)]
        more = int(len(w) * (low + (high - low) * i / 39))
        rows.append((100 * i + 50, " ".join(w + [f"x{i}y{j}" for j in range(more)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups_brute(rows, n, percent)
    assert sum(v for (i, _, low), v in want.items() if i % 100 == 50 and low == i - 50) > 30
    assert counted(jaccard_join.near_duplicates(df, n, percent).collect()) == want


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_candidates_have_like_sizes(spark, monkeypatch, n, percent):
    """An n-gram that sets of all sizes have makes no large group; linked sets at the edges of bands are found."""
    kept, plain = [], jaccard_join.written

    def written(df, name):
        out = plain(df, name)
        kept.extend([out] * (name == "tokens"))
        return out

    monkeypatch.setattr(jaccard_join, "written", written)
    rng = random.Random(5)
    prose = lambda m: [f"w{rng.randrange(10 ** 6)}" for _ in range(m)]
    # the phrase is rarer than the rest, which 40 copies of a longer text have too
    long = prose(6000)
    far = [(i, " ".join(["rare", "shared", "words", "of", "all"] + long[:int(20 * 1.6 ** i)])) for i in range(12)]
    far += [(100 + i, " ".join(long)) for i in range(40)]
    df = spark.createDataFrame(far, "doc_id long, text string")
    assert counted(jaccard_join.near_duplicates(df, n, percent).collect()) == groups_brute(far, n, percent)
    assert kept[0].count() == 0
    like, sizes = [], [*range(n, 80), 200, 401]
    for m in sizes:
        w = prose(m)
        longest = 100 * (m - n + 1) // percent + n - 1     # words of the longest text that is linked
        like += [(10 * m + j, " ".join(w + prose(more))) for j, more in enumerate((0, longest - m, longest - m + 1))]
    df = spark.createDataFrame(like, "doc_id long, text string")
    want = groups_brute(like, n, percent)
    assert sum(i % 10 == 1 and low == i - 1 for i, _, low in want) == len(sizes)
    assert counted(jaccard_join.near_duplicates(df, n, percent).collect()) == want


def test_keep_one_of_each(odd):
    kept = jaccard_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    groups = groups_brute(odd_texts(), 5, 80)
    # two different texts share the id 18
    assert sum(v for (_, t), v in got.items() if shingle_set(t, 5)) == len({c for _, size, c in groups if size}) + 1
    assert got[(1, None)] == 1 and got[(2, "")] == 1 and sum(v for (i, _), v in got.items() if i == 19) == 1
    assert not [i for i, t in got if i in (10, 12, 20)]


def test_jaccard_empty(nothing):
    assert jaccard_join.near_duplicates(nothing).collect() == []


def test_shingles_do_not_depend_on_blocks():
    texts = [t for _, t in odd_texts()]
    whole = [s.tolist() for s in shingles.Words(texts).sets(3)]
    assert whole == [next(shingles.Words([t]).sets(3)).tolist() for t in texts]
    assert [len(s) for s in whole] == [len(shingle_set(t, 3)) for t in texts]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 400)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: v for x, v in label.items() if sum(1 for e in edges if x in e and e[0] != e[1])}


# --- decontamination ------------------------------------------------------------------------------------------------

def leaks_brute(rows, items, n=10):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) if w]
    wins = set()
    for i, t in items:
        w = words(t)
        m = min(n, len(w))
        if m:
            wins |= {(i, tuple(w[s:s + m])) for s in range(len(w) - m + 1)}
    out = Counter()
    for key, t in rows:
        w, hit, found = words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(i)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(key, len(w), len(hit), len(found), sha, bool(hit))] += 1
    return out


def test_decontamination(spark, odd):
    rows = [(i, t) for i, t in odd_texts() if i != 16]
    texts = dict(rows)
    items = [("7", texts[13]), ("10", " ".join(texts[14].split()[5:30])), ("2", "ONE"), ("3", "two, WORDS!"), ("4", None),
             ("5", ""), ("6", "..."), ("7", texts[13]), ("8", " ".join(texts[18].split()[:4])), ("9", "ab ab")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = odd.filter("doc_id IS NULL OR doc_id <> 16")
    got = counted(decontaminate.decontamination_report(docs, bench).collect())
    assert got == leaks_brute(rows, items)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(v for k, v in got.items() if not k[-1])


def test_decontamination_without_broadcast(spark, odd, monkeypatch):
    items = [("1", dict(odd_texts())[13])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = odd.filter("doc_id < 16")
    want = counted(decontaminate.decontamination_report(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert counted(decontaminate.decontamination_report(docs, bench).collect()) == want


def test_decontamination_empty(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.decontamination_report(nothing, none).collect() == []
    assert not [r for r in decontaminate.decontamination_report(odd, none).collect() if r.contaminated]


# --- SentencePiece --------------------------------------------------------------------------------------------------

def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_chunk_table_is_the_library(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 500)  # empties the table now and then
    rng, sp = random.Random(1), lib()
    texts = ["".join(rng.choice(" ▁\n\tab\x00é　语😀<s>0x1A‍") for _ in range(rng.randrange(0, 40)))
             for _ in range(3000)] + ["", " ", "  ", "▁", "a" * 5000]
    table = pieces.ChunkTable(sp)
    for i in range(0, len(texts), 100):
        for t, (ids, decoded) in zip(texts[i:i + 100], table.encode(texts[i:i + 100])):
            want = sp.encode(t, add_bos=True, add_eos=True)
            assert ids.tolist() == want and decoded.decode() == sp.decode(want)


def test_sentencepiece(odd, nothing):
    sp, want = lib(), Counter()
    for key, t in odd_texts():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[(key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    path = tokenizer_path("piece_bpe_32k.model")
    assert counted(pieces.encode_documents(odd, path).collect()) == want
    assert pieces.encode_documents(nothing, path).collect() == []
    full = pieces.encode_documents(odd, path, with_ids=True).filter("doc_id = 21").first()
    assert full["decoded"] == dict(odd_texts())[21].replace("▁", " ") and len(full["ids"]) == full["n_tokens"]


# --- sharding -------------------------------------------------------------------------------------------------------

def shards_brute(rows, limit):
    sixty = lambda x: format(int(hashlib.md5(x.encode()).hexdigest()[:15], 16), "060b")
    data = [(k, len((t or "").encode()), sixty(str(k if k is not None else "")) + sixty(t or "")) for k, t in rows]
    out = Counter()

    def split(part, prefix):
        size = sum(s for _, s, _ in part)
        if size > limit and len({b for _, _, b in part}) > 1:
            for bit in "01":
                split([x for x in part if x[2][len(prefix)] == bit], prefix + bit)
            return
        more = 0
        while size > limit and -(-len(part) // 2 ** more) > max(1, limit // part[0][1]):
            more += 1
        for i, (k, s, _) in enumerate(part):
            own = len(part[i % 2 ** more::2 ** more])
            tail = ":" + format(i % 2 ** more, f"0{more}b") if more else ""
            held = s * own if more else size
            out[(k, s, prefix + tail, len(prefix) + more, held, own, held <= limit)] += 1

    split(data, "")
    return out


@pytest.mark.parametrize("limit", [300, 2000, 10 ** 7])
def test_sharding(odd, limit):
    assert counted(sharding.assign_shards(odd, limit=limit).collect()) == shards_brute(odd_texts(), limit)


def test_sharding_deep(odd, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 2)
    assert counted(sharding.assign_shards(odd, limit=500).collect()) == shards_brute(odd_texts(), 500)


def test_hot_keys_are_split(spark, scratch):
    """Null keys split by text, copies by number: only single rows over the limit do not fit."""
    rows = [(None, f"text {i} " * 20) for i in range(60)] + [(7, "same " * 30)] * 37 + [(8, "x" * 5000)] * 3 + [(9, None)] * 5 + [(9, "")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.assign_shards(df, limit=1000).collect()
    assert counted(got) == shards_brute(rows, 1000)
    assert all(r["fits"] == (r["n_bytes"] <= 1000) for r in got) and max(r["shard_rows"] for r in got if not r["fits"]) == 1
    parts = sharding.write_shards(df, scratch + "/hot", limit=1000).collect()
    back = spark.read.parquet(scratch + "/hot")
    assert back.count() == len(rows) and sum(r["shard_rows"] for r in parts) == len(rows)
    assert {r["__shard"]: r["count"] for r in back.groupBy("__shard").count().collect()} == {r["shard"]: r["shard_rows"] for r in parts}


def test_sharding_empty_and_written(spark, odd, nothing, scratch):
    assert sharding.assign_shards(nothing).collect() == []
    assert sharding.write_shards(nothing, scratch + "/none").collect() == [] and spark.read.schema(nothing.schema).parquet(scratch + "/none").count() == 0
    sharding.write_shards(odd, scratch + "/out", limit=2000)
    back = spark.read.parquet(scratch + "/out")
    assert back.count() == odd.count() and set(odd.columns) < set(back.columns)


def test_registered_small(spark):
    """The registered forms on the smallest tables: every document once."""
    from pliego.llm.queries import QUERIES

    ids = [r[0] for r in spark.read.parquet(SF_SMALL + "/documents.parquet").select("doc_id").collect()]
    for name in ("op7_sentencepiece", "op10_sharding"):
        assert sorted(r[0] for r in QUERIES[name](spark, SF_SMALL).select("doc_id").collect()) == sorted(ids)


@pytest.mark.parametrize("name", ["op3_decontamination", "op10_sharding"])
def test_sql(spark, name):
    import duckdb

    from oracle_compare import canon
    from pliego.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    res = con.execute(ORACLE[name])
    names, rows = [d[0] for d in res.description], res.fetchall()
    df = QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(names, rows)


def test_written_tables_leave_no_shuffle_files(spark, odd):
    """The shuffles of a written table go with its statement, and op8's prefixes with the step that reads them."""
    import glob
    import time

    from pliego.llm import jaccard_join
    from pliego.llm.common import written
    from pliego.session import scratch_path

    disks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in disks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffles()
    counted = odd.groupBy("doc_id").count()
    kept = written(counted, "counted")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and kept.count() == counted.count()

    folder = scratch_path(spark, "llm").removeprefix("file:")
    here = lambda: {x for k in ("sets", "prefixes", "seen") for x in glob.glob(f"{folder}/{k}-*")}
    before = here()
    assert jaccard_join.near_duplicates(odd).count() == odd.count()
    assert here() == before
