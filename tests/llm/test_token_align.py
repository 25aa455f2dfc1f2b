"""Cross-tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from pliego.llm import token_align
from pliego.llm.common import tokenizer_path

from .conftest import SMALL, odd_texts

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(rows):
    """Rows of the contract, straight from the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(A))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    letters = token_align.byte_letters()
    docs = []
    for key, text in rows:
        ids_a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = sp.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a = ids_b = bytes_a = bytes_b = []
        spans = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, out = 0, []
            for i, p in zip(ids, parts):
                out.append((at, at + len(p), i))
                at += len(p)
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], [0, 0]
        for end in ends:
            parts = []
            for side, x in enumerate(spans):
                first = at[side]
                while at[side] < len(x) and x[at[side]][1] <= end:
                    at[side] += 1
                parts.append(",".join(str(i) for _, _, i in x[first:at[side]]))
            groups.append("|".join(parts))
        links, k = [], 0
        for s, e, i in spans[0]:
            while spans[1][k][1] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][0] < e:
                links.append((i, spans[1][m][2]))
                m += 1
        docs.append((key, len(ids_a), len(ids_b), groups, links))
    count = Counter(x for d in docs for x in d[4])
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return count, Counter(
        (key, a, b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for key, a, b, groups, links in docs)


def strange_texts():
    rng = random.Random(8)
    parts = [" ", "  ", "\n", "\n ", " \n \n", "\t", " ", " ", "\x1c", "\x85", "a", "'s", "The", " the", "ing", "é", "語", "😀",
             "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "12", "!!", "\0", "-", "ﬁ", "ﬁ", "x y", "don't", "Ġ", "Ċ"]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    return out + [(900, " "), (901, "  "), (902, " a"), (903, "a "), (904, "▁"), (905, "x ▁y"), (906, "\n"), (907, "a▁")]


@pytest.mark.parametrize("chunks, frequent", [(20, 20), (300_000, 1 << 18)])
def test_alignment_equals_brute_force(spark, odd, monkeypatch, chunks, frequent):
    monkeypatch.setattr(token_align, "TABLE_CHUNKS", chunks)
    monkeypatch.setattr(token_align, "FREQUENT", frequent)
    rows = odd_texts() + strange_texts()
    docs = odd.select("doc_id", "text", "n", "c").unionByName(
        spark.createDataFrame(strange_texts(), "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    got = token_align.align_documents(docs, tokenizer_path(A), tokenizer_path(B))
    _, want = brute(rows)
    assert Counter(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == want
    assert sum(1 for w in want if w[1] == 0) > 3


def test_link_counts_and_groups(spark):
    rows = [tuple(r) for r in spark.read.parquet(SMALL + "/documents.parquet").select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count, want = brute(rows)
    got = {(r["a_id"], r["b_id"]): r["n"] for r in token_align.link_counts(docs, tokenizer_path(A), tokenizer_path(B)).collect()}
    assert got == dict(count)
    full = token_align.align_documents(docs, tokenizer_path(A), tokenizer_path(B), with_groups=True).collect()
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in full if r["n_a"])
    assert Counter(r["groups_sha256"] for r in full) == Counter(w[7] for w in want.elements())


def test_identity_map():
    with open(tokenizer_path(A)) as f, open(tokenizer_path(B), "rb") as g:
        v = token_align.Vocabularies(f.read(), g.read())
    known = [a for a, b in enumerate(v.same) if b >= 0]
    assert len(known) > 10_000 and all(v.a_bytes[a] == v.b_bytes[v.same[a]] for a in known)


def test_alignment_of_nothing(nothing):
    assert token_align.align_documents(nothing, tokenizer_path(A), tokenizer_path(B)).collect() == []
