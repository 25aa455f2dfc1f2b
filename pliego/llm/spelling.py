"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Words are counted by Spark with map-side combining. Two words of lengths m and m
or m + 1 that differ by one edit agree on everything outside one interval of the
shorter one's positions, so every word is dealt to groups by what it has outside
each interval: first two halves, and where a group is large, halves of halves,
down to intervals of one position, whose groups hold at most one or two free
letters. No group is therefore unbounded, whatever the vocabulary, and no pair of
words leaves a task.

Groups are packed into blocks. A block's index has, for each (position, letter),
a bit set over its words, and one for each group. All words of the block run
through it at once, one letter a step: a set of words without an error so far and
three with one error (replaced; left out: positions one back; added: positions one
on) are carried by and, or and not on 64 words at a time. A pair is counted in the
interval of its first difference only.

A word's form is its most frequent near word (ties: smallest in code-point order)
if that is ``ratio`` times as frequent; forms are followed to the last by pointer
doubling over the words that have one.

Defined results: null and empty texts have no words; null doc_ids count as the
empty text in the hash that damages words; repeated rows count again; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import ascii_lower, ship, written

RUNS = "([A-Za-zÀ-ÿ]+)"
BLOCK_ROWS = 1024          # words that share one index
BLOCK_CELLS = 1 << 18      # letters in one index
GROUP_ROWS = 8192          # groups above are split on half of their interval


def word_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", damage: int = 0) -> DataFrame:
    """(word, n): lower-cased runs of letters.

    With ``damage``, a run loses one letter where ``damage`` divides the crc32 of ``<doc>:<run>``.
    """
    runs = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("d"),
                       F.explode(F.regexp_extract_all(F.col(text), F.lit(RUNS), 1)).alias("w"))
    runs = runs.select("d", ascii_lower(F.col("w")).alias("w"))
    word = F.col("w")
    if damage:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "d", "w").cast("binary")))
        at = (F.col("h") % F.char_length("w")).cast("int")
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring("w", F.lit(1), at), F.substr("w", at + 2))).otherwise(word)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _place(m: Column, lo: Column, hi: Column) -> Column:
    """Group of a word for shorter length m and the free interval [lo, hi): all but the letters inside."""
    tail = m - hi
    return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"),
                    F.concat_ws("|", m.cast("string"), lo.cast("string"), hi.cast("string"), F.substring("word", F.lit(1), lo),
                                F.when(tail > 0, F.substr("word", F.char_length("word") - tail + 1, tail)).otherwise("")).alias("key"))


def _halved(words: DataFrame, lo: Column, hi: Column) -> DataFrame:
    mid = F.floor((lo + hi) / 2).cast("int")
    at = F.explode(F.array(_place(F.col("m"), lo, mid), _place(F.col("m"), mid, hi)))
    return words.select("word", "n", at.alias("g")).select("word", "n", "g.*")


def dealt(words: DataFrame, least_length: int) -> DataFrame:
    """(word, n, m, lo, hi, key): every word with its groups, large ones split until they are small."""
    size = F.char_length("word")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= least_length)
    rows = written(_halved(both, F.lit(0), F.col("m")), "spelling-groups")
    done = None
    while True:
        width = F.col("hi") - F.col("lo")
        large = (rows.groupBy("key").agg(F.count("*").alias("c"), F.max(width).alias("w"))
                 .filter((F.col("w") > 1) & ((F.col("c") > GROUP_ROWS) | (F.col("c") * (F.col("w") + 1) > BLOCK_CELLS)))
                 .select("key"))
        large = written(large, "spelling-large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, "key", "left_semi")
        rows = written(_halved(rows, F.col("lo"), F.col("hi")), "spelling-groups")


class PositionIndex:
    """Bit sets of a block's words by (position, letter), by length and by group."""

    def __init__(self, parts: list[str], group: np.ndarray):
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(self.size.max()) + 1
        text = "".join(p.ljust(width, "\0") for p in parts)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters, codes = np.unique(codes, return_inverse=True)
        self.codes = codes.reshape(len(parts), width)
        self.words = -(-len(parts) // 64)
        self.at = [self._sets(self.codes[:, p], len(letters)) for p in range(width)]
        self.long = {int(m): self._bits((self.size == m)[None])[0] for m in np.unique(self.size)}
        self.group = group
        self.same = self._sets(group, int(group.max()) + 1)

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.words * 8), np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, :packed.shape[1]] = packed
        return out.view(np.uint64)

    def _sets(self, values: np.ndarray, n: int) -> np.ndarray:
        """Row v: the words whose value is v."""
        out = np.zeros((n, self.words * 64), np.uint8)
        out[values, np.arange(len(values))] = 1
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def one_edit(self, rows: np.ndarray) -> np.ndarray:
        """(row, word) pairs of the same group that are exactly one edit apart, for the given words."""
        size, codes = self.size[rows], self.codes[rows]
        none = np.zeros((len(rows), self.words), np.uint64)
        zero = self.same[self.group[rows]]
        other, back, on = none.copy(), none.copy(), zero.copy()   # one error: replaced, left out, added
        found = none.copy()
        for j in range(int(size.max()) + 1):
            ends = np.flatnonzero(size == j)
            if len(ends):
                for sets, m in ((other, j), (back, j - 1), (on, j + 1)):
                    if m in self.long:
                        found[ends] |= sets[ends] & self.long[m]
            if j == size.max():
                break
            c = codes[:, j]
            here = self.at[j][c]
            other = (other & here) | (zero & ~here)
            back = (back & self.at[j - 1][c]) | zero if j else zero.copy()
            zero = zero & here
            on = (on & self.at[j + 1][c]) | zero
        flags = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :len(self.size)]
        return np.argwhere(flags)


def near_in_block(words: list[str], n: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray):
    """(index, near words, index of the best) of each word of a block that has near words in its group."""
    parts = [w[a:len(w) - (k - b)] for w, k, a, b in zip(words, m.tolist(), lo.tolist(), hi.tolist())]
    index = PositionIndex(parts, group)
    step = max(1, (1 << 15) // index.words)
    pairs = []
    for a in range(0, len(words), step):
        rows = np.arange(a, min(a + step, len(words)))
        found = index.one_edit(rows)
        found[:, 0] += a
        pairs.append(found)
    i, j = np.concatenate(pairs).T
    # each pair counts once: in the class of its shorter word, where its first difference is inside the interval
    shorter = np.minimum(index.size[i], index.size[j]) == (hi - lo)[i]
    i, j = i[shorter], j[shorter]
    first = np.concatenate([(index.codes[i[a:a + 65536]] != index.codes[j[a:a + 65536]]).argmax(1)
                            for a in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
    own = (first < (hi - lo)[i]) | (hi == m)[i]
    i, j = i[own], j[own]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort([rank[j], -n[j], i])
    i, j = i[order], j[order]
    at, start, count = np.unique(i, return_index=True, return_counts=True)
    return at, count, j[start]


def near_words(words: DataFrame, least_length: int) -> DataFrame:
    """(word, n_near, best_n, best): every word of (word, n) that has near words."""
    import pyarrow as pa

    ship(__name__)

    def groups(batches):
        """The rows of each group of two or more."""
        group = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        yield group
                    group = []
                group.append(row)
        if len(group) > 1:
            yield group

    def blocks(batches):
        """Whole groups, packed; a group of more rows than a block is a block of its own."""
        held, width = [], 0
        for group in groups(batches):
            wide = max(width, group[0][4] - group[0][3] + 2)
            rows = len(held) + len(group)
            if held and (rows > BLOCK_ROWS or rows * wide > BLOCK_CELLS):
                yield held
                held, wide = [], group[0][4] - group[0][3] + 2
            held, width = held + group, wide
        if held:
            yield held

    def run(batches):
        for rows in blocks(batches):
            key, word, m, lo, hi, n = zip(*rows)
            n, m, lo, hi = np.array(n, np.int64), np.array(m, np.int64), np.array(lo, np.int64), np.array(hi, np.int64)
            group = np.cumsum([False] + [a != b for a, b in zip(key[1:], key)])
            at, count, best = near_in_block(list(word), n, m, lo, hi, group)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([word[i] for i in at]), pa.array(count, pa.int64()), pa.array(n[best]), pa.array([word[i] for i in best])],
                    ["word", "c", "best_n", "best"])

    rows = dealt(words, least_length).select("key", "word", "m", "lo", "hi", "n")
    rows = rows.repartition("key").sortWithinPartitions("key")
    parts = rows.mapInArrow(run, "word string, c long, best_n long, best string")
    return (parts.groupBy("word").agg(F.sum("c").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("b"), "best")).alias("s"))
            .select("word", "n_near", (-F.col("s.b")).alias("best_n"), F.col("s.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the (word, form) rows: the end of each word's chain of forms, by pointer doubling.

    Counts at least double along a chain, so there are few rounds. A row that points
    at its end takes no further part, so the root of many words is no join key.
    """
    links = forms.select("word", F.col("form").alias("to"))
    inner = links.select(F.col("word").alias("to"), F.lit(False).alias("ended"))
    at = written(links.join(inner, "to", "left").select("word", "to", F.coalesce("ended", F.lit(True)).alias("ended")), "spelling-roots")
    while not at.filter(~F.col("ended")).isEmpty():
        on = at.select(F.col("word").alias("to"), F.col("to").alias("next"), F.col("ended").alias("e"))
        step = at.filter(~F.col("ended")).join(on, "to").select("word", F.col("next").alias("to"), F.col("e").alias("ended"))
        at = written(at.filter("ended").unionByName(step), "spelling-roots")
    return at.select("word", F.col("to").alias("root"))


def group_variants(words: DataFrame, least_length: int = 5, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the (word, n) rows; words are distinct."""
    words = written(words.filter(F.char_length("word") >= least_length), "spelling-words")
    near = written(near_words(words, least_length), "spelling-near")
    found = (words.join(near, "word", "left")
             .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"),
                     F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")))
    ends = roots(found.filter("form IS NOT NULL"))
    return (found.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_length: int = 5,
                      least_count: int = 3, damage: int = 97) -> DataFrame:
    """The registered query: words of whole texts with at least ``least_count`` occurrences, and their forms."""
    words = word_counts(docs, doc, text, damage)
    return group_variants(words.filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length)), least_length)
