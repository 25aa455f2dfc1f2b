import random

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
#: documents with a column of each name that operators use inside
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("c", T.StringType()),
    T.StructField("d", T.StringType()), T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType()),
    T.StructField("n", T.DoubleType()), T.StructField("root", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("rows", T.StringType()), T.StructField("item_id", T.StringType())])


def odd_texts():
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghäéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[7] = "changed"
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "Two words"), (7, "!!! 123 ..."), (None, None),
           (None, base), (9, base), (10, base), (11, base.upper()), (12, " ".join(near)),
           (13, prose(30) + " " + passage + " " + prose(30)), (14, prose(20) + " " + passage + " " + prose(50)),
           (15, "ab" * 30000), (16, prose(9000)), (17, "ab ab " * 200), (18, prose(80)), (18, prose(80))]
    out += [(19, prose(70))] * 3
    near = base.split()
    near[60] = "another"
    out += [(20, " ".join(near) + " end"), (21, "a▁b  c▁▁ d\x00e 语言 😀"), (22, "x" * 250), (23, "x" * 199)]
    return out + [(i, prose(rng.randint(3, 200))) for i in range(30, 60)]


@pytest.fixture(scope="session")
def odd(spark):
    langs = ["aa", "bb", None]
    rows = [(i, t, langs[(i or 0) % 3], "s", len(t or ""), "x", "y", 5, 6, 0.5, "r", "z", "w", "q") for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables: fewer tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
