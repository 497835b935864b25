import random

import pytest
from pyspark.sql import types as T

#: Columns whose names the operators also use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("digest", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("kept", T.BooleanType()), T.StructField("_text", T.StringType())])


def make_rows(seed=3):
    """Documents with copies, near copies, shared passages, self repeats, nulls, empty and long texts."""
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "the of and to in la le der die que".split() for b in ("", "n", "s,", "t.", "é", "ß")]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    passage, base = prose(60), prose(120).split()
    texts = [prose(draw.randint(1, 200)) for _ in range(30)]
    texts += [prose(40) + "\n" + passage + "\n" + prose(20), passage + " " + prose(70), prose(3) + " " + passage]
    for _ in range(8):
        near = list(base)
        near[draw.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(base), " ".join(base), "  ".join(base), texts[0], texts[0], "Und " * 90, "ab cd " * 60 + prose(30)]
    texts += ["", None, " \n\t ", "a", "a b", "a  b", "x" * 5000, prose(6000), "one line\none line\none line", "it's ▁ 5% <|endoftext|> é́ İ ς"]
    rows = [(n, t, draw.choice(["en", "fr", "de", None, "xx"]), f"r{n}", n, n, True, None) for n, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], "en", None, None, None, None, None), (None, texts[1], "en", None, None, None, None, None),
             (None, None, None, None, None, None, None, None), (7, "another text under a known id", "en", "", 1, 1, False, "")]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def as_rows():
    return collected
