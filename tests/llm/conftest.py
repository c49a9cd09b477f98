import random

import pytest

SYLLABLES = ["an", "er", "tion", "the", "re", "on", "at", "en", "nd", "ti", "es", "or", "ha", "st", "ing", "ly"]


def prose(rng, words):
    out = []
    for _ in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(["", "", "", ",", "."]))
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, block int"


def frame(spark, rows):
    """(doc_id, text) pairs as documents with extra columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, 0, 9.0, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    """Plain, empty, null, repeated, tied and very long texts; null and repeated ids."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, prose(rng, 30)), (None, None), (103, rows[5][1]), (104, rows[5][1].upper()),
             (105, rows[7][1]), (105, rows[7][1]), (106, prose(rng, 30_000)), (107, "Ünï Çödé ÀÉ 日本 語。 <|endoftext|> x</s>  y \x1c z"),
             (108, "one two"), (109, "one two")]
    long = rows[5][1].split()
    rows.append((110, " ".join(long[:-1])))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    df = frame(spark, texts)
    path = spark.conf.get("spark.checkpoint.dir") + "/test-documents"
    df.repartition(4, "text").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs, spark):
    return spark.createDataFrame([], docs.schema)
