import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns named like operators' own and results' columns, to clash with them.
CLASHES = ["n_words", "n_removed", "spans", "kept_text", "n_bytes", "n_tokens", "over_limit", "license_id", "score", "kept", "held_out", "predicted", "size", "target", "taken", "class_id", "copies", "keeper", "chunk", "row", "text2"]


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage = prose(rng, 40, 10**6)
    out = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    out += [(100 + i, base[i], "s0") for i in range(12)]  # copies
    for i in range(20, 40):  # near copies
        w = base[i].split()
        w[len(w) // 2] = "changed"
        out.append((200 + i, " ".join(w), None))
    out += [(300 + i, prose(rng, 30) + "\n" + passage + "\t" + prose(rng, 10), "s1") for i in range(8)]
    out += [(400, None, "s1"), (401, "", "s2"), (402, " \n\t ", None), (403, prose(rng, 6000, 900), "s3"), (404, "é\x0bü\x1cß ñ " * 30, "é")]
    out += [(405, "a b c d e f g h " * 40, "s3"), (300, passage, "s1"), (None, passage + " tail", "s1"), (None, None, None)]
    out += [out[3], out[3], out[64]]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
