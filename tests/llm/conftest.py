import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text, source) rows."""

    def one(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
        if extra:  # columns that clash with names the operators use
            from pyspark.sql import functions as F

            for c in ("size", "rank", "shard", "score", "b", "k", "th", "id", "rep", "component_id", "source_size", "target", "__n", "__k", "__ss", "__t", "__id", "__th", "__spans", "__gone", "the_id", "the_hash", "the_number", "the_spans", "n_tokens", "ids", "decoded_sha256"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return one


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "é", "shon", "ver"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    rows = []
    for i in range(60):
        t = prose(rng.randint(3, 160))
        if i % 5 == 0:
            t = t + ". " + passage + " " + prose(4)
        rows.append((i * 3, t, f"s{i % 4}" if i % 3 else "hot"))
    base = prose(120).split()
    for i in range(25):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w), "hot"))
    for i in range(20):  # copies
        rows.append((900 - i, passage, "hot"))
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "   \n\t ", None), (2003, "one two", "s1"), (2004, "ONE two", "s2"), (2005, "a" * 300, "s2"), (2006, "ab" * 20000, "s2"), (2007, prose(9000), "s1")]
    rows += [(7, "same row twice, more or less, with some words to fill it up to fifty bytes", "s1")] * 2 + [(None, passage, None), (None, None, None)]
    return rows
