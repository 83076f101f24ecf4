"""Translators and resolvers that a user plugs in, and candidates of the partition join."""

import random

import pytest
from pyspark.sql import functions as F

from skyfold.operators import matching, providers


def shouting():
    return lambda texts: [t.upper() if t.startswith("a") else None for t in texts]


def short_of_one():
    return lambda texts: texts[1:]


def test_translator_gets_distinct_unknown_texts(spark):
    texts = spark.createDataFrame([("abc",), ("abc",), ("xyz",), (None,), ("known.",)], "text string")
    catalog = spark.createDataFrame([(1, "KNOWN", "hi", "pehchana"), (2, "known", "hi", "later"), (3, "abc", "en", "no")], "pos int, source_text string, lang string, text string")
    got = sorted((str(r["text"]), r["translated"]) for r in providers.translate(texts, catalog, "hi", shouting).collect())
    assert got == [("None", None), ("abc", "ABC"), ("abc", "ABC"), ("known.", "pehchana"), ("xyz", "xyz")]
    assert providers.translated_by(texts, shouting).collect()[0]["translated"] == "ABC"
    with pytest.raises(Exception, match="came back as"):
        providers.translated_by(texts, short_of_one).collect()


def test_unknown_resolver(spark):
    with pytest.raises(KeyError):
        providers.district_means({}, "gadm", spark.range(1), [], [])


@pytest.mark.parametrize("cutoff", [0.6, 0.85, 0.95])
def test_partition_join_finds_every_similar_pair(spark, cutoff):
    import difflib

    rng = random.Random(int(cutoff * 100))
    names = {"".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14))) for _ in range(60)}
    for n in list(names):
        cut = list(n + "x")
        for _ in range(rng.randint(0, 3)):
            if not cut:  # all letters are taken out already
                break
            at = rng.randrange(len(cut))
            cut[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
        names.add("".join(cut))
    pool = spark.createDataFrame([("s", n) for n in sorted(names)], "_s string, cand string")
    words = pool.select("_s", F.col("cand").alias("word"))
    found = {(r["word"], r["cand"]) for r in matching.similar_candidates(words, pool, cutoff).collect()}
    similar = {(w, c) for w in names for c in names if difflib.SequenceMatcher(None, c, w).ratio() >= cutoff}
    assert similar <= found
