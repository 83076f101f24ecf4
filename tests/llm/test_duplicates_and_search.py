"""Near-duplicates, repeated strings, neighbours and the pipeline against brute force on small tables."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.llm import neardup, neighbours, packing, quality, rules, suffixes
from skyfold.llm.common import table

# --- repeated strings -------------------------------------------------------------------------------------------------


def brute_spans(docs):
    first = {}
    for d, t in docs:
        rank = suffixes.LAST_ID if d is None else d
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], rank), rank)
    out = []
    for d, t in docs:
        rank = suffixes.LAST_ID if d is None else d
        covered = [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < rank:
                covered[i : i + 50] = [True] * 50
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((d, len(t), sum(covered), spans, bytes(b for b, c in zip(t, covered, strict=True) if not c)))
    return out


def repeating_texts(rng, n, alphabet):
    make = lambda size: "".join(rng.choice(alphabet) for _ in range(size))
    passages = [make(rng.choice([24, 25, 50, 51, 90, 300])) for _ in range(6)]
    return ["".join(rng.choice([make(rng.randint(0, 60)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 700, "BUCKET_HASHES": 60}, {"BLOCK_BYTES": 700, "BUCKET_HASHES": 60, "FREQUENT": 3}, {"SHARD_BYTES": 400, "RUN_WINDOWS": 40}])
def test_repeats_equal_brute_force(docs_of, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(len(limits))
    texts = [(rng.choice([k, k, k, None, 3]), t) for k, t in enumerate(repeating_texts(rng, 60, "abc é日 "))]
    texts += [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 50), (104, "x" * 50), (105, "y" * 5000), (106, "y" * 3000), (107, "same " * 40), (107, "same " * 40)]
    docs = docs_of(texts)
    expected = sorted(((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute_spans([(d, (t or "").encode()) for d, t in texts])), key=str)
    assert sorted((tuple(r) for r in suffixes.digests(docs).collect()), key=str) == expected


def test_repeats_cut_from_documents(docs_of):
    shared = "é" * 60
    docs = docs_of([(1, "a " + shared), (2, shared + " b"), (3, None), (4, "short")]).withColumn("rest", F.lit("own")).withColumn("kept", F.lit(1)).withColumn("missing", F.lit(2))
    got = suffixes.without_repeats(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["text"] == "a " + shared and rows[2]["text"] == " b" and rows[2]["n_chars"] == 2
    assert rows[3]["text"] is None and rows[4]["rest"] == "own"
    assert suffixes.digests(docs.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for n in (50, 51, 900):
        text = bytes(rng.choice(b"ab") for _ in range(n)) if n > 60 else b"a" * n
        data = np.frombuffer(text, np.uint8)
        marked = np.arange(n) + 50 <= n
        whole = suffixes.suffix_order(data, marked)[0].tolist()
        assert whole == sorted(range(n - 49), key=lambda i: (text[i : i + 50], i))
        before = np.full(n, -1)
        before[whole[1:]] = whole[:-1]
        found = suffixes.common_prefixes(suffixes.eight_bytes(data), np.array([0]), np.array([n - 49]), before, marked)
        for a, b in zip(whole, whole[1:], strict=False):
            assert found[b] == next((k for k in range(50) if text[a + k] != text[b + k]), 50)


# --- near-duplicates --------------------------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b):
            previous, row[j + 1] = row[j + 1], previous + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randint(0, rng.choice([3, 50])) for _ in range(rng.randint(0, 120))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 60))
        full = lcs(a, b)
        band = len(a) + len(b) - 2 * full
        assert neardup.common_in_order(np.array(a, np.uint64), np.array(b, np.uint64), max(1, band)) == full
        total = len(a) + len(b)
        assert neardup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (9 * full >= 4 * total)


def brute_classes(docs):
    tokens = [neardup.shingles(t or "").tolist() for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = tokens[i], tokens[j]
            equal = (docs[i][1] or "") == (docs[j][1] or "")
            close = a and b and 9 * min(len(a), len(b)) >= 4 * (len(a) + len(b)) and len(set(a) & set(b)) * 3 >= min(len(set(a)), len(set(b)))
            if equal or close and 9 * lcs(a, b) >= 4 * (len(a) + len(b)):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        ids = [x for x in (smallest.get(r), d) if x is not None]
        smallest[r] = min(ids, default=None)
    return [(d, smallest[root(i)]) for i, (d, _) in enumerate(docs)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randint(0, 9999)}"
    return " ".join(words)


def near_texts():
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(500)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(60)
    bases = [prose(rng.randint(60, 200)) for _ in range(12)]
    texts = []
    for base in bases:
        texts.append(" ".join(base))
        texts += [edited(rng, base, rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
    star = prose(150)
    texts += [" ".join(star), *(edited(rng, star, rng.randint(1, 3)) for _ in range(60))]
    texts += [" ".join(prose(rng.randint(20, 150)) + passage + prose(rng.randint(20, 150))) for _ in range(30)]
    texts += ["one two three", "one two three", "one two", "", "  ", "\n", "a b c d e", "a b c d e f", "z " * 300, "z " * 310, "z " * 100]
    return texts + [" ".join(bases[0][:40])]


def test_classes_equal_brute_force(docs_of):
    docs = [(k * 3 if k % 17 else k, t) for k, t in enumerate(near_texts())] + [(None, "one two three"), (None, None), (5000, None), (None, "alone here")]
    got = neardup.class_of_documents(docs_of(docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute_classes(docs), key=str)


def test_one_document_of_each_class_stays(docs_of):
    docs = [*enumerate(near_texts()), (7, near_texts()[7]), (None, "alone here"), (None, "alone here")]
    wide = docs_of(docs).withColumn("rank", F.lit("own")).withColumn("node", F.lit(1)).withColumn("document", F.lit(2))
    kept = neardup.keep_first(wide)
    assert kept.columns == wide.columns
    rows = kept.collect()
    expected = {c for _, c in brute_classes(docs)}
    assert {r["doc_id"] for r in rows} == expected and len(rows) == len(expected)
    assert all(r["rank"] == "own" for r in rows)
    assert neardup.keep_first(wide.limit(0)).count() == 0
    assert neardup.class_of_documents(wide.limit(0)).count() == 0


def test_links_that_bypass_every_hub(docs_of):
    """Copies that are too far from the text they were made from, and among them pairs of siblings and a chain."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(300)]
    words = lambda at, mark: [f"{mark}{k}" if k in at else w for k, w in enumerate(base)]
    texts = [" ".join(base)]
    for k in range(150):
        at = set(range(rng.randint(0, 7), 300, 27 + k % 4))
        own = words(at, f"s{k}_")
        texts.append(" ".join(own))
        for sibling in range(2 if k % 10 == 0 else 0):
            own = [f"t{k}_{sibling}" if i == 40 + 90 * sibling else w for i, w in enumerate(own)]
            texts.append(" ".join(own))
    held = [neardup.shingles(t) for t in texts]
    smallest = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if smallest[a] != smallest[b] and neardup.similar(held[a], held[b]):
                low, high = sorted((smallest[a], smallest[b]))
                smallest = [low if x == high else x for x in smallest]
    got = neardup.class_of_documents(docs_of(texts)).collect()
    assert sorted(tuple(r) for r in got) == list(enumerate(smallest))


def test_links_between_classes_need_no_hub(spark):
    """Every similar pair of two classes is found; most others are ruled out without their texts."""
    rng = random.Random(12)
    texts = []
    for size in (1, 3, 9, 14, 60, 400):
        base = [f"b{size}_{k}" for k in range(size)] + (["same"] * 7 if size == 60 else [])
        for k in range(40):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, size // 60, size // 25])):
                at = rng.randint(0, len(own))
                own[at : at + rng.randint(0, 2)] = [f"x{rng.randint(0, 10**6)}"] * rng.randint(0, 2)
            texts.append(" ".join(own))
    held = [neardup.shingles(t) for t in texts]
    label = [k - k % 4 if k % 3 else k for k in range(len(texts))]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    apart = spark.createDataFrame(list(enumerate(label)), "node long, label long")
    seen = spark.createDataFrame([(0, 2)], "a long, b long")
    got = {tuple(r) for r in neardup._pairs_apart(apart, rows, seen).collect()}
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if label[a] != label[b] and (a, b) != (0, 2)]
    similar = {(a, b) for a, b in pairs if len(held[a]) and len(held[b]) and neardup.similar(held[a], held[b])}
    assert similar <= got <= set(pairs) and len(similar) > 500
    assert len(got) < 0.25 * len(pairs)


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in neardup.components(path).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_more_neighbours_than_usual_of_shared_vectors(spark):
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(40)] + [(k, [float(k), 0.0, 1.0, 2.0]) for k in range(40, 70)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in neighbours.search(vectors, vectors.where("vec_id = 0"), nearest=50, coverage=1.0).collect())
    assert [v for _, v in got[:39]] == list(range(1, 40)) and len(got) == 50


# --- neighbours -------------------------------------------------------------------------------------------------------


def brute_nearest(rows, queries, k=10):
    out = {}
    for q, v in queries:
        found = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)[:k]
        out[q] = found
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_recall(spark, sf):
    vectors = table(spark, sf.replace("sf0.001", "sf0.1"), "embeddings")
    got = collected(neighbours.search(vectors, vectors.where("vec_id % 100 = 0")))
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in vectors.collect()]
    want = brute_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0])
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        for score, i in found:
            assert score == pytest.approx(float(np.sqrt(((exact[i] - exact[q]) ** 2).sum())), rel=1e-12)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, []), (9, [3.0]), (10, [2.0, 2.0]), (10, [2.0, 2.0])]
    rows += [(k, [1.0, 2.5]) for k in range(20, 60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("cell", F.lit(1)).withColumn("ids", F.lit("own"))
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    got = collected(neighbours.search(vectors, vectors.where("vec_id % 100 = 0")))
    assert got == brute_nearest(good, [r for r in good if r[0] % 100 == 0])
    few = vectors.where("vec_id in (0, 100, 10)")
    assert collected(neighbours.search(few, few.where("vec_id = 0"))) == {0: [(0.0, 100), (1.0, 10)]}
    assert neighbours.search(vectors.limit(0), vectors).count() == 0
    assert neighbours.search(vectors, vectors.limit(0)).count() == 0


def test_walk_visits_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    index = neighbours.Index(rng.normal(size=(500, 6)), 7)
    held = rng.integers(0, 3, 49)
    a, b = (x[0] for x in index.distances(rng.normal(size=(1, 6))))
    total = (a[:, None] + b[None]).ravel()
    assert index.walk(a, b, held, 10**9) == [c for c in np.argsort(total, kind="stable").tolist() if held[c]]


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.collect()]
    model = quality.train(docs, table(spark, sf, "labels"))
    scorer = quality.Scorer(model)
    rows = [r for r in rows if scorer.score((r[1] or "").encode()) >= quality.THRESHOLD]
    passing = {r["doc_id"] for r in rules.verdicts(rules.ledger(docs)).where("kept").collect()}  # held against brute force in its own test
    rows = sorted(r for r in rows if r[0] in passing)
    kept = {c for _, c in brute_classes([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if r[0] in kept]
    left = [(d, k.decode("utf-8", "ignore")) for d, _, _, _, k in brute_spans([(r[0], r[1].encode()) for r in rows])]
    import public_tokenizers

    encoding = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = {d: len(encoding.encode_ordinary(t)) + 1 for d, t in left}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == expected
    assert sum(r["length"] for r in got) == sum(expected.values())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and 0 < len(expected) < docs.count()


def test_pipeline_stages_return_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, sf)
        assert after.schema.names == docs.schema.names and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        assert corpus_pipeline.STAGES and function(spark, docs.limit(0), sf).count() == 0
