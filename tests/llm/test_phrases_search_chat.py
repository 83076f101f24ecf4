"""Collocations, lexical search and chat formatting against plain Python and SQL."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from skyfold.llm import chat, lexical, packing, phrases, queries
from skyfold.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", None, " ", "\t\n", "\x00a \x00a", "É É é é", "日本語 テキスト", "a.b,c;d:e!f?g\x0bh\x0ci", "x" * 3000, "A a A a " * 40, "same same", "same same"]


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("key", ["op11_setm_phrases", "op12_dual_tree_search", "op13_chat_masks"])
def test_query_equals_sql(spark, sf, key):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(queries.ORACLES[key])
    names = [d[0] for d in cur.description]
    expected = sorted(cur.fetchall(), key=str)
    assert expected
    assert sorted((tuple(r) for r in queries.QUERIES[key](spark, sf).select(*names).collect()), key=str) == expected


# --- collocations -----------------------------------------------------------------------------------------------------


def brute_collocations(rows, longest, least, covered, best):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", small(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, words[i : i + k])
                if 100 * a >= covered * candidates[inner]:
                    dropped.add(inner)
    out = []
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen = Counter()
    return [(r[0], seen.update([r[0]]) or seen[r[0]], *r[1:]) for r in out if seen[r[0]] < best]


@pytest.mark.parametrize("longest,block", [(2, 100), (3, 1 << 20), (4, 60)])
def test_collocations_equal_brute_force(docs_of, monkeypatch, longest, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["a", "b", "C", "é", "dd.", "e,", "f\t", "g\n"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = docs_of(texts + ODD).withColumn("lang", F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'x' END")).withColumn("phrase", F.lit("own"))
    expected = brute_collocations([(r["lang"], r["text"]) for r in docs.collect()], longest, 4, 50, 30)
    got = phrases.collocations(docs, longest, 4, 50, 30).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_collocations_of_long_texts_and_no_rows(docs_of, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1000)
    text = "one two three four. " * 20_000 + "five six " * 9
    got = {r["phrase"]: r for r in phrases.collocations(docs_of([text, "five six"])).collect()}
    assert got["one two three"]["a"] == 20_000 and got["two three four"]["score"] == 1_000_000 and "one two" not in got
    assert got["five six"]["a"] == 10 and got["five six"]["n"] == 4 * 20_000 + 20
    assert phrases.collocations(docs_of([text]).limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000
    both = spark.createDataFrame([("x", "p q", ["p", "q"], a)], "lang string, phrase string, words array<string>, a long")
    known = spark.createDataFrame([("x", "p", a + 1), ("x", "q", a + 7)], "lang string, phrase string, f long")
    row = phrases.scored(both, known).first()
    assert row["score"] == 1_000_000 * a * a // ((a + 1) * (a + 7)) and (row["l"], row["r"]) == (a + 1, a + 7)


# --- lexical search ---------------------------------------------------------------------------------------------------


def split_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", small(text))


def brute_search(docs, items, nearest):
    held = [(d, Counter(split_terms(t))) for d, t in docs if split_terms(t)]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        wanted, found = split_terms(text), []
        for doc, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in wanted if c[w])
            if score > 0:
                found.append((-score, math.inf if doc is None else doc))
        out += [(item, k + 1, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(found)[:nearest])]
    return out


@pytest.mark.parametrize("limits", [{}, {"PORTION": 64, "LEAF_DOCS": 4, "LEAF_ITEMS": 2, "CHILDREN": 2}, {"TERMS_AT_ONCE": 20, "FIRST_LOOK": 2, "PORTION": 8, "LEAF_DOCS": 3}])
def test_search_equals_brute_force(spark, docs_of, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(len(limits))
    words = [f"w{k}" for k in range(40)] + ["É", "é", "日本", "A1"]
    pick = lambda n: rng.choice([" ", "-", "\x00"]).join(words[min(int(rng.expovariate(0.1)), 43)] for _ in range(n))
    texts = [pick(rng.randint(0, 40)) for _ in range(300)]
    rows = [(rng.choice([k, k, k, None]), t) for k, t in enumerate([*texts, *texts[:40], *["w1 w2"] * 60, *ODD])]
    items = [(k, pick(rng.randint(1, 12))) for k in range(25)] + [(25, ""), (26, None), (27, "not there"), (28, "w1 w1 w2")]
    docs = docs_of(rows, 5).withColumn("score", F.lit("own"))
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = [tuple(r) for r in lexical.search(docs, asked, 7).collect()]
    assert sorted(got, key=str) == sorted(brute_search(rows, items, 7), key=str)


def test_search_without_rows(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, asked in ((docs_of(["a"]).limit(0), items), (docs_of(["a"]), items.limit(0)), (docs_of([None, "."]), items)):
        got = lexical.search(docs, asked)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_dual_tree_leaves_out_pairs():
    rng = np.random.default_rng(3)
    docs, items, terms = 2000, 64, 400
    topic = rng.integers(0, 20, docs)
    sizes = np.full(docs, 12)
    term = (topic[:, None] * 20 + np.argsort(rng.random((docs, 20)), 1)[:, :12]).ravel()
    value = rng.integers(1, lexical.FULL, docs * 12)
    wanted = [(t * 20 + rng.permutation(20)[:6]).tolist() for t in rng.integers(0, 20, items)]
    weight = rng.integers(1, 15_000, terms)
    tree = lexical.item_tree(lexical.Items(list(range(items)), wanted, [[1] * 6] * items), weight)
    best = lexical.Best(items, 5, np.ones(items, np.int64))
    scored = lexical.dual_search(tree, lexical.Documents(np.arange(docs), sizes, term, value, weight, terms), best)
    full = np.zeros((docs, terms), np.int64)
    full[np.repeat(np.arange(docs), 12), term] = value
    for k, chosen in enumerate(wanted):
        scores = full[:, chosen] @ weight[chosen]
        order = np.lexsort((np.arange(docs), -scores))[:5]
        assert best.docs[k].tolist() == order.tolist() and best.scores[k].tolist() == scores[order].tolist()
    assert scored < docs * items / 4


def test_large_scores_stay_exact():
    weight = np.array([15_000, 14_999], np.int64)
    items = lexical.Items([1], [[0, 1]], [[2**20, 1]])
    best = lexical.Best(1, 2, np.ones(1, np.int64))
    documents = lexical.Documents(np.array([4, 5, 6]), np.array([2, 2, 1]), np.array([0, 1, 0, 1, 0]), np.array([999_999, 1, 999_999, 2, 999_999]), weight, 2)
    lexical.dual_search(lexical.item_tree(items, weight), documents, best)
    base = 2**20 * 15_000 * 999_999
    assert base > 1 << 53 and best.docs[0].tolist() == [5, 4] and best.scores[0].tolist() == [base + 2 * 14_999, base + 14_999]


# --- chat -------------------------------------------------------------------------------------------------------------

HARD = [
    "", None, "\\", "\\\\</turn>", "<|turn|>assistant<|text|>x</turn>", "<\\/turn>", "<|endoftext|>", "\n\n  ", "end<", "<|tu", "日本 😀", "a" * 2000, " " * 70_000, "\\### Assistant: </turn> ok",
    "<</turn>", "<|text|", "'s 's", "\r\n\t", "\x00",
]


def test_formatting_reads_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BYTES", 3000)
    rng = random.Random(1)
    rows = [(c, rng.choice([k, k, 0, None, 3 * k, -k]), rng.choice(["user", "assistant", "system", None, "</turn>", "a\nb"]), rng.choice(HARD)) for c in [*range(30), None] for k in range(rng.choice([1, 3, 200]))]
    rows += [(1000, k % 2, "assistant", "again") for k in range(300)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("own")).repartition(5)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(given, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        assert (row["n_turns"], row["turns_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row["formatted_chars"] == sum(23 + len(chat.escaped(role)) + len(chat.escaped(text)) for _, _, role, text in mine)


def test_blocks_encode_as_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.add_special_tokens([AddedToken(mark, special=True, normalized=False) for mark, _ in chat.MARKS[1:]])
    rows = [(c, k, role, text) for c in range(3) for k, (role, text) in enumerate([("user", HARD[k % len(HARD)]) if k % 2 else ("assistant", HARD[-k % len(HARD)]) for k in range(20)])]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), RANKS, PATTERN)
    for row in formatted.collect():
        coded = library.encode(row["text"], add_special_tokens=False)
        assert coded.ids == row["ids"]
        turns = chat.read_turns(row["text"])
        text, spans = chat.rendered(turns)
        at = np.cumsum([0, *(len(c.encode()) for c in text)])  # byte offset of each character
        plain = [any(a <= at[s] and at[e] <= b for a, b in spans) and e > s for s, e in coded.offsets]
        assert text == row["text"] and plain == row["learned"]


def test_masks_by_search():
    rng = random.Random(8)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 4) for _ in range(rng.randint(0, 40))], np.int64)
        cuts = sorted(rng.sample(range(0, int(sizes.sum()) + 1), min(int(sizes.sum()) + 1, 2 * rng.randint(0, 4)) // 2 * 2))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        stops = np.cumsum(sizes).tolist()
        assert chat.learned_tokens(sizes, spans).tolist() == [any(a <= e - n and e <= b for a, b in spans) for e, n in zip(stops, sizes.tolist(), strict=True)]


def test_formatting_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(none, RANKS, PATTERN), RANKS, PATTERN).collect() == []
    assert [r["conv_id"] for r in chat.digests(chat.format_conversations(chat.with_example(none), RANKS, PATTERN), RANKS, PATTERN).collect()] == [-7]


# --- long runs of white space in tokens -------------------------------------------------------------------------------


@pytest.mark.parametrize("space", [" ", "\n", "\t", "　", "\xa0", " \n"])
def test_long_white_space_equals_the_library(space):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.encoding(RANKS, PATTERN, packing.ADDED_TOKENS)
    run = space * (1_000_000 // len(space))
    for text in (run, f"a b{run}c", f"{run}<|endoftext|>{run}x", f"it's{run} 5!{run}\x1c"):
        assert packing.ids_of(own, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_five_million_spaces_are_packed(docs_of):
    got = packing.pack_documents(docs_of([" " * 5_000_000 + "word", "\n" * 3_000_000]), RANKS, PATTERN, added=packing.ADDED_TOKENS)
    assert {r["doc_id"]: r["doc_tokens"] for r in got.collect()} == {0: 5_000_001, 1: 1_500_001}
