"""Tokens, licences, quality, rules and packing against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyfold.llm import licenses, packing, pieces, quality, queries, rules
from skyfold.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "   a  b ", "a\n\n b\tc\r\n", "▁x▁▁y", "日本語 テキスト", "😀é́ ﬁ", "\x00a", "<s> </s> <0x41>", "x" * 5000,
    "aaaa bbbb " * 900, "ΑΒΓ абв " * 50, "　 ​", "same", "same",
]


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def real(spark, sf):
    return table(spark, sf, "documents")


def test_pieces_equal_the_library(docs_of, real):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (docs_of(ODD), real):
        got = rows_by_id(pieces.round_trip_digests(docs, MODEL))
        expected = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        assert len(got) == len(expected)
        for doc, text in expected:
            ids = model.encode(text, add_bos=True, add_eos=True)
            assert got[doc]["n_tokens"] == len(ids), text[:50]
            assert got[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[doc]["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_pieces_random_units_equal_merging():
    own = pieces.codec(MODEL).table
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    vocabulary = list(own.id)
    for _ in range(3000):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5)))
        assert np.frombuffer(pieces.codec(MODEL).encode(text), "<u4").tolist() == model.encode(text, add_bos=True, add_eos=True), text


def test_encode_then_decode(docs_of):
    docs = docs_of(ODD)
    back = rows_by_id(pieces.decode_documents(pieces.encode_documents(docs, MODEL), MODEL))
    for r in docs.collect():
        assert back[r["doc_id"]]["text"] == (r["text"] or "").replace("▁", " ")


def test_license_base_equals_brute_force(docs_of, real):
    odd = docs_of([*ODD, "MIT License", "x Mit  license,mit-license apache\nLICENSE", "GNU General Public License general public licenses", "émit license"])
    for docs in (odd, real):
        got = rows_by_id(licenses.scan(docs))
        for r in docs.collect():
            low = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
            words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
            places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            row = got[r["doc_id"]]
            starts = [i for i, _ in places]
            assert (row["n_words"], row["n_base"]) == (len(words), len(places))
            assert (row["first_word"], row["last_word"]) == (min(starts, default=None), max(starts, default=None))
            assert row["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
            assert 0 <= row["score"] <= 1


def test_license_templates(docs_of):
    label, text, phrase = licenses.TEMPLATES[0]
    words = text.split()
    broken = text.replace(phrase.split()[3], "never", 1)
    near = " ".join(words[:-3] + ["something", "else", "here"])
    got = rows_by_id(licenses.scan(docs_of([f"intro {text.upper()} outro", broken, near, "permission granted", *[t for _, t, _ in licenses.TEMPLATES]])))
    assert got[0]["labels"] == label and got[0]["score"] == 1.0
    assert got[1]["labels"] == ""
    assert got[2]["labels"] == label and 0.5 < got[2]["score"] < 1.0
    assert got[3]["labels"] == ""
    for k, (own, _, _) in enumerate(licenses.TEMPLATES):
        assert own in got[4 + k]["labels"].split(",")


def test_license_files_with_several_templates(docs_of):
    full = [t for _, t, _ in licenses.TEMPLATES]
    scattered = " ".join(sorted({w for t in full for w in t.split()}))
    texts = [f"{a}\n\n{b}" for a in full for b in full if a != b] + [" - ".join(full), " - ".join(full[::-1])]
    texts += [f"{scattered}\n{phrase}\n{scattered}" for _, _, phrase in licenses.TEMPLATES] + [scattered]
    got = rows_by_id(licenses.scan(docs_of(texts)))
    for k, text in enumerate(texts):
        words = f" {' '.join(licenses.words_of(text.encode())[i].decode() for i in range(got[k]['n_words']))} "
        expected = {label for label, _, phrase in licenses.TEMPLATES if f" {phrase} " in words}
        assert expected == set(filter(None, got[k]["labels"].split(","))) - set(licenses.PHRASES.values()), text
    assert expected == set()


def test_quality_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out")
    rows = held.select("quality", "predicted", "score").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_edges(spark, docs_of):
    docs = docs_of([*((i, t) for i, t in enumerate(ODD)), (None, "no id"), (3, "repeated id")])
    few = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (None, 1), (4, None), (5, 1), (5, 0)], "doc_id long, quality int")
    for labels in (few, few.limit(0)):
        rows = quality.classify(docs, labels).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(docs.limit(0), few).count() == 0
    model = quality.train(docs, few)
    wide = docs.withColumn("score", F.lit("own")).withColumn("predicted", F.lit(1))
    assert quality.keep_good(wide, model).columns == wide.columns


def brute_rules(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_rules_equal_brute_force(docs_of, real):
    odd = docs_of([*ODD, "a b c d e f g h " * 3, "l1 x\nl1 x\n \n \nl1 x", "w " * 19, "w " * 20, " ".join(map(str, range(9))) + " 1 2 3 4 5 6 7 8 0", "#|<>" * 9, "a\x0bb\x0cc d"])
    for docs in (odd, real):
        got = rows_by_id(rules.verdicts(rules.ledger(docs)))
        for r in docs.collect():
            n, chars, symbols, dup, repeat, lines = brute_rules(r["text"] or "")
            row = got[r["doc_id"]]
            assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
            failed = n < 20 or 100 * repeat > 30 * n
            assert row["base_failed"] == failed
            assert row["kept"] == (not failed and 10 * symbols <= n and 2 * dup <= lines and 2 * n <= chars <= 15 * n)


def test_rule_policies_and_ablations(docs_of, real):
    recorded = rules.ledger(real)
    bits = [r["fail_bits"] for r in recorded.collect()]
    for version in rules.POLICIES:
        mask = rules.mask_of(rules.POLICIES[version])
        for r in rules.ablations(recorded, version).collect():
            bit = rules.mask_of((r["rule"],))
            assert r["failed"] == sum(b & bit != 0 for b in bits)
            assert r["failed_only"] == sum(b & mask == bit for b in bits)
            assert r["kept_without"] == sum(b & mask & ~bit == 0 for b in bits)
    assert rules.ablations(rules.ledger(real.limit(0))).count() == 0


def test_rules_keep_whole_rows(docs_of):
    docs = docs_of([*ODD, (None, "one two three four five six seven eight nine ten " * 1 + " ".join(map(str, range(100, 120))))])
    wide = docs.withColumn("n_words", F.lit("own")).withColumn("kept", F.lit(3)).withColumn("words", F.lit(0.5))
    kept = rules.keep_passing(wide)
    assert kept.columns == wide.columns
    assert [r["doc_id"] for r in kept.collect()] == [None]
    assert rules.keep_passing(wide.limit(0)).count() == 0


def pack_all(docs):
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_packing_equals_the_tokenizer(docs_of, real):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for docs in (docs_of([*ODD, (None, "no id"), "it's <|endoftext|> " * 4000]), real):
        found = pack_all(docs).collect()
        by_doc = {}
        for r in found:
            by_doc.setdefault(r["doc_id"], []).append(r)
        for r in docs.collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            own = sorted(by_doc[r["doc_id"]], key=lambda x: x["start"])
            assert own[0]["doc_tokens"] == len(ids)
            at = 0
            for x in own:
                assert x["start"] == at and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
                at += x["length"]
            assert at == len(ids)
        sequences = {}
        for r in found:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r["length"] for r in found)
        assert len(sequences) <= total / 2048 * 1.05 + 1
    assert pack_all(docs_of(["x"]).limit(0)).count() == 0


def test_registered_packing_equals_the_tokenizer_as_loaded(spark, docs_of, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x  {end}  y\n{end}", f"it's {end} " * 4000, "<|endoftext", "<|ENDOFTEXT|>", f"é{end}日", None, *ODD]
    docs = docs_of(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for found in (queries.op9_tree_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        by_doc = {}
        for r in found.collect():
            by_doc.setdefault(r["doc_id"], []).append(r)
        for k, text in enumerate(texts):
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[k])
            assert own == [(at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]


def test_packing_repeated_rows(docs_of):
    found = pack_all(docs_of([(7, "the same row")] * 5)).collect()
    assert len(found) == 5 and len({(r["sequence_id"], r["offset"]) for r in found}) == 5


def test_first_fit_decreasing_equals_a_scan():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 300):
        sizes = np.array([rng.randint(1, 2048) for _ in range(n)], np.int64)
        bins, offsets = packing.first_fit_decreasing(sizes)
        used: list[int] = []
        for k in np.argsort(-sizes, kind="stable"):
            b = next((i for i, u in enumerate(used) if u + sizes[k] <= 2048), len(used))
            used[b:b] = [0] if b == len(used) else []
            assert (bins[k], offsets[k]) == (b, used[b])
            used[b] += sizes[k]


EVERY = {
    "pieces": lambda docs: pieces.round_trip_digests(docs, MODEL),
    "encode": lambda docs: pieces.decode_documents(pieces.encode_documents(docs, MODEL), MODEL),
    "licenses": licenses.scan,
    "rules": lambda docs: rules.verdicts(rules.ledger(docs)),
}


@pytest.mark.parametrize("name", sorted(EVERY))
def test_odd_tables_keep_their_rows(docs_of, name):
    """Null and repeated ids, repeated rows, a very long text, clashing extra columns, narrow ids, no rows."""
    rows = [(None, "no id"), (None, None), (1, "once"), (1, "once"), (1, "other"), (2, "long words " * 60_000), (3, "y" * 300_000)]
    docs = docs_of(rows).withColumn("n_words", F.lit("own")).withColumn("ids", F.lit(1)).withColumn("score", F.lit(None)).withColumn("m", F.lit(2))
    got = EVERY[name](docs).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert EVERY[name](docs.withColumn("doc_id", F.col("doc_id").cast("int"))).count() == len(rows)
    assert EVERY[name](docs.limit(0)).count() == 0


def test_packing_odd_table(docs_of):
    rows = [(None, "no id"), (None, None), (1, "once"), (1, "once"), (2, "long words " * 60_000)]
    docs = docs_of(rows).withColumn("length", F.lit("own")).withColumn("group", F.lit(1))
    found = pack_all(docs).collect()
    assert sum(r["start"] == 0 for r in found) == len(rows)
    assert all(r["length"] <= 2048 for r in found)
