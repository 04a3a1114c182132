"""Encoding, secrets, classifiers and language against libraries, plain versions and held-out labels."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from odd_rows import ODD
from tokenizers import Tokenizer

from debtscope.llm import bpe, labelled, langid, linear, quality, secret_scan, toxicity
from debtscope.llm.common import batched, chunks, table

SF_DIR = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_put_together_are_the_text():
    text = "ab cd\n" * 100 + "x" * 50
    assert "".join(chunks(text, 7)) == text and "".join(chunks("", 7)) == ""


def test_encoding_equals_the_library(spark):
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    rng = random.Random(1)
    letters = "aB'sÉΣςİßẞǅ中 \n\t\x1c\x85!?#12½é<|endoftext|>🙂'LL'Re don't"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", "<|endoftext|>x<|startoftext|>", "a" * 3000, "ab" * 2000 + "é" * 300, "ΑΣ ΑΣΑ", "!?" * 500]
    for text, found in zip(texts, own.code(texts)):
        ids, decoded = own.texts(found)
        want = library.encode(text, add_special_tokens=False)
        assert ids == " ".join(map(str, want.ids)) and found.tolist() == want.ids
        assert decoded == library.decode(want.ids, skip_special_tokens=False)
        assert own.decode(own.encode(text)) == decoded


def test_portions_and_forgetting_change_nothing(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Abc", "é", "x1y2", "中文", "<|endoftext|>", "don't", "q" * 120]) for _ in range(200)) for _ in range(20)]
    want = [x.tolist() for x in bpe.Encoder(PATH).code(texts)]
    monkeypatch.setattr(bpe, "PORTION", 50)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 500)
    assert [x.tolist() for x in bpe.Encoder(PATH).code(texts)] == want


def test_encoding_columns(documents, spark):
    get = bpe.encoder(spark, PATH)
    coded = documents(ODD).withColumn("ids", bpe.encode(F.col("text"), get)).withColumn("back", bpe.decode(F.col("ids"), get))
    rows = coded.collect()
    library = Tokenizer.from_file(PATH)
    assert len(rows) == len(ODD)
    for row in rows:
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == want and row["back"] == library.decode(want, skip_special_tokens=False)
    assert documents([]).select(bpe.encode_decode(F.col("text"), get)).count() == 0


def plain_base(text):
    """Hits of the fixed patterns, by the plain definition."""
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern, group, least in ((0, assign, 2, 6), (1, r"AKIA[A-Z0-9]+", 0, 20), (2, r"[0-9a-f]+", 0, 24)):
        flags = re.I | re.A if kind == 0 else 0
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    bits = ["token", "TOKEN", "api_key", "apikey", "=", ":", ' "', "'", " ", "AKIA", "ABCDEFGH0123", "deadbeef0123", "x", "é", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(3)
    texts = []
    for i in range(120):
        word = " ".join(rng.choice(["the", "of", "house", "river", "is", "green"]) for _ in range(30))
        value = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        texts.append(f'{word}\ntoken = "{value}"\n{word}' if i % 2 else word)
    return secret_scan.fit([w for t in texts for w in secret_scan.windows(t)])


def test_field_finds_values_in_like_places(field):
    classes = secret_scan._Classes(field.words)
    text = 'of the house\ntoken = "0123456789abcdef0123456789abcdef"\nriver is green'
    assert [text[a:b] for a, b in secret_scan.tagged_spans(text, field, classes)] == ["0123456789abcdef0123456789abcdef"]
    assert secret_scan.tagged_spans("the house of the river is green", field, classes) == []


def test_stretches_decode_like_the_whole_text(field):
    rng, classes = random.Random(4), secret_scan._Classes(field.words)
    for _ in range(60):
        text = " ".join(rng.choice(["the", "token", "=", '"', "ab12cd34ef56ab12cd34ef56ab", "x9", "."]) for _ in range(40))
        tokens = secret_scan.TOKEN.findall(text)
        tags = secret_scan.viterbi(secret_scan._scores(field, classes.of(text), secret_scan.file_features(text)), field.pairs)
        spans, last = [], 0
        for tag, m in zip(tags, secret_scan.TOKEN.finditer(text)):
            if tag == 1 or (tag == 2 and last == 0):
                spans.append(m.span())
            elif tag == 2:
                spans[-1] = (spans[-1][0], m.end())
            last = tag
        assert len(tokens) == len(tags) and secret_scan.tagged_spans(text, field, classes) == spans


def test_scan_and_redact(documents, field):
    secret = "password=hunter2hunter2"
    rows = documents([*ODD, (9, f"a {secret} b"), (10, "long " * 40_000 + secret)])
    found = rows.withColumn("spans", secret_scan.scan(F.col("text"), field))
    got = {r["doc_id"]: (r["cut"], r["spans"]) for r in found.withColumn("cut", secret_scan.redact(F.col("text"), F.col("spans"))).collect()}
    assert got[9][0] == "a [SECRET] b" and got[10][0].endswith("long [SECRET]")
    assert got[1] == (None, []) and got[2] == ("", [])
    assert secret_scan.fit([]).file[:, 0].min() == 1.0


@pytest.mark.parametrize("operator, name, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_classifiers_on_the_held_out_fold(spark, operator, name, least):
    documents, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    own = [(r["doc_id"], r[name]) for r in labels.collect()]
    learn = spark.createDataFrame([x for x in own if not fold(x[0])], "doc_id long, label int")
    model = operator.train(documents.select("doc_id", "text"), learn)
    test = spark.createDataFrame([x for x in own if fold(x[0])], "doc_id long, label int")
    rows = documents.join(test, "doc_id").select("label", operator.score(F.col("text"), model).alias("s")).collect()
    right = np.mean([(r["s"] >= operator.THRESHOLD) == (r["label"] == 1) for r in rows])
    assert len(rows) > 50 and right >= least


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, documents, operator):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = operator.train(documents(ODD), none)
    rows = documents(ODD).select("doc_id", operator.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == len(ODD) and {r["s"] for r in rows} == {0.5}
    assert documents([]).select(operator.score(F.col("text"), model)).count() == 0
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 0), (None, 1), (7, None)], "doc_id long, label int")
    rows, own = labelled.sample_features(documents(ODD), labels, operator.features, 10)
    assert list(own) == [1, 0] and all(len(x) == len(set(x)) for x in rows)


def test_quality_filter_keeps_columns(documents):
    model = linear.LinearModel(np.zeros(quality.SIZE, np.float32), 0.0, 1.0, -9.0)
    assert quality.keep_good(documents(ODD), model).count() == 0
    model = linear.LinearModel(np.zeros(quality.SIZE, np.float32), 0.0, 1.0, 9.0)
    kept = quality.keep_good(documents(ODD), model)
    assert kept.count() == len(ODD) and kept.columns == documents(ODD).columns


def test_hinge_dual_reaches_the_optimum():
    rows = [np.array([0]), np.array([0, 2]), np.array([1]), np.array([1, 2])]
    weights, bias = linear.hinge_dual(rows, np.array([1, 1, 0, 0]), np.ones(3), epochs=200)

    def loss(w, b):
        hinge = [max(0.0, 1 - s * (w[r].sum() * linear.length_scale(r) + b)) for r, s in zip(rows, (1, 1, -1, -1))]
        return 0.5 * (w @ w + b * b) + sum(hinge)

    rng = np.random.default_rng(0)
    least = loss(weights, bias)
    assert all(least <= loss(weights + rng.normal(0, 0.05, 3), bias + rng.normal(0, 0.05)) + 1e-6 for _ in range(500))


def test_distinct_features():
    rng, distinct = np.random.default_rng(1), linear.Distinct(64)
    for _ in range(50):
        distinct.start()
        a, b = rng.integers(0, 64, 30), rng.integers(0, 64, 30)
        found = np.concatenate([distinct.new(a), distinct.new(b)])
        assert sorted(found) == sorted({*a, *b})


def test_language_of_held_out_documents(spark, documents):
    rows = table(spark, SF_DIR, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.train(rows.filter(~fold))
    got = rows.filter(fold & F.col("lang").isNotNull()).select("lang", langid.identify(F.col("text"), model).alias("f")).collect()
    assert np.mean([r["lang"] == r["f"]["lang"] for r in got]) > 0.95
    odd = {r["doc_id"]: r["f"] for r in documents(ODD).select("doc_id", langid.identify(F.col("text"), model).alias("f")).collect()}
    assert {odd[i]["lang"] for i in (1, 2, 3, 4)} == {"und"} and odd[6]["lang"] in model.languages
    assert not odd[1]["accepted"] and odd[1]["score"] == 0.0
    empty = langid.train(documents([]))
    assert [r["f"]["lang"] for r in documents([(1, "x")]).select(langid.identify(F.col("text"), empty).alias("f")).collect()] == ["und"]


def test_pipeline_stages_send_small_batches(spark, documents):
    """A stage sets the bound after it has read its other tables, which set the usual one."""
    docs = documents([(i, f"word {i} " * 20_000) for i in range(40)]).coalesce(1)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.benchmark_stage, corpus_pipeline.tokens_stage):
        batched(spark)
        stage(spark, docs, SF_DIR)
        sizes = docs.select("text").mapInPandas(lambda batches: (x.assign(text=x["text"].str.len()).sum().to_frame("n") for x in batches), "n long")
        got = [r["n"] for r in sizes.collect()]
        assert sum(got) == sum(len(f"word {i} ") * 20_000 for i in range(40)) and max(got) <= 3 << 20
