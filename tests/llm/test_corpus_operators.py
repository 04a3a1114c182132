"""Decontamination, sharding, links, repeated strings, neighbours and the pipeline against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from odd_rows import ODD

import corpus_pipeline
from debtscope.llm import decontamination, jaccard, links, neighbours, queries, sharding, suffixes
from debtscope.llm.common import table
from oracles.check import compare, connect

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# --- decontamination -------------------------------------------------------------------------


def plain_hits(texts, items, window=10):
    """(words, hit words, items) per text, by looking every window up."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows[tuple(own[i : i + n])].add(item)
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(own[i : i + n])]
        out.append((len(own), len(hit), {str(i) for i in found if i is not None}))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_equals_plain_windows(spark, documents, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "ab", "Ä", "9"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 16)))) for i in range(8)] + [(8, None), (8, "a b"), (None, "b b b b")]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(60)] + [*ODD, (90, items[0][1] + ", " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = decontamination.blocks(bench, block_bytes=block_bytes)
    assert (len(own) > 1) == (block_bytes == 40)
    found = documents(rows).select("doc_id", "text", decontamination.find(F.col("text"), own).alias("f")).collect()
    want = plain_hits([r["text"] for r in found], items)
    got = [(r["f"]["n_words"], r["f"]["n_hit"], {m["item"] for m in r["f"]["matches"]} - {None}) for r in found]
    assert got == want and len(found) == len(rows)


def test_matches_are_maximal_and_in_place(spark, documents):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(7, item), (8, "")], "item_id long, text string")
    own = decontamination.blocks(bench)
    text = "x y " + " ".join(f"W{i}" for i in range(5, 25)) + " z"
    rows = documents([(1, text), (2, item.replace("w9 ", "q ")), (3, "clean text")])
    found = {r["doc_id"]: r["f"]["matches"] for r in rows.select("doc_id", decontamination.find(F.col("text"), own).alias("f")).collect()}
    assert [tuple(m) for m in found[1]] == [("7", 5, 2, 20)]
    assert [tuple(m) for m in found[2]] == [("7", 10, 10, 20)] and found[3] == []
    assert [r["doc_id"] for r in decontamination.remove(rows, own).collect()] == [3]
    none = decontamination.blocks(bench.filter("false"))
    assert decontamination.remove(rows, none).count() == 3 and decontamination.remove(documents([]), own).count() == 0


# --- sharding --------------------------------------------------------------------------------


def test_shards_fit_and_only_oversized_ones_split(spark, documents):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(500)] + [(1000, "y" * 5000), (None, "z" * 30)] + [(7777, "r" * 300)] * 40 + [(2000, None)]
    limit = 3000
    got = sharding.shards(documents(rows), limit).collect()
    assert len(got) == len(rows)
    bits = lambda i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    size = Counter()
    for i, text in rows:
        for d in range(61):
            size[bits(i)[:d]] += len(text or "")
    pages = Counter()
    for r in got:
        own = bits(r["doc_id"])
        depth = next((d for d in range(61) if size[own[:d]] <= limit), 60)
        assert (r["shard"], r["depth"], r["shard_bytes"]) == (own[:depth], depth, size[own[:depth]])
        pages[r["shard"], r["page"]] += r["bytes"]
    assert all(n <= limit for (shard, page), n in pages.items() if n != 5000)
    assert sharding.shards(documents([]), limit).count() == 0


def test_sharding_equals_its_sql(spark):
    assert compare(queries.op2_sharding(spark, SMALL), connect(SMALL), queries.ORACLES["op2_sharding"]) == (200, "")


def test_shards_are_written(documents, tmp_path, spark):
    rows = [(i, "t" * 100) for i in range(50)] + [(None, "null key"), (None, "null key"), (3, "again"), (3, "again"), (4, None)]
    sharding.write(documents(rows), f"{tmp_path}/out", 1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in back.collect()], key=key) == sorted(rows, key=key)
    assert {"lang", "source", "n_chars", "score", "shard", "page"} <= set(back.columns)
    sharding.write(documents([]), f"{tmp_path}/none", 1000)


@pytest.mark.parametrize("seed", range(4))
def test_no_page_exceeds_the_limit(documents, seed):
    rng = random.Random(seed)
    sizes = [110, 900, 400, 300] if not seed else [rng.choice([0, 1, 10, 499, 500, 501, 999, 1000, rng.randint(0, 1000)]) for _ in range(60)]
    got = sharding.shards(documents([(7, "x" * n) for n in sizes]), 1000).collect()
    pages = Counter()
    for r in got:
        pages[r["shard"], r["page"]] += r["bytes"]
    assert len(got) == len(sizes) and max(pages.values()) <= 1000
    assert len(pages) <= 4 * (sum(sizes) // 1000 + 1)


# --- n-gram Jaccard join ---------------------------------------------------------------------


def plain_components(rows):
    sets = []
    for _, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    ids = defaultdict(list)
    for i, own in enumerate(label):
        if rows[i][0] is not None:
            ids[own].append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(ids[label[i]], default=None)) for i in range(len(rows))), key=repr)


def near_copies(seed):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for group in range(6):
        base = [f"g{group}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 20, 80, 150]))] + common * (group % 2)
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9)}"
            rows.append((len(rows) * 7 % 101, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(documents, seed):
    rows = [*near_copies(seed), *ODD[:4], (5, "same row"), (5, "same row"), (600, "SAME  row"), (None, "a text without a key")]
    got = jaccard.linked(documents(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows)


def test_one_document_of_each_component_stays(documents):
    rows = [(i + 1000, text) for i, text in near_copies(3)] + ODD
    kept = jaccard.keep_one(documents(rows))
    assert kept.columns == documents(rows).columns
    wordless = [r for r in rows if not (r[1] or "").strip()]
    worded = [r for r in rows if (r[1] or "").strip()]
    groups = {c for _, _, c in plain_components(worded)}
    assert kept.count() == len(groups) + len(wordless)
    assert jaccard.keep_one(documents([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["k"]: r["comp"] for r in links.components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500


# --- repeated strings ------------------------------------------------------------------------


def plain_removal(rows, length=400):
    seen = Counter()
    data = [(text or "").encode() for _, text in rows]
    for own in data:
        seen.update(own[i : i + length] for i in range(len(own) - length + 1))
    out = []
    for (key, _), own in zip(rows, data):
        hit = np.zeros(len(own), bool)
        for i in range(len(own) - length + 1):
            if seen[own[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        left = bytes(b for b, h in zip(own, hit) if not h)
        out.append((key, len(own), int(hit.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_equals_plain_windows(documents, seed):
    rng = random.Random(seed)
    letters = "ab é" if seed == 2 else "abcdefghijklmnop "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (399, 400, 401, 430, 700, 1500)]
    rows = [*ODD]
    for i in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(passages)
            cut = rng.randint(0, 30)
            parts += [own[cut:] if rng.random() < 0.5 else own[: len(own) - cut], text(rng.randint(0, 60))]
        rows.append((100 + i, "".join(parts)))
    rows += [(900, passages[-1]), (900, passages[-1]), (901, "z" * 1200), (902, text(50) * 20)]
    got = sorted(map(tuple, suffixes.without_repeats(documents(rows)).collect()), key=repr)
    assert got == plain_removal(rows)


def test_long_texts_go_segment_by_segment(documents, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(5000))
    whole = sorted(zip(*[x.tolist() for x in next(suffixes.anchors([base.encode()]))]))
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    parts = [row for part in suffixes.anchors([base.encode()]) for row in zip(*[x.tolist() for x in part])]
    assert sum(r[2] for r in parts) == sum(r[2] for r in whole) == 5000 - 400 + 1
    assert {r[4] for r in parts} >= {r[4] for r in whole}


def test_loser_tree_merges_and_tells_shared_prefixes():
    rng = random.Random(8)
    for n in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(n)]
        coded = [suffixes.decoded(*suffixes.front_coded(run)) for run in runs]
        out, last, places = [], b"", [0] * n
        for run, share in suffixes.LoserTree(coded):
            head = runs[run][places[run]]
            places[run] += 1
            assert share == suffixes.common_prefix(last, head)
            out.append(head)
            last = head
        assert out == sorted(x for run in runs for x in run)


def test_no_documents_give_no_rows(documents):
    assert suffixes.without_repeats(documents([])).count() == 0


# --- neighbours ------------------------------------------------------------------------------


def test_neighbours_reach_the_recall(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(list)
    for r in queries.op5_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    right = 0
    for query in ids[ids % 100 == 0]:
        far = np.sqrt(((data - data[ids == query][0]) ** 2).sum(axis=1))
        far[ids == query] = np.inf
        best = np.lexsort((ids, far))[:10]
        right += len(set(ids[best]) & {i for i, _ in got[query]})
        assert len(got[query]) == 10 and all(abs(far[ids == i][0] - s) < 1e-12 for i, s in got[query])
    assert right / (10 * len(got)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0.0) for i in range(0, 30)] + [(i, [1.0] * 6, 0.0) for i in range(200, 260)]
    rows += [(300, None, 0.0), (301, [0.0] * 6, 0.0), (302, [1.0, None] + [0.0] * 4, 0.0), (303, [float("nan")] * 6, 0.0), (None, [1.0] * 6, 0.0)]
    rows += [(400, [float("inf")] * 6, 0.0), (200, [1.0] * 6, 0.0), (500, [1.0, 2.0], 0.0), (100, [2.0] + [0.0] * 5, 0.0)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = neighbours.nearest(table_).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["vec_id"])
    assert set(by) == {0, 100, 200} and all(len(x) == 10 for x in by.values())
    assert by[200] == list(range(201, 211))
    few = neighbours.nearest(table_.filter("vec_id in (0, 1, 2)"))
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert neighbours.nearest(table_.filter("false")).count() == 0


# --- queries and pipeline --------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == columns
        rows = after.collect()
        assert 0 < len(rows) <= before
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
    bench = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    texts = [r["text"] for r in docs.collect()]
    # secrets are replaced after the benchmark stage, which cannot make a window
    assert all(hit == 0 for _, hit, _ in plain_hits(texts, bench))
    assert not any(re.search(r"[0-9a-f]{24}", t or "") for t in texts)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == before and all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_every_query_answers_each_document(spark):
    for name in ("op1_decontamination", "op3_bpe", "op9_secrets"):
        assert queries.QUERIES[name](spark, SMALL).count() == 200
