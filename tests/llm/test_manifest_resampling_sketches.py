"""Merkle manifest, importance resampling and bottom-k near-duplicates against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from debtscope.llm import decontamination, jaccard, merkle, minhash, queries, ranks, resampling, words
from debtscope.llm.words import ALPHANUMERIC, UNSPACED, word_hashes
from oracles.check import compare, connect

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, grp string, rank int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- places ----------------------------------------------------------------------------------


def test_places_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcc"), rng.randint(0, 30)) for _ in range(700)] + [("hot", 5)] * 300
    got = ranks.numbered(spark.createDataFrame(rows, "g string, v int").repartition(7), ["g"], [F.col("v").desc()]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["place"], r["v"], r["size"]))
    for g, own in by.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and {s for _, _, s in own} == {len(own)}
        assert [v for _, v, _ in own] == sorted((v for h, v in rows if h == g), reverse=True)
    assert ranks.numbered(spark.createDataFrame([], "g string, v int"), [], [F.col("v")]).count() == 0


# --- Merkle manifest -------------------------------------------------------------------------


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by building all trees in memory."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha(*[field(x) for x in (r[0], r[3], r[2], r[4], text)])

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            yield "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
            i //= 16

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for number, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*path(trees[s], i), *path(top, number)]
            here = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                here = leaf(r, None if r[1] is None else r[1].translate(LOWER))
            for left, right in steps:
                here = sha(left, here, right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(*[a + b for a, b in steps]), here, here == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sources, number", [(1, 1), (1, 17), (40, 500)])
def test_proofs_equal_plain_trees(spark, sources, number):
    rng = random.Random(number)
    name = lambda: rng.choice([None, "", "é", "B", "a"] + [f"s{i}" for i in range(sources)]) if sources > 1 else "only"
    rows = [(i * 3 % 1009, rng.choice(["Text A", "b", "", None, "É x"]) , rng.choice(["en", None]), name(), rng.choice([3, None]), "d", "g", 1) for i in range(number)]
    if number > 100:
        rows += [(*r, name(), 1, "d", "g", 1) for r in [(None, "no key", "en"), (None, "no key", "en"), (5, "same", "en"), (5, "same", "en")]]
        rows += [rows[-1]] * 40 + [(9_000 + i, "Hot X", "en", "hot", i, "d", "g", 1) for i in range(280)]
    got = merkle.checked(spark.createDataFrame(rows, SCHEMA).repartition(5))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == plain_manifest(rows)


def test_records_are_content_addressed_and_requests_may_be_few(spark):
    rows = [(i, f"Text {i}", "en", "s" if i % 3 else "t", 4, "d", "g", 1) for i in range(900)]
    own = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)))
    for records in (*own.records, *own.root_records):
        for r in records.collect():
            assert r["digest"] == sha(*r["children"]) and len(r["children"]) <= 16
    few = own.leaves.filter("doc_id in (5, 700)").select("grp", "rank", "size", "doc_id")
    missing = few.filter("doc_id = 5").withColumns({"rank": F.lit(5_000).cast("long"), "doc_id": F.lit(-1).cast("long")})
    found = merkle.prove(own, few.unionByName(missing))
    want = {r[0]: r for r in plain_manifest(rows)}
    got = found.select("doc_id", "digest", merkle.siblings_digest(F.col("path")).alias("p"), merkle.folded(F.col("digest"), F.col("path")).alias("f")).collect()
    assert {r["doc_id"] for r in got} == {5, 700}
    assert all((r["digest"], r["p"], r["f"]) == (want[r["doc_id"]][1], want[r["doc_id"]][4], want[r["doc_id"]][3]) for r in got)


def test_no_documents_have_no_root(spark):
    assert merkle.checked(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle", "op12_resampling"])
def test_queries_equal_their_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == (200, "")


# --- importance resampling -------------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def plain_resample(rows, target, share, least):
    own = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, fit[: share * len(fit) // 100]


@pytest.mark.parametrize("seed, pivots, piece", [(1, 24, 50), (2, 2, 7)])
def test_resampling_equals_a_plain_version(spark, documents, monkeypatch, seed, pivots, piece):
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "Ab1", "é", "中", "x" * rng.randint(20, 40), "w" + str(rng.randint(0, 50))])
    text = lambda: rng.choice([" ", ", ", "　"]).join(word() for _ in range(rng.randint(0, 40)))
    rows = [*ODD, *[(100 + i, text()) for i in range(120)], (None, "k " * 30), (None, "k " * 30), (400, "same " * 25), (400, "same " * 25), (401, "long w " * 3000)]
    target = [text() for _ in range(9)] + [None, ""]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resampling.resample(documents(rows), bench, 40, 5).collect()
    out, drawn = plain_resample(rows, target, 40, 5)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(map(tuple, out), key=repr)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(x[0], x[4]) for x in drawn]
    monkeypatch.setattr(resampling, "PIECE", piece)
    assert [(o.tolist(), b.tolist()) for o, b in [merged([x for _, x in rows])]] == [plain_owned([x for _, x in rows])]


def merged(texts):
    owners, buckets = [], []
    for _, owner, bucket in resampling.features(texts):
        owners.append(owner)
        buckets.append(bucket)
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.lexsort((bucket, owner))
    return owner[order], bucket[order]


def plain_owned(texts):
    pairs = sorted((i, b) for i, text in enumerate(texts) for b in plain_features(text)[1])
    return [i for i, _ in pairs], [b for _, b in pairs]


def test_resampling_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents([]), none).count() == 0
    rows = resampling.resample(documents(ODD), none).collect()
    assert len(rows) == len(ODD) and {r["rank"] for r in rows} == {None}


def test_kth_key_of_equal_scores(spark):
    rng = random.Random(4)
    keys = [(rng.randint(-2, 2), rng.randint(0, 1), rng.randint(0, 3), i) for i in range(500)]
    frame = spark.createDataFrame([(k,) for k in keys], "key struct<down:long,keyless:int,key:long,at:long>")
    for k in (1, 2, 250, 499, 500):
        assert resampling.kth(frame, k) == sorted(keys)[k - 1]


# --- near-duplicates -------------------------------------------------------------------------


def plain_groups(rows, width=4):
    sets = []
    for _, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if len(own) >= width else {tuple(own)} if own else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[find(i)].append(rows[i][0])
    out = []
    for i, (key, _) in enumerate(rows):
        component = min(ids[find(i)], default=None)
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=repr)


def families(seed, lengths):
    rng = random.Random(seed)
    common, rows = [f"c{i}" for i in range(120)], []
    for group in range(7):
        base = [f"g{group}w{rng.randint(0, 900)}" for _ in range(rng.choice(lengths))] + common * (group % 2)
        for _ in range(11):
            own = list(base)
            for _ in range(rng.randint(0, max(3, len(own) // 25))):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9)}"
            rows.append((len(rows) * 7 % 101, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed, lengths", [(1, [5, 20, 80, 120]), (2, [40, 300, 1500])])
def test_groups_equal_all_pairs(documents, seed, lengths):
    rows = [*families(seed, lengths), *ODD[:4], (5, "same row"), (5, "same row"), (600, "SAME  row"), (None, "a text without a key"), (700, "x " * 20_000)]
    got = minhash.deduplicated(documents(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows)


@pytest.mark.parametrize("length, kept", [(90, 128), (260, 128), (200, 64)])
def test_one_large_group_and_those_beside_it(documents, monkeypatch, length, kept):
    """Copies that are more and less changed, some with changes in common, so that many just miss the group."""
    monkeypatch.setattr(minhash, "KEPT", kept)
    rng = random.Random(length)
    base, rows = [f"w{i}" for i in range(length)], []
    edits = [[(rng.randrange(length), f"s{e}x{j}") for j in range(length // 30)] for e in range(4)]
    for i in range(90):
        own = list(base[: rng.choice([length, length, length - length // 12])])
        changes = rng.choice([[], [], *edits]) + [(rng.randrange(length), f"u{i}x{j}") for j in range(rng.randint(0, length // 22))]
        for at, word in changes:
            if at < len(own):
                own[at] = word
        rows.append((i, " ".join(own)))
    got = minhash.deduplicated(documents(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = plain_groups(rows)
    assert sorted(map(tuple, got), key=repr) == want and 1 < sum(r[3] for r in want) < 90


def test_nodes_that_ask_one_group_are_not_met_by_frequent_tokens(spark):
    """Forty nodes with a passage in common that cannot link them, and two that share more."""
    rows = [(a, 1, 50, True, 30, [*range(900, 908), *range(a * 100 + 1000, a * 100 + 1012)]) for a in range(40)]
    rows += [(a, 1, 50, True, 30, [*range(900, 908), *range(8), 50 + a, 60 + a, 70 + a, 80 + a]) for a in (40, 41)]
    rng = random.Random(3)
    for a in range(50, 90):
        rest = rng.sample(range(30), rng.randint(0, 25))
        rows.append((a, 2, 60 + len(rest), True, 60 - rng.randint(0, 9), rest))
    own = spark.createDataFrame(rows, "a long, comp long, m long, single boolean, common int, rest array<long>")
    got = {tuple(r) for r in minhash._asking_alike(own).collect()}
    assert {x for x in got if x[0] < 50} == {(40, 41)}
    lacking = lambda x, y: max(1, (x[2] + y[2]) * 80 / 180 - min(x[4], y[4]) - 1e-9)
    alike = lambda x, y: 5 * x[2] >= 4 * y[2] and 5 * y[2] >= 4 * x[2]
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and alike(x, y) and len({*x[5]} & {*y[5]}) >= lacking(x, y)}
    assert want <= got and len(want) > 10


def test_groups_are_met_by_few_members(spark):
    """Nodes that a group's closest member links, and nodes for which members need tokens apart from the head in common."""
    rng, linked, sets, asks = random.Random(8), lambda x, y: 180 * len(x & y) >= 80 * (len(x) + len(y)), {}, []
    for comp in (0, 1):
        head = set(range(comp * 1000, comp * 1000 + 60))
        for i in range(50):
            gone = set(rng.sample(sorted(head), rng.randint(0, 6) if i else 0))
            sets[comp * 1000 + i] = (comp, head - gone | {comp * 1000 + 500 + rng.randrange(12) for _ in range(rng.randint(0, 5) if i else 0)})
        for i in range(40):
            gone = set(rng.sample(sorted(head), rng.randint(0, 12)))
            asks.append((5000 + comp * 100 + i, comp))
            sets[asks[-1][0]] = (asks[-1][0], head - gone | {comp * 1000 + 500 + rng.randrange(12) for _ in range(rng.randint(0, 12))})
    nodes = spark.createDataFrame([(k, len(x), sorted(x)) for k, (_, x) in sets.items()], "k long, n int, sketch array<long>")
    comps = spark.createDataFrame([(k, c) for k, (c, _) in sets.items()], "k long, comp long")
    full = spark.createDataFrame([(k, sorted(x)) for k, (_, x) in sets.items()], "k long, tokens array<long>")
    least = {c: min(len(x) for d, x in sets.values() if d == c) for c in (0, 1)}
    asked = spark.createDataFrame(
        [(a, len(sets[a][1]), True, c, 50, least[c], c * 1000) for a, c in asks], "a long, n int, single boolean, comp long, size long, least int, head long"
    )
    got = {tuple(r) for r in minhash.inside_groups(minhash._against_heads(asked, full), minhash.inverted(nodes).join(comps, "k"), full).collect()}
    want = {(a, c) for a, c in asks if any(linked(sets[a][1], x) for d, x in sets.values() if d == c)}
    assert {(a, sets[b][0]) for a, b in got if linked(sets[a][1], sets[b][1])} == want and 20 < len(want) < len(asks)
    assert len(got) < 5 * len(asks)


def test_bounds_on_pairs_are_compiled(spark):
    """Pairs are many; a method of over 8,000 bytes is never compiled and takes some 40 microseconds for each."""
    rows = [(v, k, n, 60 + k, 0.5, comp) for v in range(3) for k, n, comp in ((1, 80, 1), (2, 82, 1), (3, 81, 3), (4, 90, 4), (5, 400, 5), (6, 79, 5))]
    lists = spark.createDataFrame(rows, "value long, k long, n long, left long, own double, comp long")
    nodes = spark.createDataFrame([(k, 20 + k, list(range(20 + k))) for k in range(9)], "k long, n long, sketch array<long>")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # such a plan is compiled as a whole
    try:
        for found in (minhash.followers(lists, 0), minhash.asked_groups(lists), minhash.inverted(nodes)):
            parts = found._jdf.queryExecution().debug().codegenToSeq()
            assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_single_nodes_meet_as_in_a_plain_join(spark):
    """Nodes of one list that stand too late for others of their size make no pairs; sizes on both sides of ``KEPT``."""
    rng = random.Random(4)
    rows = [(v, k, n, min(n, 128) - rng.randint(0, max(1, min(n, 128) // 4)), rng.random() < 0.3) for v, sizes in ((0, (3, 30)), (1, (90, 300))) for k in range(80) for n in [rng.randint(*sizes)]]
    rows += [(2, k, 100, 85, False) for k in range(200)]  # each needs 89 for another of 100
    singles = spark.createDataFrame(rows, "value long, k long, n long, left long, near boolean")
    other = singles.toDF("value", "b", "m", "other_left", "other_near")
    want = minhash.meeting(singles.join(other, "value").filter("k < b and not (near and other_near)"))
    got = minhash.single_pairs(singles)
    keys = lambda pairs: sorted(tuple(r) for r in pairs.select("value", "k", "b").collect())
    assert keys(got) == keys(want) and len(keys(want)) > 100
    assert not [x for x in keys(got) if x[0] == 2]
    assert minhash.single_pairs(singles.filter("value = 2")).count() == 0


def test_small_sketches_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(minhash, "KEPT", 32)
    rows = families(5, [60, 200, 400])
    got = minhash.deduplicated(documents(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows)


def test_groups_of_nothing(documents):
    assert minhash.deduplicated(documents([])).count() == 0
    assert [tuple(r) for r in minhash.deduplicated(documents([(1, None)])).collect()] == [(1, 0, 1, True)]


# --- words are told apart --------------------------------------------------------------------


def thue_morse(n, swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_with_a_pattern_differ(spark, documents):
    """Words that any polynomial hash modulo 2^64 takes for one."""
    one, other = thue_morse(2048, 0), thue_morse(2048, 1)
    for members in (ALPHANUMERIC, UNSPACED):
        assert len(set(word_hashes([one, other, one[:1024], other[:1024], one[1:], "b" + one], members)[0].tolist())) == 6
    rows = [(1, one), (2, other), (3, one)]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.linked(documents(rows)).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"]: r["component_id"] for r in minhash.deduplicated(documents(rows)).collect()} == {1: 1, 2: 2, 3: 1}
    own = decontamination.blocks(spark.createDataFrame([(7, one)], "item_id long, text string"))
    hits = documents(rows).select("doc_id", decontamination.find(F.col("text"), own)["n_hit"].alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in hits} == {1: 1, 2: 0, 3: 1}


def test_words_in_portions_are_the_same(monkeypatch):
    texts = ["", "aB c\n", "é漢 x" * 9, "y" * 100, " ", "z" * 47 + " " + "z" * 49, "q" * 64]
    want = [word_hashes(texts, members) for members in (ALPHANUMERIC, UNSPACED)]
    assert want[1][1].tolist() == [0, 2, 10, 1, 0, 2, 1]
    for size in (1, 7, 64, 101):
        monkeypatch.setattr(words, "PORTION", size)
        for members, (hashes, counts) in zip((ALPHANUMERIC, UNSPACED), want):
            own = word_hashes(texts, members)
            assert own[0].tolist() == hashes.tolist() and own[1].tolist() == counts.tolist()
    assert list(words.portions([None, "a" * 60, "b" * 60, "c" * 200])) == [["", "a" * 60], ["b" * 60], ["c" * 200]]


@pytest.mark.parametrize("texts", [["word " * 200] * 8_000, ["word " * 1_600_000], ["w" * 8_000_000]])
def test_a_batch_of_texts_takes_a_few_times_its_bytes(texts):
    """An Arrow batch has 8 MB; letters as numbers would take over 30 times that."""
    import tracemalloc

    tracemalloc.start()
    counts = word_hashes(texts, UNSPACED)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() in (1_600_000, 1) and peak < 25 * 8_000_000


def test_repetitive_items_take_bounded_memory():
    import tracemalloc

    own = decontamination.block([("i", "same " * 2_000)])
    tracemalloc.start()
    counts, rows = decontamination.search(["same " * 20_000], own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [20_000] and peak < 200 << 20
    covered = np.zeros(20_000, bool)
    for _, _, _, at, n in rows[:: max(1, len(rows) // 200)].tolist():
        covered[at : at + n] = True
    assert covered.any() and rows[:, 4].max() == 2_000
