import collections
import hashlib
import itertools
import random
import re
import time
import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossiermill import llm
from dossiermill.llm import common, decontamination, language_id, license_scan, line_runs, mixing, order_minhash, repeats, sharding, simhash, toxicity

from .corpus import documents, frame, words


def unique(rows):
    return list({(r[0], r[1]): r for r in rows}.values())


# --- shared helpers ---------------------------------------------------------


def roots_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots_of({x for p in pairs for x in p}, pairs)
    assert all(got.get(n, n) == r for n, r in want.items())


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def with_settings(spark, settings, run):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_take_as_many_tasks_as_their_edges_need(spark):
    sc, pairs = spark.sparkContext, [(i, i + 1) for i in range(40)]

    def run():
        sc.setJobGroup("few tasks", "components")
        got = common.components(spark.createDataFrame(pairs, "u long, v long")).collect()
        sc.setJobGroup("others", "")
        return got

    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    got = with_settings(spark, many, run)
    assert {(r.node, r.root) for r in got} == {(n, 0) for n in range(41)} and len(got) == 41
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("few tasks") for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert 64 < sum(info.numCompletedTasks for s in stages if (info := sc.statusTracker().getStageInfo(s))) < 64 * 8


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {name for n in range(found.size()) if (name := found.apply(n).getName()).startswith("shuffle_")}

    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(cleanup)
    got = common.stored(spark.range(1_000).groupBy(F.col("id") % 7).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and got.agg(F.sum("count")).first()[0] == 1_000 and spark.conf.get(cleanup) == setting


def test_fresh_names():
    class Frame:
        columns = ["_Id", "_id_"]

    assert common.fresh(Frame, "_id", "x") == ["_id__", "x"]


# --- 1 sharding -------------------------------------------------------------


def least_capacity(sizes, shards):
    def needed(capacity):
        n, room = 0, None
        for x in sizes:
            if room is None or x > room:
                n, room = n + 1, capacity - x if x <= capacity else 0
            else:
                room -= x
        return n

    return next(c for c in range(1, sum(sizes) + 1) if needed(c) <= shards)


@pytest.mark.parametrize(("n", "shards", "huge"), [(5, 8, False), (300, 7, False), (300, 7, True)])
def test_cut_points(spark, n, shards, huge):
    rng = random.Random(n + huge)
    keys = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(n))
    sizes = [rng.choice([16, 17, rng.randint(16, 900)]) for _ in keys]
    if huge:
        sizes[n // 2] = sum(sizes)
    capacity, begins = sharding.cut_points(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key string, size long"), shards)
    assert capacity == least_capacity(sizes, shards)
    loads = collections.Counter()
    for k, x in zip(keys, sizes, strict=True):
        loads[sum(b <= k for b in begins)] += x
    assert max(loads) < shards
    assert all(v <= capacity or v in sizes for v in loads.values())


def test_shards_hold_every_row(spark):
    rows = documents()
    got = sharding.shard(frame(spark).withColumn("_order", F.lit(1)).withColumn("_key", F.lit("x")), 6).collect()
    assert len(got) == len(rows)
    by_text, slots = {}, collections.defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 16 and r._key == "x"
        assert by_text.setdefault(r.text or "", r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(frame(spark, []), 6).count() == 0


# --- 2 language ID ----------------------------------------------------------


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    parts = {"aa": ["bla", "gru", "eni", "sto"], "bb": ["kwi", "xor", "uzu", "pel"], "cc": ["ñam", "éto", "ûri", "öfe"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(rng.randint(4, 60))), x, "s", 0) for i, x in enumerate(rng.choices(list(parts), k=120))]
    docs = frame(spark, rows)
    model = language_id.fit(docs.where("doc_id < 60"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x, _, _ in rows)
    assert all(0.5 <= r.score <= 1 for r in got.values())


def test_language_of_awkward_texts(spark):
    docs = frame(spark)
    model = language_id.fit(docs)
    got = collections.defaultdict(list)
    for r in language_id.predict(docs, model).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(documents())
    for i in (1000, 1001, 1002, 1004):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    empty = language_id.fit(frame(spark, []))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    kept = language_id.identified(docs.withColumn("_pred", F.lit(3)))
    assert kept.columns[-1] == "_pred" and {1000, 1001, 1002, 1004}.isdisjoint(r.doc_id for r in kept.collect())


def test_marks_are_no_letters(spark):
    docs = frame(spark, [(1, "\u0301\u0301 \u0489", None, None, 3), (2, "e\u0301t\u0301", None, None, 4)])
    model = language_id.fit(frame(spark))
    assert [r.lang_pred == "und" for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == [True, False]


def brute_counts(model, text):
    """How many n-grams of the text each language's filter holds, by definition."""
    low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    points = [0, *itertools.chain.from_iterable([*map(ord, w), 0] for w in low.split())]
    has, n = collections.Counter(), 0
    for size in language_id.SIZES:
        for i in range(len(points) - size + 1):
            own = points[i : i + size]
            if 0 in own[1:-1]:
                continue
            h = size
            for x in own:
                h = (h * language_id.BASE + x) & (1 << 64) - 1
            h = language_id.mix(np.array([h], dtype=np.uint64))
            n += 1
            for k in range(len(model.langs)):
                has[k] += all(int(model.masks[k // 64][p[0]]) >> k % 64 & 1 for p in model._places(h))
    return n, [max(0.0, (has[k] - n * model.false[k]) / (1 - model.false[k])) for k in range(len(model.langs))]


def test_counts_against_brute_force(spark):
    model = language_id.fit(frame(spark))
    texts = [r[1] for r in documents() if r[1] and r[0] != 1006][:30] + ["Über  den--Wolken", "a"]
    n, has = model.counts(texts)
    for i, t in enumerate(texts):
        want_n, want = brute_counts(model, t)
        assert n[i] == want_n and has[i].tolist() == pytest.approx(want)


def test_bloom_filter_never_misses():
    h = np.random.default_rng(0).integers(0, 1 << 63, 2000).astype(np.uint64)
    model = language_id.Filter([f"l{i}" for i in range(70)], [h[i * 20 : i * 20 + 20] for i in range(70)])
    for n in range(70):
        has = model.masks[n // 64]
        assert all((has[p] >> np.uint64(n % 64) & np.uint64(1)).all() for p in model._places(h[n * 20 : n * 20 + 20]))


# --- 3 decontamination ------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, width=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split_words(t)
        if i is not None and w:
            for s in range(max(1, len(w) - width + 1)):
                windows[tuple(w[s : s + width])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = split_words(t), set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        out[i, t] = (len(w), len(hit), sorted(found))
    return out


def test_contamination_against_brute_force(spark):
    rows = [r for r in documents() if r[0] != 1006]
    long_text = next(r[1] for r in rows if r[1] and len(r[1].split()) > 60)
    items = [(1, long_text), (2, " ".join(long_text.split()[5:20]).upper()), (10, "one"), (11, "W5  w6."), (12, None), (13, "..."), (14, "Two"), (15, long_text), (None, "w1")]
    found = decontamination.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_hits([(r[0], r[1]) for r in rows], items)
    got = found.collect()
    assert len(got) == len(rows)
    keyed = {(r.doc_id, r.n_words, sum(h.hi - h.lo for h in r.hits), tuple(r["items"])) for r in got}
    assert keyed == {(i, n, h, tuple(x)) for (i, _), (n, h, x) in want.items()}


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.hits for r in decontamination.contamination(frame(spark), items).collect())
    assert decontamination.contamination(frame(spark, []), items).count() == 0


# --- 4 repeats --------------------------------------------------------------


def brute_repeats(rows):
    seen, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for j in range(len(data) - repeats.LENGTH + 1):
            s = data[j : j + repeats.LENGTH]
            if s in seen:
                gone[j : j + repeats.LENGTH] = True
            else:
                seen[s] = i
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, dtype=np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("crowded", [2000, 3])
def test_repeats_against_brute_force(spark, crowded):
    rows = [(r[0], r[1]) for r in unique(documents())] + [(2000, "ab" * 400), (2001, "a" * 500), (2002, "ba" * 90)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowded)
    got = {r.doc_id: (r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), bytes(r.kept)) for r in found.collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_equal_rows_and_none(spark):
    row = (5, "x y " * 60)
    docs = spark.createDataFrame([row, row, (None, row[1])], "doc_id long, text string")
    got = [(r.doc_id, len(r.kept)) for r in repeats.without_repeats(docs).collect()]
    first = len(brute_repeats([(1, row[1])])[1][3])
    assert sorted(got, key=str) == [(5, 0), (5, 0), (None, first)]
    assert repeats.without_repeats(docs.where("false")).count() == 0


def test_long_documents_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(3)
    text = words(rng, 900)
    texts = [text.encode(), (words(rng, 100) + text[500:2500]).encode()]
    anchor, context, number, lo, hi = repeats.contexts(texts)
    for n, t in enumerate(texts):
        covered = sorted((a, b) for m, a, b in zip(number, lo, hi, strict=True) if m == n)
        assert covered[0][0] == 0 and covered[-1][1] == len(t) - repeats.LENGTH
        assert all(b + 1 == c for (_, b), (c, _) in zip(covered, covered[1:], strict=False))


def test_run_index_statistics():
    rng = random.Random(2)
    for alphabet in (b"ab", b"\0a", b"abcdefgh"):
        data = bytes(rng.choice(alphabet) for _ in range(300)) * 2
        order = sorted(range(len(data)), key=lambda i: data[i:])
        pred, common_ = repeats.RunIndex(np.frombuffer(data, dtype=np.uint8)).statistics()
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert (pred[b], common_[b]) == (a, n)


# --- 5 mixing ---------------------------------------------------------------


def test_targets_share_the_excess():
    got = mixing.targets([100, 10, 100, 0], [5, 2, 1, 5])
    assert got == pytest.approx([200.0, 20.0, 95.0, 0.0])
    assert mixing.targets([], []) == []


def test_draw_is_exact():
    counts = mixing.draw([1000, 3, 0, 501], 7, 1)
    assert counts.sum(axis=0).tolist() == [1000, 3, 0, 501]
    assert max(counts.sum(axis=1)) - min(counts.sum(axis=1)) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutation(n):
    import pandas as pd

    got = mixing.permutation(pd.Series(range(n)), pd.Series([n] * n), pd.Series([99] * n))
    assert sorted(got) == list(range(n))


def test_mix_reaches_targets(spark):
    docs = frame(spark)
    first, second = (sorted(map(tuple, mixing.Mix(docs, block_words=8, shards=5).taken().collect()), key=str) for _ in range(2))
    assert first == second and len(first) == len(documents())
    mix = mixing.Mix(docs, block_words=8, shards=5)
    taken = collections.Counter()
    for r in mix.taken().collect():
        assert r.taken <= 2 * r.size
        taken[r.source_no] += r.taken
    for s in mix.sources.collect():
        assert abs(taken[s.source_no] - s.target) <= max(8, 0.05 * s.target)
    assert mixing.Mix(frame(spark, [])).taken().count() == 0


def test_mixed_documents_hold_the_taken_words(spark):
    docs = frame(spark, unique(documents())).withColumn("_id", F.lit(4))
    want = {r.doc_id: r.taken for r in mixing.Mix(docs, block_words=8, shards=5).taken().collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(docs, block_words=8, shards=5).collect():
        got[r.doc_id] += len(re.findall(mixing.WORD, r.text, re.ASCII))
        assert r.n_chars == len(r.text) and r._id == 4
    assert dict(got) == {i: n for i, n in want.items() if n}


# --- 6 license scans --------------------------------------------------------


def test_license_scan(spark):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, rng.randint(0, 60))} {t.upper() if i % 2 else t} {words(rng, rng.randint(0, 60))}", None, None, 0) for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows += [r for r in documents() if r[0] >= 1000]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(frame(spark, rows), license_scan.TEMPLATES).collect() if r.containment == 1}
    pairs = [set(itertools.pairwise(split_words(t))) for _, t in license_scan.TEMPLATES]
    assert got == {(i, name) for i, own in enumerate(pairs) for (name, _), p in zip(license_scan.TEMPLATES, pairs, strict=True) if p <= own}
    assert license_scan.scan_licenses(frame(spark, rows), []).count() == 0
    edited_rows, rng = [], random.Random(5)
    for i, (_, t) in enumerate(license_scan.TEMPLATES):
        w = t.split()
        if len(w) >= 40:  # one word in fifty changed leaves 0.9 or more
            for at in range(25, len(w), 50):
                w[at] = "changed"
            edited_rows.append((i, f"{words(rng, 300)} {' '.join(w)} {words(rng, 300)}", None, None, 0))
    found = {r.doc_id for r in license_scan.scan_licenses(frame(spark, edited_rows), license_scan.TEMPLATES).collect() if r.license == license_scan.TEMPLATES[r.doc_id][0]}
    assert len(edited_rows) >= 10 and found == {r[0] for r in edited_rows}
    with pytest.raises(ValueError, match="at most"):
        license_scan.Templates([("a", "b")] * (license_scan.MAX_TEMPLATES + 1))


# --- 7 SimHash --------------------------------------------------------------


def brute_fingerprint(text, k):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_against_brute_force(spark):
    rows = documents()
    got = simhash.near_duplicates(frame(spark), words=3, max_bits=2).collect()
    fps = {(r[0], r[1]): brute_fingerprint(r[1], 3) for r in rows}
    first = {}
    for (i, _), f in fps.items():
        first[f] = min(i, first.get(f, i))
    near = [(first[a], first[b]) for a in first for b in first if a < b and (a ^ b).bit_count() <= 2]
    roots = roots_of(set(first.values()), near)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got} == {(i, f, roots[first[f]]) for (i, _), f in fps.items()}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("crowded", [2, 10**6])
def test_links_of_a_crowd(spark, max_bits, crowded):
    rng = random.Random(max_bits)
    base, fps = rng.getrandbits(63), set()
    for _ in range(120):
        v = base
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(63)
        fps.add(v)
    got = {r.node: r.root for r in common.components(simhash.links(spark.createDataFrame([(v,) for v in fps], "fp long"), max_bits, crowded)).collect()}
    want = roots_of(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= max_bits])
    assert all(got.get(v, v) == r for v, r in want.items())


def test_one_of_each_group(spark):
    rng = random.Random(6)
    base = words(rng, 200, 5000).split()
    near = base.copy()
    near[50] = "changed"
    rows = [(1, " ".join(base), "en", "s", 0), (2, " ".join(near), "en", "s", 0), (2, " ".join(near), "en", "s", 0), (3, words(rng, 200, 5000), "en", "s", 0), (4, None, None, None, None), (5, "", None, None, None), (None, words(rng, 90, 5000), None, None, None)]
    kept = simhash.one_of_each_group(frame(spark, rows).withColumn("_hash", F.lit(0)))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]
    assert simhash.one_of_each_group(frame(spark, [])).count() == 0


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_groups(rows, least=0.8):
    """The kept doc_ids of ``rows`` (doc_id, text) by the Jaccard similarity of all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    alike = lambda a, b: a == b or len(a & b) >= least * len(a | b) > 0
    return set(roots_of(sets, [(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])]).values())


def edited(rng, words_of, edits):
    out = list(words_of)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_groups_are_decided_by_exact_jaccard(spark):
    """Pairs on both sides of 0.8, where fingerprint bits tell little."""
    rng = random.Random(31)
    rows = []
    for n in range(60):
        base = words(rng, 300, 10**6).split()
        rows += [(2 * n, " ".join(base), "en", "s", 0), (2 * n + 1, edited(rng, base, 4 + n % 20), "en", "s", 0)]
    kept = [r.doc_id for r in simhash.one_of_each_group(frame(spark, rows)).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_groups(rows)


@pytest.mark.parametrize("how", [{}, {"crowded": 2, "sampled": 1}])
def test_groups_of_texts_that_share_passages(spark, how):
    """Near copies meet though all their texts are made of passages that many share."""
    rng = random.Random(32)
    passages = [words(rng, 60, 10**6).split() for _ in range(12)]
    rows = []
    for n in range(80):
        base = [w for p in rng.sample(passages, 4) for w in p]
        rows += [(2 * n, " ".join(base), "en", "s", 0), (2 * n + 1, edited(rng, base, 1 + n % 8), "en", "s", 0)]
    line = words(rng, 60, 10**6).split()
    rows += [(1000 + n, edited(rng, line, 1), "en", "s", 0) for n in range(40)]
    kept = [r.doc_id for r in simhash.one_of_each_group(frame(spark, rows), **how).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_groups(rows)


def test_parts_meet_all_similar_sets():
    """Of two sets at 0.8 or more, all common, one key at least is in both."""
    rng, least = np.random.default_rng(3), Fraction("0.8")
    plan = simhash.parts_plan(least)
    for n in [31, 32, 33, 40, 41, 50, 64, 65, 200, 1500] * 6:
        pool = rng.permutation(1 << 20)[: 2 * n].astype(np.uint64)
        for taken, more in ((n // 9, n // 9), (0, n // 4), (n // 5, 0)):
            pair = [np.sort(pool[:n]), np.sort(np.concatenate((pool[: n - taken], pool[n : n + more])))]
            if len(np.intersect1d(*pair)) < least * len(np.union1d(*pair)):
                continue
            s = simhash.Shingles([b"", b""], 5)
            s.of, s.distinct = np.repeat([0, 1], [len(x) for x in pair]), np.concatenate(pair)
            s.starts = np.array([0, len(pair[0]), len(s.of)])
            everything = np.arange(1 << 20, dtype=np.uint64), np.full(1 << 20, 5)
            (one, other), behind = s.keys(everything, least, plan)
            assert len(np.intersect1d(one, other)) and behind.tolist() >= [0, 0]
            a, b = s.parities()
            assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= len(np.setxor1d(*pair))


def test_unlike_texts_of_shared_passages_hardly_meet(spark):
    """Twice the texts of the same passages do not propose four times the pairs in
    earnest: fewer pairs than texts are left to compare, and all texts stay."""
    rng = random.Random(33)
    passages = [words(rng, 50, 10**6) for _ in range(150)]
    for size in (400, 800):
        rows = [(n, " ".join(rng.sample(passages, 6)), "en", "s", 0) for n in range(size)]
        compared, plain = [], simhash._linked
        simhash._linked = lambda rest, *more: (compared.append(rest.count()), plain(rest, *more))[1]
        try:
            assert simhash.one_of_each_group(frame(spark, rows), sampled=1).count() == size
        finally:
            simhash._linked = plain
        assert compared[0] <= size // 20


# --- 8 lines ----------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_against_brute_force(spark, batches):
    rows = unique(documents())
    holders = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if c < "\x80" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    want = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        want[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    got = line_runs.drop_repeated_lines(frame(spark, rows), min_chars=20, min_docs=3, batches=batches)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got.collect()} == want
    assert any(x[1] for x in want.values())
    assert line_runs.drop_repeated_lines(frame(spark, []), batches=2).count() == 0


def test_runs_are_levelled(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(n, b"a"), (n, bytes([65 + n])), (n, b"a")], "doc_id long, key binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    seen = [bytes(r.key) for run in runs._runs() for r in run.collect()]
    assert sorted(seen) == [bytes([65 + n]) for n in range(5)] + [b"a"]
    assert {(bytes(r.key), r.n_docs, r.last_doc) for r in runs.repeated(2).collect()} == {(b"a", 5, 4)}
    assert runs.repeated(1).count() == 6
    plan = runs.levels[0][0].join(runs.levels[2][0].hint("merge"), "key", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()


@pytest.mark.parametrize("how", ["one", "many"])
def test_spread_join_equals_join(spark, how):
    big = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 97 if how == "many" else F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(n, n * 2) for n in range(50)] + [(1, -1), (None, 0)], "k long, x long")
    got = common.spread_join(big, small, "k")
    assert got.columns == ["k", "id", "x"] and got.exceptAll(big.join(small, "k")).isEmpty() and big.join(small, "k").exceptAll(got).isEmpty()


# --- 9 toxicity -------------------------------------------------------------


def toxic_corpus(n=240):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(30, 150), 400).split()
        bad = i % 3 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["Vileword", "vilely!", "grumpkin"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, rows + [(9000, None, None, None, None), (9001, "", None, None, None)])
    field = toxicity.fit(docs, spark.createDataFrame(labels[:120], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.scored(docs, field).collect()}
    assert sum((got[i].score >= 0.5) == bool(t) for i, _, t in labels[120:]) >= 117
    text = rows[123][1].encode()
    found = [text[s.start : s.end].lower() for s in got[123].spans]
    assert found and all(x in (b"vileword", b"vilely", b"grumpkin") for x in found)
    assert got[9000].score == got[9001].score < 0.5


def test_toxicity_without_labelled_documents(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5000, 5010)], "doc_id long, quality int, toxic int")
    for docs in (frame(spark, []), frame(spark), frame(spark, [(5000, "a b", None, None, 3)])):
        field = toxicity.fit(docs, labels)
        assert all(r.score < 0.5 for r in toxicity.scored(docs, field).collect())


def test_toxicity_without_labels(spark):
    field = toxicity.fit(frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.scored(frame(spark), field).collect()
    assert len(got) == len(documents()) and all(r.score < 0.5 and not r.spans for r in got)


def test_forward_backward_against_enumeration():
    """The gap-skipping chain equals summing over all tag sequences."""
    from itertools import product

    text = "aaa bad ccc ddd bad bad"
    _, w = next(decontamination.tokenized([text]))
    field = toxicity.Field(w.hash[1:2], np.array([3.0]), np.array([99.0]))
    field.bias, field.change = -1.0, np.array([[0.0, -0.7], [0.2, 0.5]])
    none, expected, at, marginal = field.run(w)
    emit = [3.0 * (x == "bad") - 1.0 for x in text.split()]
    total, clean, hits = 0.0, 0.0, np.zeros(6)
    for tags in product((0, 1), repeat=6):
        weight = np.exp(sum(field.change[a, b] for a, b in zip((0, *tags), tags, strict=False)) + sum(e for e, t in zip(emit, tags, strict=True) if t))
        total += weight
        clean += weight * (not any(tags))
        hits += weight * np.array(tags)
    assert np.exp(none[0]) == pytest.approx(clean / total)
    assert at.tolist() == [1, 4, 5] and marginal == pytest.approx(hits[[1, 4, 5]] / total)


def test_slope_of_document_labels():
    """The slope of the likelihood of labels equals small differences of it."""
    rng = np.random.default_rng(4)
    emit, doc, toxic = rng.normal(-1, 1, (5, 6)), np.array([0, 0, 1, 2, 2]), np.array([True, False, True])
    inside = np.arange(6) < np.array([6, 4, 6, 1, 5])[:, None]
    change = np.array([[0.0, -0.5], [0.0, 0.3]])

    def likelihood(emit, change):
        none = np.exp(-np.bincount(doc, weights=toxicity._forward_backward(emit, change, inside)[2]))
        return np.log(np.where(toxic, 1 - none, none)).sum()

    marginal, pairs, log_z = toxicity._forward_backward(emit, change, inside)
    own = toxicity.label_slope(log_z, doc, toxic)
    for n, j in ((0, 0), (1, 3), (2, 5), (4, 4), (3, 2)):
        step = np.zeros_like(emit)
        step[n, j] = 1e-5
        want = (likelihood(emit + step, change) - likelihood(emit - step, change)) / 2e-5
        assert own[n] * marginal[n, j] * inside[n, j] == pytest.approx(want, abs=1e-6)
    for a in (0, 1):
        step = np.zeros((2, 2))
        step[a, 1] = 1e-5
        want = (likelihood(emit, change + step) - likelihood(emit, change - step)) / 2e-5
        assert np.einsum("n,n->", own, pairs[:, a, 1]) == pytest.approx(want, abs=1e-6)


# --- 10 Order MinHash -------------------------------------------------------


def word_pieces(text):
    """Words split at ASCII white space and NUL, in pieces of 24 bytes."""
    return [w[i : i + 24] for w in re.split(rb"[\0\t-\r ]+", text) if w for i in range(0, len(w), 24)]


def brute_tuples(text, functions=order_minhash.SIGNATURES):
    """For each hash function the two numbered k-mers that it puts first, in text order:
    by definition, one text at a time and word hashes of the module's own byte hash."""
    from dossiermill.llm.wordbytes import BASE, BYTE

    full = (1 << 64) - 1

    def mixed(h):
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & full
        return h ^ (h >> 32)

    own = [mixed(sum(int(BYTE[b]) * pow(BASE, i, 1 << 64) for i, b in enumerate(w)) & full) for w in word_pieces(text)]
    k = min(3, len(own))
    seen, numbered = collections.Counter(), []
    for i in range(len(own) - k + 1 if own else 0):
        h = k
        for x in own[i : i + k]:
            h = (h * BASE + x) & full
        h = mixed(h)
        numbered.append(mixed((h + seen[h] * BASE) & full))
        seen[h] += 1
    out = []
    for f in range(functions):
        def value(i, f=f):
            x = ((numbered[i] ^ ((f + 1) * BASE & full)) * 0xD6E8FEB86659FD93) & full
            return ((x ^ (x >> 32)) >> 20, i)

        two = sorted(sorted(range(len(numbered)), key=value)[:2])
        out.append(max(mixed((numbered[two[0]] * BASE + numbered[two[-1]]) & full) & 0xFFFF, 1) if two else 0)
    return out


def test_edits_against_brute_force(spark):
    rows = [r for r in unique(documents()) if r[0] % 3 != 1 or r[0] >= 1000] + [(1010, "k" * 5000, None, None, 0), (1011, "a b a b a b a b", None, None, 0)]
    rows = [r for r in rows if r[0] != 1006]
    order = sorted(rows, key=lambda r: -r[0])
    docs = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast("smallint"))
    got = {r.doc_id: r for r in order_minhash.edit_likeness(docs).collect()}
    assert len(got) == len(rows)
    shared = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    as_hex = lambda a: "".join(f"{x:04x}" for x in a)
    tuples = {t: brute_tuples(t.encode()) for t in {r[1] or "" for r in rows}}
    for n, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        changed = brute_tuples(edited.encode())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (as_hex(tuples[t]), as_hex(changed))
        assert (got[i].near_edited, got[i].near_next) == (shared(tuples[t], changed), shared(tuples[t], tuples[after]))


def test_fingerprint_of_a_crowded_batch():
    """The way for more k-mers than there are places gives the same fingerprints."""
    texts = [words(random.Random(n), n).encode() for n in (1, 2, 3, 40, 300)]
    want = order_minhash.signatures(texts)
    kmers = order_minhash._kmers(order_minhash.Words(texts, order_minhash._IS_WORD, order_minhash._BYTES, order_minhash.LONGEST))
    begins = np.flatnonzero(np.diff(kmers[0], prepend=-1) != 0)
    assert (order_minhash._signatures(kmers[1], begins, limit=4) == want).all()


def test_order_matters_to_the_fingerprint():
    rng = random.Random(8)
    w = [f"u{i}" for i in range(400)]
    moved = w[200:] + w[:200]
    few = w.copy()
    for _ in range(8):
        few[rng.randrange(400)] = "new"
    own, swapped, edited, twice = order_minhash.signatures([" ".join(x).encode() for x in (w, moved, few, w + w)])
    near = lambda x: order_minhash.likeness(own[None], x[None])[0]
    assert near(own) == 1 and near(edited) > 0.7 > near(swapped) > 0.2 and near(twice) < 0.9
    short = ["a b c d", "d a b c", "a b c d"]
    a, b, c = order_minhash.signatures([x.encode() for x in short])
    assert (a == c).all() and (a != b).any()


def test_single_null_and_no_documents(spark):
    one = order_minhash.edit_likeness(frame(spark, [(None, "abc def", None, None, None)])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(None, 7, 1.0)]
    assert order_minhash.edit_likeness(frame(spark, [])).count() == 0


# --- the registered queries -------------------------------------------------


def test_every_operator_is_registered():
    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.queries())
    assert names == list(range(1, len(names) + 1)) and set(llm.oracle_sql()) <= set(llm.queries())


def test_held_out_share(spark):
    ids = spark.range(50).select("id", language_id.held_out("id", 4, 2).alias("out")).collect()
    assert [r.out for r in ids] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in ids]


def awkward_tables(path, spark, rows):
    """A folder of tables with nulls, repeats, a megabyte word and clashing columns."""
    clashing = ["_key", "_hash", "_row", "shard", "slot", "size", "score", "node", "fp", "batch", "key", "n"]
    frame(spark, rows).select("*", *(F.lit(1).alias(c) for c in clashing)).write.parquet(f"{path}/documents.parquet")
    item = next((r[1] for r in rows if r[1] and len(r[1].split()) > 40), None)
    spark.createDataFrame([(1, item), (2, None)] if item else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, r[0] % 2) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(r[0], [0.5, float(n % 7)], n % 3, 1) for n, r in enumerate(rows)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, anchor int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_registered_queries_on_awkward_tables(spark, tmp_path, name):
    rows = [*unique(documents(n=24)), (1020, "x" * 1_000_000, None, None, 0), (None, "w1 w2 w3", None, None, 0)]
    got = llm.queries()[name](spark, awkward_tables(tmp_path / "some", spark, rows)).collect()
    assert name.startswith(("op6", "op11")) or sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert llm.queries()[name](spark, awkward_tables(tmp_path / "none", spark, [])).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, words(rng, 80, 10**4), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, edited(rng, rows[i][1].split(), 1), "en", "s0", 0) for i in range(10)]
    rows += [(200, f"{words(rng, 30, 10**4)} {rows[5][1]} {words(rng, 300, 10**4)}", "en", "s1", 0), (201, "", "en", "s1", 0), (202, None, "en", "s1", 0)]
    path = str(tmp_path)
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[10:40]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    left = {r.doc_id for r in got}
    # near copies go to their originals, wordless texts go, and so do holders of the item
    assert left <= set(range(40)) - {5} and len(left) >= 35
    assert {r.shard for r in got} <= set(range(corpus_pipeline.SHARDS))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    """With columns that clash with the stages' own names; nothing is in, nothing comes out."""
    import corpus_pipeline

    extra = ["_hash", "_row", "_pred", "root", "node", "key", "start", "n", "slot"]
    empty = frame(spark, []).withColumns({c: F.lit(1) for c in extra})
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"shard", "slot", *extra} <= set(got.columns)


def test_texts_are_dealt_out_once_to_meet_contexts_and_ranges(spark):
    word = lambda n: hashlib.md5(str(n).encode()).hexdigest()[:7]
    passage = " ".join(word(n) for n in range(60))
    texts = [(n, " ".join(word(1_000 * n + k) for k in range(100, 160)) + passage + str(n)) for n in range(1, 20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.without_repeats(docs)
        got = {r.doc_id: r for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in plan.partition("== Initial Plan ==")[0]
    first = texts[0][1].encode()
    assert got[1].kept == first and not got[1].spans
    for n, text in texts[1:]:
        assert len(got[n].kept) < len(text) - len(passage) + 20 and passage.encode() not in got[n].kept
