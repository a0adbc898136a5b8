"""The similarity join against all pairs, its pigeonhole against random sets, and components against union-find."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sylvatica.llm import near_dedup as N
from sylvatica.llm.graph import components

WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text, size):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words if w]
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, rule):
    """[(doc_id, size, smallest doc_id of the component)] by comparing all pairs."""
    sets = [shingle_set(t, rule.size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, n, longest=120):
    """Families of texts with a few words changed, beside unrelated ones that share lines."""
    rng = random.Random(seed)
    line = " ".join(rng.choices(WORDS, k=15))
    rows = []
    while len(rows) < n:
        words = rng.choices(WORDS, k=rng.randint(1, longest))
        for _ in range(rng.choice((1, 1, 2, 4, 9))):
            own = list(words)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                kind, at = rng.random(), rng.randrange(len(own) + 1)
                if kind < 0.4:
                    own[at:at] = [rng.choice(WORDS)]
                elif kind < 0.7 and at < len(own):
                    own[at] = rng.choice(WORDS)
                elif at < len(own) and len(own) > 1:
                    del own[at]
            text = " ".join(own)
            rows.append(text.upper() if rng.random() < 0.1 else f"{line}\n{text}" if rng.random() < 0.2 else text)
    ids = list(range(n))
    rng.shuffle(ids)
    return list(zip(ids, rows[:n], strict=True))


def check(spark, rows, rule):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, node long, component string").repartition(4)
    found = [tuple(r) for r in N.similar_groups(docs, rule).collect()]
    assert sorted(found, key=str) == brute(rows, rule)


@pytest.mark.parametrize("rule", [N.Rule(3, 90, 100), N.Rule(5, 80, 100)])
def test_against_all_pairs(spark, rule):
    check(spark, corpus(rule.size, 260), rule)


@pytest.mark.parametrize("bits", [1, 6, 40])
def test_sets_that_share_a_key(spark, bits):
    """Forced clashes of the first hash: all nodes, many, or hardly any get numbers of their own."""
    check(spark, corpus(17, 150), N.Rule(3, 90, 100, key_bits=bits))


def test_parts_of_a_large_bucket(spark, monkeypatch):
    """Buckets cut into parts, with a large component and rows outside it."""
    monkeypatch.setattr(N, "PART", 16)
    check(spark, corpus(23, 200) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(29, 60, longest=30))], N.Rule(5, 80, 100))


def bucket(sets, component, probe=None):
    """The rows of one open bucket, as a task gets them."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    packed = N.sketches(np.repeat(np.arange(n), sizes), np.concatenate(sets), sizes)
    same = pa.array(np.zeros(n, np.int64))
    columns = [same, pa.array(np.arange(n)), pa.array(np.ones(n, bool) if probe is None else probe), pa.array(component), pa.array(sizes), pa.array(packed, pa.binary()), *[pa.array(np.zeros(n, np.int32))] * 3]
    whole = pa.RecordBatch.from_arrays(columns, names=["signature", "node", "probe", "component", "n_shingles", "sketch", "part", "left", "right"])
    return [whole.slice(i, 1000) for i in range(0, n, 1000)]


def test_a_large_bucket_is_compared_in_bounded_memory():
    """Thousands of nodes in one bucket: strangers make no rows, near copies are told some at a time."""
    rng = np.random.default_rng(6)
    rule = N.Rule(5, 80, 100)
    run = N._compare(rule, N.bands(rule, 400))
    strangers = [rng.integers(1, 2**62, 150, dtype=np.uint64) for _ in range(6000)]
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter(bucket(strangers, np.arange(6000))))) == 0
    base = rng.integers(1, 2**62, 150, dtype=np.uint64)
    copies = [np.concatenate((base[5:], rng.integers(1, 2**62, 5, dtype=np.uint64))) for _ in range(1500)]
    sizes = [b.num_rows for b in run(iter(bucket(copies, np.arange(1500))))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 1500 * 1499 // 2 and max(sizes) <= N.SUMS_AT_ONCE + N.PAIRS_AT_ONCE
    assert peak < 200 << 20


def test_rows_of_one_component_are_not_paired():
    """A large component with a few rows outside it: the work is that of the few."""
    rng = np.random.default_rng(7)
    rule = N.Rule(5, 80, 100)
    run = N._compare(rule, N.bands(rule, 400))
    base = rng.integers(1, 2**62, 150, dtype=np.uint64)
    sets = [np.concatenate((base[2:], rng.integers(1, 2**62, 2, dtype=np.uint64))) for _ in range(20_000)]
    component = np.where(np.arange(20_000) % 5000 == 0, np.arange(20_000), 1)
    probe = np.arange(20_000) % 2 == 0
    began = time.process_time()
    told = sum(b.num_rows for b in run(iter(bucket(sets, component, probe))))
    assert told == 4 * (20_000 - 4) + 6  # each of four with all others, once
    assert time.process_time() - began < 20  # all pairs are 200 million


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_a_bucket(seed):
    """Every pair of different components, one of which makes candidates, once."""
    rng = np.random.default_rng(seed)
    rule = N.Rule(5, 80, 100)
    n = int(rng.integers(1, 60))
    sets = [np.arange(1, 200, dtype=np.uint64)] * n
    component, probe = rng.integers(0, 8, n), rng.random(n) < 0.4
    told = [(r["a"], r["b"]) for b in N._compare(rule, N.bands(rule, 400))(iter(bucket(sets, component, probe))) for r in b.to_pylist()]
    assert sorted(told) == [(i, j) for i in range(n) for j in range(i + 1, n) if component[i] != component[j] and (probe[i] or probe[j])]


def test_null_ids_are_not_multiplied(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=40)) for _ in range(120)]
    check(spark, [(None, t) for t in texts] + [(None, t + " more") for t in texts[:40]] + [(3, texts[0])], N.Rule())


def test_edge_rows(spark):
    long = " ".join(random.Random(1).choices(WORDS, k=40_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (None, "one two"), (8, long), (9, long + " more"),
            (10, "\x85nbsp\xa0stays one word"), (11, "\x85nbsp\xa0stays one word"), (12, "a b c"), (12, "d e f"), (None, "only null"), (13, "É é")]
    check(spark, rows, N.Rule())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.similar_groups(docs).count() == 0
    assert N.keep_one(docs).count() == 0


def test_large_group_of_near_copies(spark):
    """Many near copies of one text, most of them not linked with each other directly."""
    rng = random.Random(3)
    base = rng.choices(WORDS, k=150)
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(150), 2):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    check(spark, rows, N.Rule())


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "quite another text than that"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = N.keep_one(docs, N.Rule(5, 80, 100))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]


def test_keep_one_keeps_one_row_of_each_component(spark):
    """Ids that repeat over components, and null ids alone and beside numbered ones."""
    rule, rng = N.Rule(5, 80, 100), random.Random(11)
    texts = [t for _, t in corpus(5, 200)]
    ids = [rng.choice((None, None, *range(40))) for _ in texts]
    lone = [" ".join(rng.choices(WORDS, k=60)) for _ in range(3)]
    texts += [lone[0], f"{lone[0]} more", f"{lone[0]} still", lone[1], f"{lone[1]} more", lone[2], lone[2], lone[2].upper(), "", "", " \t", None]
    ids += [None, None, None, 900, None, 7, 7, 7, 8, 8, None, None]
    least = {}
    home = {i: c for i, _, c in brute(list(enumerate(texts)), rule)}
    for i, c in home.items():
        least.setdefault(c, set()).add(ids[i])
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), strict=True)), "doc_id long, text string, row long").repartition(4)
    kept = N.keep_one(docs, rule).collect()
    assert sorted(home[r.row] for r in kept) == sorted(set(home.values()))
    for r in kept:
        assert r.doc_id == min(least[home[r.row]] - {None}, default=None)


@pytest.mark.parametrize("rule", [N.Rule(3, 90, 100), N.Rule(5, 80, 100), N.Rule(1, 60, 100)])
def test_every_linked_pair_shares_a_signature_that_makes_candidates(rule):
    """The pigeonhole on random pairs at the very edge of the threshold."""
    rng = np.random.default_rng(rule.num)
    plan = N.bands(rule, 4000)
    for size in [1, 2, 3, 5, 9, 10, 11, 14, 19, 20, 27, 40, 64, 99, 150, 333, 900, 2500]:
        for _ in range(40):
            a = rng.integers(1, 2**62, size, dtype=np.uint64)
            # b drops some of a and adds others, as many in all as a link allows
            drop = int(rng.integers(0, size))
            for drop in range(drop, -1, -1):
                both = size - drop
                add = both * rule.den // rule.num - size
                if add >= 0:
                    break
            b = np.concatenate((rng.permutation(a)[:both], rng.integers(1, 2**62, int(rng.integers(0, add + 1)), dtype=np.uint64)))
            assert rule.linked(len(a), len(b), both)
            if not drop and len(b) == len(a):
                continue  # equal sets are one node
            text, value = np.repeat([0, 1], [len(a), len(b)]), np.concatenate((np.sort(a), np.sort(b)))
            who, signature, probe = N.signatures(text, value, np.array([len(a), len(b)]), plan)
            left = {}
            for w, s, p in zip(who, signature, probe, strict=True):
                if w == 0:
                    left[s] = left.get(s, False) or p
            met = {s for w, s, p in zip(who, signature, probe, strict=True) if w == 1 and s in left and (p or left[s])}
            assert met, (size, drop, len(b))
            # and in as many buckets as a pair that is told must have met
            band = next(x for x in reversed(plan) if x.low <= max(len(a), len(b)))
            differ = (len(a) + len(b)) * (rule.den - rule.num) // (rule.den + rule.num)
            assert len(met) >= band.need - band.deletions - differ, (size, drop, len(b))


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(4)
    for size in (3, 40, 500, 30_000):
        sets = [np.unique(rng.integers(1, 2**62, size, dtype=np.uint64)) for _ in range(2)]
        sets.append(np.unique(np.concatenate((sets[0][: size // 2], sets[1][: size // 3]))))
        text, value = np.repeat(range(3), [len(s) for s in sets]), np.concatenate(sets)
        sizes = np.array([len(s) for s in sets])
        bins = N.Sketches(N.sketches(text, value, sizes))
        assert bins.bins.tolist() == N.bins_for(sizes).tolist()
        i, j = np.array([0, 0, 1, 0]), np.array([1, 2, 2, 0])
        least = bins.differ(i, j)
        for x, y, found in zip(i, j, least, strict=True):
            assert found <= len(np.setxor1d(sets[x], sets[y]))
        assert least[3] == 0 and (size > 10_000 or least[0] > 0)


@pytest.mark.parametrize("limit", [2048, 4096])
@pytest.mark.parametrize("size, num", [(3, 90), (5, 80)])
def test_links_are_kept_where_sketches_grow(spark, limit, size, num):
    """Pairs just at the threshold whose sets lie on both sides of a size at which sketches get more bins."""
    rng = np.random.default_rng(limit + num)
    rule = N.Rule(size=size, num=num, den=100)
    rows, sketched = [], []
    for pair in range(6):
        words = [f"w{x}" for x in rng.integers(0, 2**40, limit + 480 + pair * 40)]
        whole = len(words) - size + 1
        shorter = words[: -(-whole * num // 100) + size - 1]  # the least that still links
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(shorter))]
        values = rng.integers(1, 2**62, whole, dtype=np.uint64)
        sketched += [np.unique(values), np.unique(values[: len(shorter) - size + 1])]
        words = [f"w{x}" for x in rng.integers(0, 2**40, limit - pair - 4)]  # and the larger one just below the limit
        rows += [(100 + 2 * pair, " ".join(words)), (101 + 2 * pair, " ".join(words[: -(-(len(words) - size + 1) * num // 100) + size - 1]))]
    sizes = np.array([len(s) for s in sketched])
    told = N.Sketches(N.sketches(np.repeat(np.arange(len(sketched)), sizes), np.concatenate(sketched), sizes))
    left = np.arange(0, len(sketched), 2)
    assert (told.differ(left, left + 1) <= sizes[left] - sizes[left + 1]).all()
    found = {r["doc_id"]: r["component_id"] for r in N.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}


def test_hot_signatures_are_dealt_to_salts():
    rng = np.random.default_rng(3)
    signature = np.concatenate((np.full(400, 7), rng.integers(100, 10_000, 3000), np.full(100, 9)))
    node = rng.integers(-(2**62), 2**62, len(signature))
    probe = rng.random(len(signature)) < 0.01
    probe[-100:] = False
    probe[5] = True
    mixed = rng.permutation(len(signature))
    out = N.salted(signature[mixed], node[mixed], probe[mixed], 1000)
    rows = list(zip(*[c.tolist() for c in out], strict=True))
    assert len(rows) == len(signature) + 2
    assert sorted((s, n, p) for s, salt, n, p in rows if salt or s not in (7, 9)) == sorted(zip(signature.tolist(), node.tolist(), probe.tolist(), strict=True))
    assert [(s, p) for s, salt, _, p in rows if s in (7, 9) and not salt] == [(7, True), (9, False)]
    assert len({salt for s, salt, *_ in rows if s == 7}) > 250 and all(salt == 0 for s, salt, *_ in rows if s not in (7, 9))


def test_a_hot_bucket_and_single_members_elsewhere(spark):
    """Near copies that fill some tasks, of which other tasks have one each; links must be those of a plain run."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def near():
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    other = lambda: " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, near()) for i in range(300)] + [(1000 + i, near() if i % 40 == 0 else other()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, "doc_id")
    found = {r["doc_id"]: r["component_id"] for r in N.similar_groups(docs, N.Rule(size=3, num=90, den=100)).collect()}
    assert found == {i: c for i, _, c in brute(rows, N.Rule(size=3, num=90, den=100))}


def test_folded_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(9)
    for smaller, larger in ((2040, 2300), (1900, 2110), (2048, 2049), (4090, 4560), (3800, 4200), (1000, 9000)):
        base = np.unique(rng.integers(1, 2**62, larger, dtype=np.uint64))
        sets = [np.unique(np.concatenate((base[:smaller - k], rng.integers(1, 2**62, k, dtype=np.uint64)))) for k in range(0, 200, 10)] + [base]
        sizes = np.array([len(s) for s in sets])
        told = N.Sketches(N.sketches(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), sizes))
        i = np.arange(len(sets) - 1)
        least = told.differ(i, np.full(len(i), len(sets) - 1))
        assert all(n <= len(np.setxor1d(sets[x], base)) for x, n in zip(i, least, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(1000, 1100)]  # a chain
    edges += [(5000, 5001 + i) for i in range(300)]  # a star
    edges += [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    edges += [(9, 9)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found) == set(parent)
    groups, expected = {}, {}
    for node in found:
        groups.setdefault(found[node], set()).add(node)
        expected.setdefault(find(node), set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
