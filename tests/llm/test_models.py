"""Trained models: boosting and calibration on made-up data, toxicity and quality on held-out documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvatica.llm import boosting as B
from sylvatica.llm import quality as Q
from sylvatica.llm import toxicity as T
from sylvatica.llm.words import distinct, shingles, slices, words


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    model = B.boost(x[:3000], y[:3000], fold=np.arange(3000) % 4 == 0)
    score = model.score(x[3000:])
    assert ((score >= 0.5) == y[3000:]).mean() > 0.95
    assert score.min() >= 0 and score.max() <= 1


def test_isotonic_is_monotone_and_pools():
    xs, ys = B.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0, 1, 0, 1, 1, 0]))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    assert np.interp([2, 3], xs, ys).tolist() == [0.5, 0.5]


def test_one_class_gives_a_constant():
    assert B.boost(np.zeros((3, 2)), np.array([1, 1, 1])).score(np.ones((2, 2))).tolist() == [1.0, 1.0]
    assert B.boost(np.zeros((0, 2)), np.zeros(0)).score(np.ones((1, 2))).tolist() == [0.0]


def test_words_against_a_plain_split():
    texts = ["", "a", " a  b\x0b c ", None, "É\x85x\xa0y z", "A a", "\n\n", "one two three four one two three"]
    column = pa.array(texts)
    for limit in (1, 1 << 20):
        seen = []
        for first, last, buffer, offsets in slices(column, limit):
            found = words(buffer, offsets)
            for s, e, t in zip(found.start, found.end, found.text, strict=True):
                seen.append((first + t, bytes(buffer[s:e]).decode()))
            text, value = distinct(*shingles(found, 3))
            sizes = np.bincount(text, minlength=last - first)
            for i in range(first, last):
                plain = [w for w in (texts[i] or "").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
                expected = {tuple(plain[k : k + 3]) for k in range(len(plain) - 2)} if len(plain) >= 3 else {tuple(plain)} if plain else set()
                assert sizes[i - first] == len(expected)
        assert seen == [(i, w) for i, t in enumerate(texts) for w in (t or "").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
    a, b = (words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).hash for t in ("WORD", "word"))
    assert a == b


def test_obfuscated_words_are_seen():
    abuse, none = T.fixed_lexicon(["idiot"]), T.Lexicon.empty()
    for text, plain, hidden in [("you Idiot!", 1, 0), ("an 1d10t", 0, 1), ("i.d.i.o.t", 1, 0), ("idi0t", 0, 1), ("idiotic", 0, 0)]:
        raw = np.frombuffer(text.encode(), np.uint8)
        x = dict(zip(T.FEATURES, T.features(raw, np.array([0, len(raw)]), none, abuse, T.fixed_lexicon(["you"]))[0], strict=True))
        assert (x["abuse_count"], x["hidden_density"] > 0) == (plain, bool(hidden)), text
    raw = np.frombuffer(b"you Idiot!", np.uint8)
    x = dict(zip(T.FEATURES, T.features(raw, np.array([0, len(raw)]), none, abuse, T.fixed_lexicon(["you"]))[0], strict=True))
    assert x["near_second_person"] == 1.0


LEARNED_WORD, LEARNED_STEM = "zonk", "gruml"


def learned():
    """A lexicon of one word and one stem."""
    raw = np.frombuffer(b"grumlab", np.uint8)
    p = T.Profile(raw, np.array([0, len(raw)]))
    (stem,), (head,) = (p.stem(k, np.array([0]))[1] for k in (5, 4))
    word = T.letters_hash(LEARNED_WORD)
    return T.Lexicon.of(np.array([word, stem], np.uint64), np.array([1.5, 2.5]), np.array([word, head], np.uint64))


def plain_features(text, abuse, second):
    """The features as their names say, byte by byte."""
    raw = text.encode()
    parts = [w for w in raw.translate(bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))).split(b" ") if w]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    low = lambda b: b + 32 if 65 <= b <= 90 else b
    leet = {ord(k): ord(v) for k, v in T.LEET.items()}
    letters = [bytes(low(b) for b in w if letter(b)) for w in parts]
    folded = [bytes(leet.get(b, low(b)) for b in w if letter(b) or b in leet) for w in parts]
    odds = [1.5 if w == b"zonk" else 2.5 if w.startswith(b"gruml") and len(w) > 5 else 0.0 for w in letters]
    other = [1.5 if w == b"zonk" else 0.0 for w in folded]  # stems are of plain letters only
    plain = [w in abuse for w in letters]
    hidden = [f != w and (f in abuse or o > 0) and not p and not t for w, f, o, p, t in zip(letters, folded, other, plain, odds, strict=True)]
    hit = [bool(p or t or h) for p, t, h in zip(plain, odds, hidden, strict=True)]
    you = [w in second for w in letters]
    near = [h and any(you[j] for j in range(max(0, i - 3), min(len(you), i + 4)) if j != i) for i, h in enumerate(hit)]
    n, size = max(len(parts), 1), max(len(raw), 1)
    count = lambda test: sum(map(bool, test))
    upper = lambda w: all(65 <= b <= 90 for b in w)
    digit = lambda w: any(48 <= b <= 57 for b in w)
    return [
        count(plain) / n, count(plain), sum(odds) / n, count(odds), sum(odds), max(odds, default=0), count(hidden) / n, count(near) / max(count(hit), 1), count(you) / n,
        count(65 <= b <= 90 for b in raw) / max(count(map(letter, raw)), 1), count(upper(w) and len(w) > 2 for w in parts) / n,
        raw.count(b"!") / size, raw.count(b"?") / size, count(a in b"!?" and b in b"!?" for a, b in zip(raw, raw[1:], strict=False)) / size, count(chr(b) in "#$%&*+/<=>@\\^_|~" for b in raw) / size,
        count(digit(w) and sum(map(letter, w)) > 1 for w in parts) / n, count(b"*" in w and any(map(letter, w)) for w in parts) / n, np.log1p(len(parts)),
        max((i + 1 for i, h in enumerate(hit) if h), default=0) / n,
    ]


def test_features_against_a_plain_reading():
    rng = np.random.default_rng(8)
    abuse, second = T.fixed_lexicon(["idiot", "crétin"]), T.fixed_lexicon(["you", "dein"])
    pool = ["idiot", "Idiot!", "1d10t", "IDIOT", "crétin", "you", "DEIN", "zonk", "Z0NK", "zonks", "grumlig", "GRUMLIGER?", "gruml", "plain", "word", "a1b2", "f*ck", "***", "!!??", "100", "A", "ABC", "É", "#tag", "x@y"]
    texts = ["", " ", "\t\n", "you", "idiot"] + [" ".join(rng.choice(pool, rng.integers(1, 40))) + rng.choice(["", "\n", " !!"]) for _ in range(200)]
    column = pa.array(texts)
    for limit in (1, 700, 1 << 20):
        found = np.concatenate([T.features(buffer, offsets, learned(), abuse, second) for _, _, buffer, offsets in slices(column, limit)])
        expected = np.array([plain_features(t, {b"idiot", "crétin".encode()}, {b"you", b"dein"}) for t in texts])
        for name, f, e in zip(T.FEATURES, found.T, expected.T, strict=True):
            assert np.allclose(f, e), (name, texts[int(np.abs(f - e).argmax())])


def test_contexts_do_not_cross_texts():
    """What stands before a text's first word does not hang on how the table is cut."""
    texts = ["zonk of it", "you zonk", "zonk"] * 40
    likely = np.array([T.letters_hash("zonk")], np.uint64)
    rows = lambda size: [b for i in range(0, len(texts), size) for b in T._contexts(likely)(iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + size]), pa.array([1] * len(texts[i : i + size])), pa.array([0] * len(texts[i : i + size]))], names=["t", "y", "p"])]))]
    seen = [sorted(map(str, (r for b in rows(size) for r in b.to_pylist()))) for size in (1, 2, 7, 120)]
    assert seen[0] == seen[1] == seen[2] == seen[3] and len(seen[0]) == 120


@pytest.fixture(scope="module")
def medium():
    return "/root/testdata/sf0.1"


def test_toxicity_on_held_out_documents(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score(docs, T.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic)
    assert len(rows) > 500 and right / len(rows) > 0.98 and caught / sum(r.toxic for r in rows) > 0.9  # a few are marked toxic without a toxic word
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_training_uses_no_held_out_label(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    chosen = T.training_labels(labels, sample=500).collect()
    import zlib

    assert len(chosen) == 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in chosen)


ODD = [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "x" * 200_000), (4, "word " * 60_000)]


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in ODD], "doc_id long, text string, score double, y int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = T.score(docs, T.fit(docs, none))
    assert sorted((r.doc_id or 0, r.score, r.predicted) for r in scored.collect()) == [(0, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0), (4, 0.0, 0)]
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert T.score(docs, T.fit(docs, odd)).count() == 6
    assert T.reject(docs, T.fit(docs, none)).columns == docs.columns
    assert T.score(docs.limit(0), T.fit(docs.limit(0), none)).count() == 0


def test_resampling_prefers_good_documents(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    drawn = Q.resample(docs, labels)
    share = {r.quality: r.s for r in labels.join(drawn.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0))).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.15
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in Q.resample(docs.repartition(3), labels).collect())


def test_weights_against_plain_counts(spark):
    """Log ratios and document weights from plain dictionaries of words and pairs."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Upper"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(150)] + ["", None, " \n", "w1"]
    good = {i for i in range(len(texts)) if i % 4 == 0}
    buckets = 64

    def bag(text):
        out = np.zeros(buckets)
        parts = [w for w in (text or "").replace("\n", " ").split(" ") if w]
        for i, word in enumerate(parts):
            one = word.encode()
            out[Q.grams(np.frombuffer(one, np.uint8), np.array([0, len(one)]), buckets)[1][0]] += 1
            if i:
                two = f"{parts[i - 1]} {word}".encode()
                out[Q.grams(np.frombuffer(two, np.uint8), np.array([0, len(two)]), buckets)[1][2]] += 1
        return out

    bags = [bag(t) for t in texts]
    raw, target = sum(bags), sum(b for i, b in enumerate(bags) if i in good)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = Q.log_ratio(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), buckets=buckets)
    assert np.allclose(found, ratio)
    weights = {r.doc_id: r.log_weight for r in Q.weigh(docs, found).collect()}
    assert all(np.isclose(weights[i], b @ ratio) for i, b in enumerate(bags))
    noise = np.array([r.g for r in spark.range(20_000).select(Q.gumbel("id").alias("g")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.var() - np.pi**2 / 6) < 0.08


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 1500])
def test_top_k_against_a_sort(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, float(key)) for i, key in enumerate(np.round(rng.normal(size=1000) * 3, 1))]  # many ties
    found = Q.top_k(spark.createDataFrame(rows, "doc_id long, key double").repartition(6), k).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k])


def test_resampling_of_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 1.0, True) for d, t in ODD], "doc_id long, text string, key double, good boolean")
    labels = spark.createDataFrame([(3, 1), (None, 1), (1, None)], "doc_id long, quality int")
    assert Q.resample(docs, labels).count() == 6
    assert 0 < Q.resample(docs, labels.limit(0)).count() <= 4
    assert Q.resample(docs.limit(0), labels).count() == 0


def test_the_sample_is_bounded_however_often_ids_repeat(spark):
    rows = [(i % 40, f"word{i % 7} you {'fool ' * (i % 2)} and text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []

    def boosted(x, y, **options):
        seen.append(len(y))
        return real(x, y, **options)

    real = T.boost
    T.boost = boosted
    try:
        T.fit(docs, labels, sample=25)
    finally:
        T.boost = real
    assert len(seen) == 1 and 0 < seen[0] <= 25


def test_documents_without_an_id_draw_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(5, "a"), (5, "b")], "doc_id long, text string")
    weighed = Q.weigh(docs, np.zeros(Q.BUCKETS)).collect()
    assert len({r.key for r in weighed if r.doc_id is None}) == 400
    assert len({r.key for r in weighed if r.doc_id == 5}) == 1
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert 195 <= Q.resample(docs, labels).count() <= 203
