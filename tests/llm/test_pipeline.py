"""The pipeline against its stages done plainly, and its registration."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline as C
from sylvatica.llm import near_dedup, packing
from sylvatica.llm.storage import settle
from sylvatica.session import table
from tests.llm.test_mixing import shares
from tests.llm.test_near_dedup import shingle_set


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic, clean_ones = ({r.doc_id for r in table(spark, sf_dir, "labels").where(f"toxic = {y}").collect()} for y in (1, 0))
    seen = {}
    current = docs
    for name, stage in C.STAGES:
        current = settle(stage(spark, current, sf_dir), "test")
        seen[name] = current
        if name != C.STAGES[-1][0]:
            assert current.columns == docs.columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    clean = ids("toxicity")
    assert len(clean & toxic) <= 0.1 * len(toxic) and len(clean_ones - clean) < 0.03 * len(clean_ones)
    plain = {}
    for doc in sorted(clean):
        plain.setdefault("".join((rows[doc] or "").split()), []).append(doc)
    assert len(ids("exact_dedup")) == len(plain) == seen["exact_dedup"].count()
    assert ids("near_dedup") <= ids("exact_dedup")
    assert seen["packing"].groupBy("sequence_id").count().where("count > 1").count() == 0
    assert ids("packing") == ids("mixing") <= ids("near_dedup")


SPACES = bytes((0x20, 9, 10, 11, 12, 13))


def test_whole_pipeline_against_a_plain_run(spark, tmp_path, sf_dir):
    """All stages after the model's, done over again with dictionaries, on documents with repeated and null ids."""
    where, rng = str(tmp_path), random.Random(4)
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, sf_dir, "documents").limit(150).collect()]
    odd = [(r[0], r[1] and r[1].replace(" ", "  ", 3), *r[2:]) for r in rng.sample(base, 15)]
    odd += [(None if i % 2 else 100_000 + i, (r[1] or "") + " and one more", *r[2:]) for i, r in enumerate(rng.sample(base, 30))]
    odd += [base[3], base[3], (None, "", "en", None, 0), (None, None, "en", None, 0), (777_777, "", "en", "s", 0)]
    rows = [(*r, i) for i, r in enumerate(base + odd)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long").repartition(5).write.parquet(f"{where}/documents.parquet")
    table(spark, sf_dir, "labels").write.parquet(f"{where}/labels.parquet")
    seen, current = {}, table(spark, where, "documents")
    for name, stage in C.STAGES:
        current = settle(stage(spark, current, where), "test")
        seen[name] = [r.asDict() for r in current.collect()]
    after = lambda name: {r["row"] for r in seen[name]}
    text, doc = {r[5]: r[1] or "" for r in rows}, {r[5]: r[0] for r in rows}
    number = lambda row: (doc[row] is None, doc[row] or 0)

    groups = {}
    for row in after("toxicity"):
        groups.setdefault(text[row].encode().translate(None, SPACES), []).append(row)
    stays = {}
    for plain, members in groups.items():
        best = min(members, key=lambda r: (-len(text[r]), *number(r)))
        stays[plain] = {(len(text[best]), doc[best])}
    exact = after("exact_dedup")
    assert len(seen["exact_dedup"]) == len(exact) == len(groups)
    assert all({(len(text[r]), doc[r])} == stays[text[r].encode().translate(None, SPACES)] for r in exact)

    rule = near_dedup.Rule(5, 80, 100)
    home = {}
    order = sorted(exact)
    sets = {r: shingle_set(text[r], 5) for r in order}
    root = {r: r for r in order}

    def find(r):
        while root[r] != r:
            r = root[r]
        return r

    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    for r in order:
        home.setdefault(find(r), []).append(r)
    near = after("near_dedup")
    assert len(seen["near_dedup"]) == len(near)
    assert {r for r in order if not sets[r]} <= near
    for members in home.values():
        if sets[members[0]]:
            (kept,) = near & set(members)
            assert number(kept) == min(map(number, members))
    assert len(home) < len(order)  # some were near copies

    sizes, words = {}, {r: len(re.findall(r"[^\x20\x09-\x0D]+", text[r])) for r in near}
    source = {r[5]: r[3] for r in rows}
    for r in near:
        sizes[source[r]] = sizes.get(source[r], 0) + words[r]
    target = shares(sizes)
    taken = Counter(r["row"] for r in seen["mixing"])
    for r in near:
        rate = min(target[source[r]] / sizes[source[r]], 3.0) if sizes[source[r]] else 0.0
        name = str(doc[r]) if doc[r] is not None else "null-" + hashlib.md5(text[r].encode()).hexdigest()
        coin = int(hashlib.md5(f"mix-1:{name}".encode()).hexdigest()[:8], 16) / 2**32
        assert taken[r] == int(rate) + (coin < rate - int(rate)), r
    assert set(taken) <= near

    pieces = Counter()
    for r in seen["packing"]:
        pieces[r["doc_id"]] += r["length"]
    encode = packing.encoder(packing.TOKENIZER)
    expected = Counter()
    for r, copies in taken.items():
        expected[doc[r]] += copies * (len(encode(text[r])) + 1)
    assert pieces == expected
    assert len({r["sequence_id"] for r in seen["packing"]}) == len(seen["packing"]) and all(r["length"] & (r["length"] - 1) == 0 for r in seen["packing"])


def test_odd_documents(spark, tmp_path, sf_dir):
    rows = [(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s"), (None, "some text here", "en", None), (5, "word " * 50_000, "en", "s"), (6, "a b c", None, "t")]
    where = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    assert C.run(spark, where).count() >= 1
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert C.run(spark, empty).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
