"""Calls, exact numbers, regions, releases, trees, documents and sources against plain Python."""

from __future__ import annotations

import json
import math
import random
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from sylvatica.functions import documents, floats
from sylvatica.operators import calls, regions, trials, workflow
from sylvatica.plans import runs
from sylvatica.sources import ranged, releases, sinks

# --- calls ---------------------------------------------------------------------------------------------------


def test_outcomes_keep_order_bound_and_limit():
    running, most, lock = [0], [0], threading.Lock()

    def call(model, parts):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            n = int(parts[0]["value"])
            time.sleep(60 if n == 3 else 0.001 * (n % 5))
            if n % 4 == 1:
                raise KeyError(n)
            return None if n == 2 else f"{model}{n}"
        finally:
            with lock:
                running[0] -= 1

    began = time.monotonic()
    told = list(calls.outcomes(call, [("m", [{"kind": "text", "value": str(n)}]) for n in range(60)], in_flight=3, timeout=2))
    assert time.monotonic() - began < 30 and most[0] <= 4  # the late one has lost its slot, but still runs
    for n, outcome in enumerate(told):
        if n == 3:
            assert outcome == {"answer": None, "error": "TimeoutError: no answer within 2 s"}
        elif n % 4 == 1:
            assert outcome == {"answer": None, "error": f"KeyError: {n}"}
        else:
            assert outcome == ({"answer": None, "error": "ValueError: no answer"} if n == 2 else {"answer": f"m{n}", "error": None})


def test_too_many_late_calls_are_refused():
    told = list(calls.outcomes(lambda m, p: time.sleep(3), [("m", [])] * 40, in_flight=1, timeout=0.01))
    assert len(told) == 40 and 40 - calls.LATE - 3 <= sum("late calls" in t["error"] for t in told) <= 40 - calls.LATE


def test_a_failed_step_is_a_row_and_is_asked_again(spark):
    from sylvatica.plans import catalogue

    sample, paths, refs = catalogue._trial_tables(spark, "/root/testdata/sf0.001")
    todo = trials.with_truth(trials.tasks(sample, ("key_flower_type",), ["m"], limit=9), paths, ("key_flower_type",))

    def make(first):
        def call(model, parts):
            if first and parts[0]["value"].endswith("3"):
                raise ConnectionError("gone")
            return "YES" if len(parts) == 2 else "2"

        return lambda: call

    def run(rows, first):
        ask, values = calls.isolated_call(make(first)), trials.feature_values(refs.select("feature", F.col("feature_value").alias("value")))
        done = trials.second_phase(trials.first_phase(rows, ask).checkpoint(), trials.options(refs), values, ask)
        return trials.step_results(trials.scored(done), "t", "now", "mock", "9", "key_flower_type").checkpoint()

    first = run(todo, True)
    failed = [r for r in first.collect() if r.error]
    assert failed and all(r.error == "ConnectionError: gone" and r.p1_raw is None and r.p1_parsed is None and r.p2_parsed is None and r.feature_correct is None for r in failed)
    assert trials.error_count(first).collect()[0].errors == len(failed)
    left = trials.remaining(todo, calls.succeeded(first), trials.TASK_KEY)
    assert sorted(r.observation_id for r in left.collect()) == sorted(r.observation_id for r in failed)
    assert not [r for r in run(left, False).collect() if r.error]


# --- exact numbers -------------------------------------------------------------------------------------------


def doubles(n, seed):
    rng = random.Random(seed)
    yield from (1e-05, 1e16, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1e23, 9.999999999999999e22, 2e23, 9007199254740993.0, 0.1, 1 / 3, 123456789012345680.0, 2.2e-322, 1e-4, 9.9999e-05)
    yield from (9999999999999998.0, -0.0, 0.0, math.inf, -math.inf, 611397096517495.75, 2.0**-1074 * 3, 1.0e-100, 1e100, 1e101, 9.99999999999999e-101)
    yield from (math.nextafter(10.0**k, d) for k in range(-307, 308, 7) for d in (0, math.inf))
    for _ in range(n):
        yield rng.uniform(-1, 1)
        yield struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        yield round(rng.uniform(-5000, 5000), rng.randrange(12))


def test_spelling_equals_python(spark):
    values = [v for v in doubles(6000, 1)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(4)
    for x, text in df.select("x", floats.python_text(F.col("x")).alias("t")).collect():
        assert text == (None if x is None else repr(x))


def test_whole_columns_are_spelled_in_batches(spark, sf_dir):
    values = [*doubles(500, 4), math.nan]
    for rows in (values, [*values, None]):
        df = spark.createDataFrame([(v,) for v in rows], "x double").repartition(2)
        for x, text in df.select("x", floats.told_by_python(F.col("x")).alias("t")).collect():
            assert text == (None if x is None else repr(x))
    plan = runs.float_text(spark, sf_dir)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_short_doubles_are_spelled_without_trials(spark, monkeypatch):
    monkeypatch.setattr(floats, "_shortest", lambda size: F.when(size.isNotNull(), F.raise_error(F.lit("tried"))).cast("struct<digits: string, point: int>"))
    values = [float(f"{sign}{digits}e{power}") for sign in ("", "-") for digits in ("1", "12.5", "999999999999999", "1.00000000000001") for power in (-5, -4, -3, 0, 1, 6, 7, 15, 16)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(2)
    told = df.select("x", F.transform(F.array("x"), floats.python_text)[0].alias("t")).collect()
    few = [(x, t) for x, t in told if len(repr(abs(x)).split("e")[0].replace(".", "").strip("0")) <= 15]
    assert len(few) == len(values) and all(t == repr(x) for x, t in few)


def test_rounding_equals_python(spark):
    rng = random.Random(2)
    values = [v for v in doubles(100_000, 3)]
    values += [(2 * k + 1) / 128 for k in range(60_000)] + [-(2 * rng.randrange(2**40) + 1) / 128 for _ in range(20_000)]  # halfway in binary
    values += [(2 * k + 1) / 2e6 for k in range(100_000)]  # halfway as text only
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    for x, found in df.select("x", floats.half_even(F.col("x"), 6).alias("t")).collect():
        assert repr(found) == repr(round(x, 6) if math.isfinite(x) else x), x


@pytest.mark.parametrize("digits", [0, 2, 15])
def test_rounding_to_other_digits(spark, digits):
    values = [v for v in doubles(2000, 4)] + [k / 2 for k in range(-50, 50)] + [k / 8 for k in range(-500, 500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for x, found in df.select("x", floats.half_even(F.col("x"), digits).alias("t")).collect():
        assert repr(found) == repr(round(x, digits) if math.isfinite(x) else x), x
    with pytest.raises(ValueError):
        floats.half_even(F.col("x"), 16)


def test_points_are_spelled_as_a_tuple(spark):
    kind = "p array<struct<x: double, y: double>>"
    rows = [[(0.1, 1e-07), (2.0, 0.5)], [(1.0, 0.0)], []]
    found = [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).coalesce(1).select(floats.python_points(F.col("p"))).collect()]
    assert found == [repr(tuple(r)) for r in rows]


def test_the_digest_of_a_proposal_needs_no_python_worker(spark):
    from sylvatica.operators import notices

    df = spark.createDataFrame([("o", None, "leaf", 0, [(0.1, 0.2)])], "o string, u string, l string, n int, p array<struct<x: double, y: double>>")
    made = df.select(notices.proposal_id(F.col("o"), F.col("u"), F.col("l"), F.col("n"), F.col("p")).alias("d"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    import hashlib

    assert made.collect()[0].d == "notice-proposal-" + hashlib.sha256(b"o|None|leaf|0|((0.1, 0.2),)").hexdigest()[:16]


# --- masks ---------------------------------------------------------------------------------------------------


def plain_regions(cells, width):
    left, out = {i for i, c in enumerate(cells) if c}, []
    while left:
        stack, found = [min(left)], set()
        while stack:
            i = stack.pop()
            if i in left:
                left.remove(i)
                found.add(i)
                stack += [j for j in left if abs(j % width - i % width) <= 1 and abs(j // width - i // width) <= 1]
        xs, ys = [i % width for i in found], [i // width for i in found]
        out.append((min(found), len(found), min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


def test_regions_against_a_flood_fill(spark):
    rng = random.Random(5)
    masks = [(n, [rng.random() < p for _ in range(w * h)], w) for n, (w, h, p) in enumerate([(9, 7, 0.3), (8, 8, 0.5), (16, 16, 0.42), (1, 9, 0.6), (9, 1, 0.6)] * 6)]
    spiral = [[False] * 21 for _ in range(21)]
    for y in range(0, 21, 2):  # one long region that winds through all rows
        spiral[y] = [True] * 21
        if y + 1 < 21:
            spiral[y + 1][20 if y % 4 == 0 else 0] = True
    masks += [(100, sum(spiral, []), 21), (101, [False] * 9, 3), (102, [], 3), (103, None, 3), (104, [True, None, True, True], 2), (105, [True] * 64, 8)]
    df = spark.createDataFrame(masks, "mask_id long, cells array<boolean>, width int")
    found = {r.mask: r for r in regions.largest(regions.region_figures(regions.labelled(regions.runs(df)))).collect()}
    for n, cells, width in masks:
        expected = plain_regions([bool(c) for c in cells or []], width)
        if not expected:
            assert n not in found
            continue
        best = max(expected, key=lambda r: (r[1], -r[0]))
        r = found[n]
        assert (r.area, r.x0, r.y0, r.x1, r.y1, r.regions) == (*best[1:], len(expected)), n


# --- releases, trees, documents ------------------------------------------------------------------------------


def test_broken_releases_stop_no_other(spark):
    good = {"manifest": {"release_id": "r", "contract_version": "1", "source": {"devo_name": "d", "version": "1", "content_hash": "h"}}}
    good |= {t: [] for t in ("devo_registry", "devo_features", "devo_feature_values", "devo_images", "devo_annotations", "devo_taxa")}
    good["devo_taxon_feature_value"] = [{"devo_name": "d", "taxon_name": "t", "vocab_id": 7}, {"taxon_name": None}]
    missing = {k: v for k, v in good.items() if k != "devo_taxa"}
    null, no_list = good | {"devo_images": None}, good | {"devo_images": "x"}
    no_field = json.loads(json.dumps(good))
    del no_field["manifest"]["source"]["version"]
    texts = {"good": json.dumps(good), "missing": json.dumps(missing), "null": json.dumps(null), "no_list": json.dumps(no_list), "no_field": json.dumps(no_field), "cut": json.dumps(good)[:-2], "empty": "", "none": None}
    found = releases.releases_from_texts(spark.createDataFrame(list(texts.items()), "path string, value string"))
    expected = {("missing", "a table is missing", "devo_taxa"), ("null", "a table is missing", "devo_images"), ("no_list", "a table is no list", "devo_images"), ("no_field", "the manifest lacks a field", "source_version")}
    expected |= {(p, "the document is no JSON", "document") for p in ("cut", "empty", "none")}
    assert {tuple(r) for r in found.violations.collect()} == expected
    assert [(r.release_id, r.taxon_name, r.vocab_id) for r in found.table("claims").orderBy("vocab_id").collect()] == [("r", None, None), ("r", "t", "7")]
    assert found.table("taxa").count() == 0 and found.heads.count() == len(texts)


def test_levels_of_paths_send_no_side_to_the_driver(spark, monkeypatch):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "node_id string, parent_id string")
    monkeypatch.setattr(workflow, "settled", lambda df: df)
    plan = workflow.node_paths(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "strategy=broadcast" not in plan


def test_paths_and_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), ("o", "gone"), ("p", "o"), ("r", "")]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string")
    assert {tuple(r) for r in workflow.node_paths(nodes).collect()} == {("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c"), ("r", 0, "r")}
    assert {r.node_id for r in workflow.cycle_nodes(nodes).collect()} == {"x", "y", "s"}
    assert workflow.node_paths(nodes.limit(0)).count() == workflow.cycle_nodes(nodes.limit(0)).count() == 0
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(130)], "node_id string, parent_id string")
    assert workflow.node_paths(chain).agg(F.max("depth")).collect()[0][0] == 129  # beyond Spark's own bound of levels
    with pytest.raises(Exception, match="RECURSION"):
        workflow.node_paths(chain, deepest=20)


def test_documents_print_as_python_does(spark):
    kind = "b string, a array<struct<z: double, y: array<long>>>, m: map<string, boolean>, e struct<k: string>, d double, `é` int, `a\"b` string"
    kind = kind.replace("m: map", "m map")
    rows = [
        {"b": 'x"\\\n\t\x08\x0c\r\x01\x7fé€\U0001f600 z', "a": [{"z": 0.1, "y": [1, 2]}, {"z": 1e-7, "y": []}, None], "m": {"b": True, "a": None, "é": False}, "e": {"k": None}, "d": math.nan, "é": 3, 'a"b': "/"},
        {"b": "", "a": [], "m": {}, "e": None, "d": -math.inf, "é": None, 'a"b': None}, {"b": None, "a": None, "m": None, "e": {"k": "plain"}, "d": 5e-324, "é": -1, 'a"b': "\U0010ffff퟿"},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("d")).coalesce(1)
    found = [r[0] for r in whole.select(documents.canonical(F.col("d"), whole.schema["d"].dataType)).collect()]
    assert found == [json.dumps(r, indent=2, sort_keys=True) + "\n" for r in rows]


def test_of_two_writers_at_once_one_wins(spark, tmp_path):
    target, ready = str(tmp_path / "target"), threading.Barrier(2)
    results = []

    def write(n):
        df = spark.range(n, n + 3).repartition(3)
        ready.wait()
        try:
            sinks.write_once(df, target)
            results.append(n)
        except Exception as error:  # noqa: BLE001
            results.append(type(error).__name__)

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [r for r in results if isinstance(r, int)]
    assert len(won) == 1 and len(results) == 2
    assert sorted(r.id for r in spark.read.json(target).collect()) == [won[0] + i for i in range(3)]
    with pytest.raises(Exception, match="exist"):
        sinks.write_once(spark.range(1), target)
    assert not list(tmp_path.glob("*.claim"))
    (tmp_path / "other.claim").touch()  # a writer that died
    with pytest.raises(FileExistsError):
        sinks.write_once(spark.range(1), str(tmp_path / "other"))


# --- the source ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_line_once(spark, tmp_path, size):
    lines = [json.dumps({"n": i, "t": "x" * (i * 7 % 50)}) for i in range(40)] + ["", "[1]", '{"cut": ', "é", '{"last": 1}']
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode() + b"\n\xff\xfe")
    (tmp_path / "sub" / "b.jsonl").write_bytes("\n".join(lines[:5]).encode() + b"\n")
    (tmp_path / "empty").touch()
    (tmp_path / "_SUCCESS").touch()
    found = ranged.read_lines(spark, str(tmp_path), size).collect() if size > 1 else [r for p in ("a.jsonl", "sub/b.jsonl") for r in plain_ranges(tmp_path, p, size)]
    own = sorted((r.start, r.value, r.error) for r in found if r.path == "a.jsonl")
    assert [v for _, v, _ in own] == [*lines, None]
    assert [e for _, _, e in own if e] == ["JSONDecodeError: Expecting value", "no object", "JSONDecodeError: Expecting value", "JSONDecodeError: Expecting value", "UnicodeDecodeError: invalid start byte"]
    assert [r.value for r in sorted((r for r in found if r.path == "sub/b.jsonl"), key=lambda r: r.start)] == lines[:5]


def plain_ranges(folder, name, size):
    """Ranges of one byte, without a task for each."""
    from pyspark.sql import Row

    import pyarrow.fs as pfs

    store = pfs.LocalFileSystem()
    with store.open_input_file(str(folder / name)) as file:
        total = file.size()
        for at in range(0, total, size):
            for start, line in ranged.lines_of(file, at, min(at + size, total)):
                text, error = ranged.object_error(line)
                yield Row(path=name, start=start, value=text, error=error)


def test_a_filter_on_the_path_chooses_files(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text('{"n": 1}\n' * 3)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        lines = ranged.read_lines(spark, str(tmp_path))
        assert lines.where("path = 'b'").count() == 3 and lines.where("path IN ('a', 'c')").rdd.getNumPartitions() == 2
        assert lines.where("path = 'b' AND start > 0").count() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before or "false")
    (tmp_path / "a").unlink()
    reader = ranged.RangedReader({"path": str(tmp_path)})
    batch = next(iter(reader.read(ranged.Range("a", 0, 9))))
    assert batch.column(3).to_pylist() == ["FileNotFoundError: the range cannot be read"]


# --- the table function --------------------------------------------------------------------------------------


def test_table_function_tells_failures_and_keeps_ordinals(spark):
    from sylvatica.operators import notices
    from sylvatica.plans import catalogue

    frames = catalogue.told_frames(spark, "/root/testdata/sf0.001").limit(60)
    frames = frames.unionByName(frames.limit(3).withColumn("frame_index", F.lit(1)))
    notices.register_segmenter(spark, "told_regions", catalogue.TableSegmenter)
    found = spark.sql("SELECT * FROM told_regions(TABLE({frames}) PARTITION BY observation_id ORDER BY frame_index)", frames=frames)
    plain = notices.segmented(frames, catalogue.TableSegmenter)
    each = plain.where("error_type IS NULL").select("observation_id", "frame_index", F.posexplode("segments").alias("ordinal", "s"))
    key = lambda r: (r.observation_id, r.frame_index, r.ordinal, r.s)
    assert sorted(map(key, found.where("error_type IS NULL").collect())) == sorted(map(key, each.collect()))
    told = lambda df: sorted((r.observation_id, r.error_type, r.message) for r in df.where("error_type IS NOT NULL").collect())
    assert told(found) == told(plain) and told(found)
