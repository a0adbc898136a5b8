"""Whole operators on small tables: goldens, rules that must raise, and traps of nulls and order."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sylvatica.operators import gate, keys, notices, releases, trials, workflow
from sylvatica.schemas import EVIDENCE, FEATURE_EVIDENCE, FRAME, NODE
from sylvatica.sources import readers, sinks

NODES = [
    ("kingdom:plantae", "Plantae", "taxon", None, "kingdom", None), ("notice:leaf", "leaf", "notice", "kingdom:plantae", None, None),
    ("feature:leaf-arrangement", "arrangement", "feature", "notice:leaf", None, "leaf_arrangement"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, NODE)


@pytest.mark.parametrize(("states", "tasks"), [
    ([], ["kingdom:plantae"]), ([("kingdom:plantae", "confirmed")], ["notice:leaf"]),
    ([("kingdom:plantae", "confirmed"), ("notice:leaf", "confirmed")], ["feature:leaf-arrangement"]), ([("kingdom:plantae", "rejected")], []),
    ([("kingdom:plantae", "unknown"), ("kingdom:plantae", "confirmed")], ["notice:leaf"]),
])
def test_next_tasks(spark, nodes, states, tasks):
    evidence = spark.createDataFrame([(i, n, s, None, None) for i, (n, s) in enumerate(states)], EVIDENCE)
    assert sorted(r.node_id for r in workflow.next_tasks(nodes, evidence).collect()) == tasks


def test_workflow_rules(spark, nodes):
    workflow.validate_workflow(nodes)
    loop = spark.createDataFrame([("a", "a", "notice", "b", None, None), ("b", "b", "notice", "a", None, None), ("r", "r", "notice", None, None, None), ("c", "c", "notice", "a", None, None)], NODE)
    assert sorted(r.subject for r in workflow.cycle_violations(loop).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        workflow.validate_workflow(loop)
    twice = nodes.unionByName(nodes.limit(1))
    with pytest.raises(ValueError, match="duplicate"):
        workflow.validate_workflow(twice)


CLAIMS = [("r1", "Acer campestre", "leaf", "v1"), ("r1", "Acer campestre", "leaf", "v2"), ("r1", "Acer rubrum", "leaf", "v1"), ("r2", "Acer campestre", "bark", "w"), ("r2", "Acer rubrum", "bark", "w"), ("r2", "Quercus alba", "bark", "w")]
LINEAGE = [("Acer campestre", "Sapindaceae", "Acer"), ("Acer rubrum", "Sapindaceae", "Acer"), ("Quercus alba", "Fagaceae", "Quercus")]


def test_recommend(spark):
    claims = spark.createDataFrame(CLAIMS, "release_id string, taxon_name string, feature_name string, vocab_id string")
    lineage = spark.createDataFrame(LINEAGE, "taxon_name string, family string, genus string")
    asked = {"one": [("r1", "leaf", "v1"), ("r1", "leaf", "v2"), ("r2", "bark", "w")], "two": [("r1", "leaf", "v1"), ("r1", "leaf", "v1")], "three": [("r2", "bark", "w")], "none": [("r1", "leaf", "v9")]}
    evidence = spark.createDataFrame([(c, r, f, v, "n", None, None, "confirmed") for c, rows in asked.items() for r, f, v in rows], FEATURE_EVIDENCE)
    cases = spark.createDataFrame([(c,) for c in [*asked, "empty"]], "case_id string")
    found = {r.case_id: (r.status, r.taxon_rank, r.shared_taxon) for r in workflow.recommend(cases, claims, evidence, lineage).collect()}
    assert found == {
        "one": ("recommended", "species", "Acer campestre"), "two": ("ambiguous", "genus", "Acer"), "three": ("ambiguous", None, None), "none": ("no_match", None, None), "empty": ("no_evidence", None, None),
    }


def release_document(**changes):
    document = {
        "manifest": {"contract_version": "1", "release_id": "r", "source": {"devo_name": "voc", "version": "1", "content_hash": "h"}},
        "devo_registry": [{"devo_name": "voc"}], "devo_features": [], "devo_images": [], "devo_annotations": [],
        "devo_feature_values": [{"devo_name": "voc", "vocab_id": "v", "feature_name": "f", "source_value_id": "f:0"}],
        "devo_taxa": [{"devo_name": "voc", "taxon_name": "Acer campestre", "source_taxon_id": "1520"}],
        "devo_taxon_feature_value": [{"devo_name": "voc", "taxon_name": "Acer campestre", "feature_name": "f", "vocab_id": "v", "assertion_source": "s", "extra": 1}],
    }
    return document | changes


def test_release(spark, tmp_path):
    path = tmp_path / "release.json"
    path.write_text(json.dumps(release_document(), indent=1))
    release = releases.validate_release(readers.read_release(spark, str(path)))
    case = releases.cases_for_taxon(release, "Acer campestre").collect()
    assert [(c.vocabulary_name, c.vocabulary_release_id, c.source_taxon_id, c.source_value_id, c.source_context_id) for c in case] == [("voc", "r", "1520", "f:0", None)]
    with pytest.raises(KeyError):
        releases.cases_for_taxon(release, "Nobody")
    import hashlib

    assert release.manifest.first().data_hash == "sha256:" + hashlib.sha256(path.read_bytes()).hexdigest()
    made = releases.provenance(release, "t", "m", "1", "2024-01-01T00:00:00+00:00").first()
    assert (made.trial_id, made.release_id, made.vocabulary_name) == ("t", "r", "voc")


@pytest.mark.parametrize(("changes", "rule"), [
    ({"devo_registry": [{"devo_name": "other"}]}, "registry"), ({"devo_taxa": []}, "unknown taxon"), ({"devo_feature_values": []}, "unknown value"),
    ({"devo_taxa": [{"taxon_name": "Acer campestre"}] * 2}, "duplicate"), ({"devo_taxa": [{"taxon_name": "Acer campestre"}, {"taxon_name": ""}]}, "missing"),
    ({"devo_feature_values": [{"vocab_id": "v", "feature_name": "g"}]}, "not its value"),
])
def test_bad_releases(spark, changes, rule):
    text = spark.createDataFrame([(json.dumps(release_document(**changes)),)], "value string")
    with pytest.raises(ValueError, match=rule):
        releases.validate_release(readers.release_from_text(text))


def test_release_in_parts(spark, tmp_path):
    more = {"devo_registry": [], "devo_feature_values": [], "devo_taxa": [{"devo_name": "voc", "taxon_name": "Acer rubrum", "source_taxon_id": "7"}]}
    texts = [json.dumps(release_document()), json.dumps(release_document(**more))]
    for n, text in enumerate(texts):
        (tmp_path / f"part{n}.json").write_text(text)
    release = releases.validate_release(readers.read_release(spark, str(tmp_path)))
    assert sorted(t.taxon_name for t in release.taxa.collect()) == ["Acer campestre", "Acer rubrum"]
    assert [c.canonical_taxon_id for c in releases.experiment_cases(release).collect()] == ["Acer campestre"] * 2  # a claim in each part
    import hashlib

    told = sorted("sha256:" + hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert [m.data_hash for m in release.manifest.collect()] == ["sha256:" + hashlib.sha256("\n".join(told).encode()).hexdigest()]
    other = json.dumps(release_document() | {"manifest": release_document()["manifest"] | {"release_id": "another"}})
    with pytest.raises(Exception, match="different manifests"):
        readers.release_from_text(spark.createDataFrame([(texts[0],), (other,)], "value string")).manifest.collect()


def test_a_large_release_is_written_in_parts(spark, sf_dir, monkeypatch):
    from sylvatica.plans import documents

    monkeypatch.setattr(documents, "_PART", 40)
    parts = documents._release_parts(spark, sf_dir).collect()
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    sizes = [len(json.loads(p.value)["devo_taxa"]) for p in parts]
    assert len(parts) == -(-customers // 40) and sum(sizes) == customers and max(sizes) < 100
    assert documents.release_document(spark, sf_dir).count() == customers


def test_release_without_a_table(spark):
    document = release_document()
    del document["devo_images"]
    with pytest.raises(Exception, match="devo_images"):
        readers.release_from_text(spark.createDataFrame([(json.dumps(document),)], "value string")).manifest.collect()


def test_metrics(spark):
    rows = [("classified", "v", "v"), ("abstained", None, "v"), ("classified", "x", "v")]
    metrics = releases.classification_metrics(spark.createDataFrame(rows, "o string, p string, t string"), F.col("o"), F.col("p"), F.col("t")).first()
    assert (metrics.total_records, metrics.correct_classifications, metrics.classification_accuracy, metrics.classification_coverage) == (3, 1, 0.5, 2 / 3)
    alone = releases.classification_metrics(spark.createDataFrame(rows[1:2], "o string, p string, t string"), F.col("o"), F.col("p"), F.col("t")).first()
    assert alone.classification_accuracy is None and alone.classification_coverage == 0.0


def test_tasks_multiply_after_an_observation_is_chosen(spark):
    sample = spark.createDataFrame([(1, "b", "y"), (1, "a", "z"), (2, None, "x")], "observation_id long, species_inat string, guide_species_name string")
    made = trials.tasks(sample, ["key_leaf_type", "key_flower_type", "key_leaf_type"], ["one", "two", "one"])
    assert sorted((r.model, r.observation_id, r.feature, r.guide_species_name) for r in made.collect()) == sorted(
        (m, o, f, g) for m in ("one", "two") for f in ("key_leaf_type", "key_flower_type") for o, g in (("1", "z"), ("2", "x")))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # the window sees observations, not tasks


class Frames:
    """Hands out the function that would run in the tasks."""

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):  # noqa: N802
        return run


def test_regions_of_a_batch_are_given_by_slices():
    import pandas as pd

    run = notices.segmented(Frames(), Fake)
    rows = [{"observation_id": "bad" if n in (notices.SLICE - 1, notices.SLICE) else str(n), "frame_index": 0} for n in range(4 * notices.SLICE + 1)]
    given = list(run(iter([pd.DataFrame(rows), pd.DataFrame(rows[:0]), pd.DataFrame(rows[:1])])))
    assert max(map(len, given)) == notices.SLICE
    whole = pd.concat(given)
    assert list(whole.observation_id) == [r["observation_id"] for r in [*rows, rows[0]]]
    assert [kind is not None for kind in whole.error_type] == [o == "bad" for o in whole.observation_id] and (whole.error_type == "ValueError").sum() == 2


def test_memory_of_failing_frames_does_not_grow_with_a_batch():
    import tracemalloc

    import pandas as pd

    class Large:
        def segment(self, frame, prompts):
            if frame["frame_index"] % 17 == 0:
                raise RuntimeError(frame["observation_id"])
            return [{"label": "leaf", "polygon": [(0.5, n / 64) for n in range(64)], "detection_confidence": 1, "mask_quality": 1}]

    def peak(rows):
        batch = pd.DataFrame([{"observation_id": str(n), "frame_index": n} for n in range(rows)])
        run = notices.segmented(Frames(), Large)
        tracemalloc.start()
        try:
            failed = sum(part.error_type.notna().sum() for part in run(iter([batch])))
            return failed, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (few, least), (many, most) = peak(2 * notices.SLICE), peak(16 * notices.SLICE)
    assert (few, many) == (-(-2 * notices.SLICE // 17), -(-16 * notices.SLICE // 17)) and most < 2 * least


class Fake:
    """Finds a leaf and a flower in every frame but one."""

    model_name, model_version = "fake", "1"

    def segment(self, frame, prompts):
        if frame["observation_id"] == "bad":
            raise ValueError("no picture")
        score = 0.95 if frame["frame_index"] == 1 else 0.55
        return [
            {"label": "leaf", "polygon": [(0.2, 0.2), (0.8, 0.2), (2.0, 0.75)], "detection_confidence": 1, "mask_quality": 1},
            {"label": "leaf", "polygon": [(0.2, 0.2), (0.8, 0.2), (0.75, 0.75), (0.25, 0.8)], "detection_confidence": score, "mask_quality": score, "stability_score": 0.9},
            {"label": "flower", "polygon": [(0, 0), (0.01, 0), (0.01, 0.01)], "detection_confidence": 0.2, "mask_quality": 0.3},
        ]


@pytest.fixture(scope="module")
def segments(spark):
    row = lambda i, n: (i, f"u/{i}", "s", None, None, None, None, None, None, n)
    frame = spark.createDataFrame([row("a", 0), row("b", 1), row("bad", 2)], FRAME)
    return frame, notices.segmented(frame, Fake).cache()


def test_notices(spark, segments, tmp_path):
    frame, found = segments
    made = notices.ranked(notices.proposals(found, "fake", "1"), top_k=1, scope="subject-category")
    rows = {(r.observation_id, r.category_id): r for r in made.collect()}
    assert len(rows) == 4 and [r.observation_id for r in notices.failures(found, "fake").collect()] == ["bad"]
    assert rows["b", "category:leaf"].selected_for_review and rows["b", "category:leaf"].quality.representative_score == 0.955
    assert rows["a", "category:leaf"].representative_rank == 2 and not rows["a", "category:leaf"].selected_for_review
    import hashlib

    key = "a|u/a|leaf|1|" + repr(((0.2, 0.2), (0.8, 0.2), (0.75, 0.75), (0.25, 0.8)))
    assert rows["a", "category:leaf"].proposal_id == "notice-proposal-" + hashlib.sha256(key.encode()).hexdigest()[:16]
    nested = notices.batch_observations(frame, made)
    assert {r.observation_id: len(r.annotations) for r in nested.collect()} == {"a": 2, "b": 2, "bad": 0}
    summary = notices.batch_summary(frame, made, notices.failures(found, "fake")).first()
    assert tuple(summary) == (3, 4, 2, 1)
    head = notices.batch_head("here", "fake", "1", ["leaf"], "subject-category", "2024-01-01T00:00:00+00:00")
    document = sinks.single_document(nested, "observations", head, "observation_id")
    sinks.write_once(document, str(tmp_path / "batch"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_once(document, str(tmp_path / "batch"))
    back = spark.read.json(str(tmp_path / "batch")).first()
    assert back.schema_version == "arq.notice-proposal-batch/v1" and len(back.observations) == 3
    annotations = nested.select(F.inline("annotations"))
    best = notices.gallery(annotations, top_k=1).collect()
    assert sorted((r.gallery_category_id, r.gallery_rank) for r in best) == [("category:flower", 1), ("category:leaf", 1)]


@pytest.mark.parametrize("call", [lambda m: notices.ranked(m, top_k=0), lambda m: notices.ranked(m, scope="page")])
def test_bad_arguments(spark, segments, call):
    with pytest.raises(ValueError):
        call(notices.proposals(segments[1], "fake", "1"))


def test_sources(spark, tmp_path):
    path = tmp_path / "observations.csv"
    path.write_text('id,image_url,scientific_name,license,observed_on\n1,u1,"Acer ""red""",cc,2024\n2, ,x,,\n  ,u9,x,,\n3,u3, Quercus alba ,,\n4,u4,,,\n')
    frames = readers.read_observation_frames(spark, str(path), limit=2).collect()
    assert [(r.observation_id, r.subject_id, r.license) for r in frames] == [("1", 'Acer "red"', "cc"), ("3", "Quercus alba", None)]
    assert readers.read_observation_frames(spark, str(path)).collect()[2].subject_id == "4"
    with pytest.raises(ValueError):
        readers.read_observation_frames(spark, str(path), limit=0)
    named = readers.read_csv(spark, str(path), "id string, image_url string, scientific_name string, license string, observed_on string")
    assert named.where("observed_on IS NULL").count() == 4
    (tmp_path / ".env").write_text("# no\nA=1\nexport B='2'\nA=3\n")
    assert {r.key: r.value for r in readers.read_settings(spark, str(tmp_path / ".env")).collect()} == {"A": "1", "B": "2"}


def test_photo_manifest(spark, tmp_path):
    (tmp_path / "media" / "o1").mkdir(parents=True)
    (tmp_path / "media" / "o1" / "p.jpg").write_bytes(b"picture")
    media = readers.read_media(spark, str(tmp_path / "media"))
    rows = [("o1", "https://x/p.jpg", 1.0, 2.0, "t", "s"), ("o2", "https://x/p.jpg", None, None, None, None), ("o3", None, None, None, None, None)]
    seen = spark.createDataFrame(rows, "observation_id string, photo_url string, latitude double, longitude double, time_observed_at string, session_id string")
    made = notices.photo_manifest(seen, media, str(tmp_path / "media"))
    assert {r.observation_id: (r.status, r.byte_size) for r in made.collect()} == {"o1": ("ready", 7), "o2": ("missing_media", None), "o3": ("no_photo", None)}
    assert tuple(notices.manifest_summary(made).first()) == (3, 1, 2)
    frame = notices.manifest_frames(made).collect()
    assert [(f.subject_id, f.frame_index) for f in frame] == [("hypothesis:o1", 0)]


def test_null_species_match_and_missing_columns(spark):
    seen = spark.createDataFrame([("1", None, "u"), ("2", "A", "v"), ("3", "B", "w")], "id string, scientific_name string, image_url string")
    paths = spark.createDataFrame([("g", None), ("ga", "A"), ("ga", "A")], "guide_species_name string, species_inat string")
    found = sorted((r.observation_id, r.photo_url, r.taxon_id) for r in keys.observation_sample(seen, paths).collect())
    assert found == [("1", "u", ""), ("2", "v", "")]


def test_step_results_append_and_resume(spark, tmp_path):
    from sylvatica.plans import catalogue

    sample, paths, refs = catalogue._trial_tables(spark, "/root/testdata/sf0.001")
    todo = trials.tasks(sample, ("key_flower_type",), ["m"], limit=7)
    where, schema = str(tmp_path / "results"), __import__("sylvatica.schemas", fromlist=["x"]).STEP_RESULT
    values = trials.feature_values(refs.select("feature", F.col("feature_value").alias("value")))
    for _ in range(2):
        left = trials.remaining(todo, readers.read_results(spark, where, schema), trials.TASK_KEY)
        first = trials.first_phase(trials.with_truth(left, paths, ("key_flower_type",)), trials.model_call(lambda model, parts: "YES"))
        done = trials.second_phase(first, trials.options(refs), values, trials.mock_call)
        sinks.append_results(trials.step_results(trials.scored(done), "t", "now", "mock", "7", "key_flower_type"), where, f"run-{len(left.collect())}")
    rows = readers.read_results(spark, where, schema).collect()
    assert len(rows) == 7 and {r.p2_parsed for r in rows} == {"INCONCLUSIVE"} and all(r.feature_correct and not r.committed for r in rows)
    with pytest.raises(ValueError):
        trials.check_features(["key_subgroup_1"])


def test_command_call():
    assert trials.command_call("cat")("m", [{"kind": "text", "value": "x"}, {"kind": "image", "value": "u"}]) == '{"model": "m", "parts": ["x", {"image": "u"}]}'
    with pytest.raises(RuntimeError):
        trials.command_call("exit 3")("m", [])
    with pytest.raises(ValueError):
        trials.command_call(" ")


def test_gate_without_proposals_is_closed(spark):
    requests = spark.createDataFrame([(1, "leaf", 0.0)], "request_id long, layer string, threshold double")
    none = spark.createDataFrame([], "request_id long, ordinal int, layer string, threshold double, detection_confidence double, mask_quality double")
    made = gate.gate_decisions(gate.gate_proposals(none, ["request_id"]), requests, ["request_id"]).first()
    assert (made.confidence, made.gate_open, made.best_proposal_id, made.proposal_count) == (0.0, False, None, 0)
