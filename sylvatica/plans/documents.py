"""Registered queries of prompts, documents, evidence and answers, beside those of ``catalogue``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvatica.functions import answers as A
from sylvatica.functions import payloads as P
from sylvatica.functions import text as X
from sylvatica.operators import gate, keys, notices, releases, trials, workflow
from sylvatica.plans.catalogue import _POLYGON_SQL, ORACLES, _batch, _nation_tree, _orders_release, query, species_path_table
from sylvatica.schemas import RELEASE_NAME
from sylvatica.session import shared_folder, table
from sylvatica.sources import readers, sinks


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/sylvatica/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled_sql(template: str, *values: str) -> str:
    """SQL for a template of a prompt."""
    parts = template.split("{}")
    return " || ".join([_quoted(parts[0]), *[x for v, rest in zip(values, parts[1:], strict=True) for x in (f"({v})", _quoted(rest))]])


# --- prompts -------------------------------------------------------------------------------------------------

_FEATURES = (*A.FEATURE_NAMES, "key_other")
_NAME_SQL = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.FEATURE_NAMES.items()) + " ELSE f END"
_PROMPT_SQL = f"""p AS (SELECT p_partkey, (['{"','".join(_FEATURES)}'])[1 + p_partkey % {len(_FEATURES)}] AS f, CASE WHEN p_partkey % 5 = 0 THEN 'No Apparent leaves' ELSE p_type END AS truth,
      CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_name END AS about, 'u' || p_partkey AS image FROM part),
    q AS (SELECT *, {_NAME_SQL} AS name, CASE WHEN coalesce(about, '') <> '' THEN ' — ' || about ELSE '' END AS dash FROM p)"""


def _asked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key, F.element_at(F.array(*[F.lit(f) for f in _FEATURES]), (key % len(_FEATURES) + 1).cast("int")).alias("feature"),
        F.when(key % 5 == 0, "No Apparent leaves").otherwise(F.col("p_type")).alias("truth"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.col("p_name")).alias("about"), F.concat(F.lit("u"), key).alias("image"),
    )


def _told(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["kind"], F.lit(":"), p["value"])), "\n~")


@query(f"""
    WITH {_PROMPT_SQL}
    SELECT p_partkey, 'image:' || image || chr(10) || '~text:' || {_filled_sql(A.EXISTENCE, 'name', "CASE WHEN f = 'key_leaf_type' AND lower(truth) LIKE '%no apparent%' THEN " + _quoted(A.NO_LEAVES) + " ELSE '' END")} AS existence,
           'image:' || image || chr(10) || '~text:' || {_filled_sql(A.AGREEMENT, 'name', 'truth', 'dash')} AS agreement
    FROM q
""")
def yes_no_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature, truth, about, image = (F.col(c) for c in ("feature", "truth", "about", "image"))
    return _asked_parts(spark, sf_dir).select("p_partkey", _told(A.existence_prompt(feature, image, truth)).alias("existence"), _told(A.agreement_prompt(feature, truth, about, image)).alias("agreement"))


_OPTION_SQL = """chr(10) || '~text:' || chr(10) || '{n}. **' || {value} || '**' || CASE WHEN coalesce({about}, '') <> '' THEN ' — ' || {about} ELSE '' END
      || CASE WHEN {photo} <> '' THEN chr(10) || '~text:Reference photo for option {n}:' || chr(10) || '~image:' || {photo} ELSE '' END
      || CASE WHEN {drawing} <> '' THEN chr(10) || '~text:Botanical illustration for option {n}:' || chr(10) || '~image:' || {drawing} ELSE '' END"""


@query(f"""
    WITH {_PROMPT_SQL}
    SELECT p_partkey, 'image:' || image || chr(10) || '~text:' || {_filled_sql(A.CHOICE, 'name')} || {_OPTION_SQL.format(n=1, value='truth', about='about', photo="''", drawing="CASE WHEN p_partkey % 2 = 0 THEN '/d/' || p_partkey ELSE '' END")}
           || {_OPTION_SQL.format(n=2, value="'other'", about="'x'", photo="'/p/' || p_partkey", drawing="'/e'")}
           || chr(10) || '~text:' || chr(10) || '3. **{A.CANNOT}**' || chr(10) || '~text:' || {_filled_sql(A.CHOICE_END, 'truth')} AS choice
    FROM q
""")
def choice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    option = lambda value, about, photo, drawing: F.struct(value.alias("value"), about.alias("description"), photo.alias("photo"), drawing.alias("illustration"))
    none = F.lit(None).cast("string")
    first = option(F.col("truth"), F.col("about"), none, F.when(key % 2 == 0, F.concat(F.lit("/d/"), key)))
    second = option(F.lit("other"), F.lit("x"), F.concat(F.lit("/p/"), key), F.lit("/e"))
    return _asked_parts(spark, sf_dir).select("p_partkey", _told(A.choice_prompt(F.col("feature"), F.array(first, second), F.col("image"))).alias("choice"))


# --- inputs and their files ----------------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT part.*, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS n FROM part)
    SELECT p_partkey AS id, CASE WHEN n <> '' THEN n || ', "' || p_brand || '"' || chr(10) || 'x' END AS name, CASE WHEN p_size > 25 THEN p_type END AS kind, p_retailprice AS price FROM p
""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas, line breaks, blanks and nulls through a CSV file."""
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, "").when(key % 7 == 0, None).otherwise(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\nx')))
    kind = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit("NA"))
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "part").select(key.alias("id"), name.alias("name"), kind.alias("kind"), F.col("p_retailprice").alias("price")), path)
    return readers.read_csv(spark, path, "id long, name string, kind string, price double")


@query("SELECT '{' || string_agg('\"nation:' || n_name || '\":\"/p/' || n_nationkey || '.png\"', ',' ORDER BY n_name) || '}' AS value, count(*) AS pairs FROM nation")
def illustration_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "nation").select(F.lit("nation").alias("feature"), F.col("n_name").alias("feature_value"), F.concat(F.lit("/p/"), "n_nationkey", F.lit(".png")).alias("reference_illustration_path"))
    pairs = keys.illustration_paths(refs)
    return sinks.map_document(pairs).select("value", F.size(F.from_json("value", "map<string, string>")).cast("long").alias("pairs"))


_PICTURES = sorted(keys.ILLUSTRATIONS.items())
_FILES = sorted({p for _, p in _PICTURES})
_VALUES_SQL = "[" + ", ".join(_quoted(v) for v, _ in _PICTURES) + "]"
_PATHS_SQL = "[" + ", ".join(_quoted("/pictures/" + p) for _, p in _PICTURES) + "]"
_FILES_SQL = "[" + ", ".join(_quoted("/pictures/" + p) for p in _FILES) + "]"


@query(f"""
    WITH p AS (SELECT page_id, url, CASE WHEN page_id % {len(_PICTURES) + 3} < {len(_PICTURES)} THEN {_VALUES_SQL}[1 + page_id % {len(_PICTURES) + 3}] ELSE url END AS v,
        CASE WHEN page_id % {len(_PICTURES) + 3} < {len(_PICTURES)} THEN {_PATHS_SQL}[1 + page_id % {len(_PICTURES) + 3}] END AS path FROM pages),
    f AS (SELECT DISTINCT {_FILES_SQL}[1 + page_id % {len(_FILES)}] AS path FROM pages WHERE page_id % {len(_FILES)} % 2 = 0)
    SELECT v AS feature_value, CASE WHEN path IN (SELECT path FROM f) THEN path ELSE '' END AS path, count(*) AS pages FROM p GROUP BY ALL
""")
def illustration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values told by pages: illustrated ones, of whose pictures some pages hold, and others."""
    pages, key, turn = table(spark, sf_dir, "pages"), F.col("page_id"), F.col("page_id") % (len(_PICTURES) + 3)
    listed = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    pairs = pages.select(F.lit("key_flower_type").alias("feature"), F.coalesce(listed([v for v, _ in _PICTURES], turn), F.col("url")).alias("value"))
    there = pages.where(key % len(_FILES) % 2 == 0).select(listed([f"/pictures/{p}" for p in _FILES], key % len(_FILES)).alias("path"))
    prompts = spark.createDataFrame([("flower_type", "what it is", 0)], "feature_name string, feature_prompt string, ordinal long")
    found = keys.references(pairs, prompts, there, "/pictures/")
    return found.groupBy("feature_value", F.col("reference_illustration_path").alias("path")).agg(F.count(F.lit(1)).alias("pages"))


_ORDER = ("guide_species_name", "species_page", "key_group_number", *keys.PATH_COLUMNS[8:15])


@query(f"""
    WITH t AS ({ORACLES["species_path_table"]})
    SELECT (row_number() OVER (ORDER BY {", ".join(f"{c} NULLS LAST" for c in (*_ORDER, *[c for c in keys.PATH_COLUMNS if c not in _ORDER]))}) - 1)::BIGINT AS index, {", ".join(keys.PATH_COLUMNS)} FROM t
""")
def species_table_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species table in its order, with each row's index."""
    return keys.sorted_paths(species_path_table(spark, sf_dir))


# --- releases, evidence and records --------------------------------------------------------------------------


#: Customers in a part of the release.
_PART = 10_000


def _release_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release document of nations as values and customers as taxa and claims, in parts: (part, value).

    The first part has the small tables too.
    """
    customers = table(spark, sf_dir, "customer")
    parts = max(1, -(-customers.count() // _PART))
    name = F.lit("plants").alias(RELEASE_NAME)
    taxon = F.struct(name, F.col("c_name").alias("taxon_name"), F.col("c_custkey").cast("string").alias("source_taxon_id"))
    claim = F.struct(name, F.col("c_name").alias("taxon_name"), F.lit("nation").alias("feature_name"), F.col("c_nationkey").cast("string").alias("vocab_id"), F.col("c_mktsegment").alias("assertion_source"), F.lit("c").alias("source_context_id"))
    listed = customers.groupBy(F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).alias("part")).agg(F.collect_list(taxon).alias("devo_taxa"), F.collect_list(claim).alias("devo_taxon_feature_value"))
    values = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(name, F.col("n_nationkey").cast("string").alias("vocab_id"), F.lit("nation").alias("feature_name"), F.col("n_name").alias("source_value_id"))).alias("devo_feature_values"))
    source = F.struct(name, F.lit("7").alias("version"), F.lit("sha256:x").alias("content_hash"))
    first = F.col("part") == 0
    fixed = {
        "manifest": F.struct(F.lit("1.0").alias("contract_version"), F.lit("plants-7").alias("release_id"), source.alias("source")),
        "devo_registry": F.filter(F.array(F.struct(name)), lambda _: first), "devo_features": F.filter(F.array(F.struct(name, F.lit("nation").alias("feature_name"))), lambda _: first),
        "devo_images": F.array().cast("array<struct<image_id: string>>"), "devo_annotations": F.array().cast("array<struct<annotation_id: string>>"),
        "devo_feature_values": F.filter("devo_feature_values", lambda _: first),
        **{t: F.coalesce(t, F.array().cast(listed.schema[t].dataType)) for t in ("devo_taxa", "devo_taxon_feature_value")},
    }
    whole = spark.range(parts).select(F.col("id").alias("part")).join(listed, "part", "left").crossJoin(F.broadcast(values))  # one row
    return whole.select("part", F.to_json(F.struct(*[v.alias(k) for k, v in fixed.items()])).alias("value"))


@query("""
    SELECT 'plants' AS vocabulary_name, 'plants-7' AS vocabulary_release_id, c_name AS canonical_taxon_id, n_name AS source_value_id, c_custkey::VARCHAR AS source_taxon_id, c_mktsegment AS assertion_source, '1.0' AS contract_version, 71::INTEGER AS hash_length
    FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def release_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release written as files of some customers each, read, checked and turned into cases."""
    path = scratch(spark, "release")
    _release_parts(spark, sf_dir).write.partitionBy("part").text(path)  # one row, so one file, a folder
    release = readers.read_release(spark, path)
    cases = releases.experiment_cases(releases.validate_release(release))
    told = provenance_of(release)
    return cases.crossJoin(F.broadcast(told)).select(  # one row
        "vocabulary_name", "vocabulary_release_id", "canonical_taxon_id", "source_value_id", "source_taxon_id", "assertion_source", "contract_version", "hash_length",
    )


def provenance_of(release: releases.Release) -> DataFrame:
    made = releases.provenance(release, "t1", "m", "a1", "2024-01-01T00:00:00+00:00")
    return made.select("contract_version", F.length("release_data_hash").alias("hash_length"))


@query("SELECT 't1' AS trial_id, '2024-01-01T00:00:00+00:00' AS started_at, 'm' AS model, 'a1' AS adapter_version, 'sha256:orders' AS release_id, 'h' || count(*) AS release_data_hash, 'orders' AS vocabulary_name, '1.0' AS contract_version FROM orders")
def trial_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    release = _orders_release(spark, sf_dir)
    counted = table(spark, sf_dir, "orders").agg(F.concat(F.lit("h"), F.count(F.lit(1))).alias("data_hash"))
    manifest = release.manifest.crossJoin(counted).withColumn("contract_version", F.lit("1.0"))  # one row each
    whole = releases.Release(manifest, release.registry, release.feature_values, release.taxa, release.claims)
    return releases.provenance(whole, "t1", "m", "a1", "2024-01-01T00:00:00+00:00")


@query("""
    SELECT c_name AS canonical_taxon_id, n_name AS canonical_value_id, o_orderstatus AS assertion_source, o_orderkey::VARCHAR AS source_context_id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = (SELECT min(o_custkey) FROM orders WHERE o_custkey % 10 <> 7)
""")
def taxon_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of one taxon, the first that has any."""
    first = table(spark, sf_dir, "orders").where("o_custkey % 10 <> 7").agg(F.min("o_custkey").alias("c_custkey"))
    name = table(spark, sf_dir, "customer").join(first, "c_custkey").first()["c_name"]
    return releases.cases_for_taxon(_orders_release(spark, sf_dir), name).select("canonical_taxon_id", "canonical_value_id", "assertion_source", "source_context_id")


@query("""
    SELECT 'unknown node' AS rule, (user_id % 40)::VARCHAR AS subject FROM events GROUP BY user_id % 40 HAVING user_id % 40 > 24
    UNION ALL SELECT 'state is confirmed, rejected or unknown', (user_id % 40)::VARCHAR FROM events WHERE event_type = 'error'
""")
def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "maybe").when(F.col("event_type") == "view", "confirmed").otherwise("unknown")
    evidence = table(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("string").alias("node_id"), state.alias("state"))
    return workflow.evidence_violations(evidence, _nation_tree(spark, sf_dir)).select("rule", "subject")


@query("""
    SELECT m AS model, k::VARCHAR AS observation_id, f AS feature, 24::BIGINT AS tasks, 8::BIGINT AS errors FROM (SELECT c_custkey AS k FROM customer ORDER BY c_custkey::VARCHAR LIMIT 4) c,
      (VALUES ('one'), ('two')) AS m(m), (VALUES ('key_flower_type'), ('key_plant_type'), ('key_leaf_type')) AS f(f)
""")
def sampled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of the first four observations (the limit is the feature), and how many of them fail."""
    sample = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("observation_id"), F.col("c_name").alias(keys.SPECIES))
    made = trials.tasks(sample, A.PRIMARY_FEATURES, ["one", "two"], limit=4).select("model", "observation_id", "feature")
    results = made.withColumn("error", F.when(F.col("feature") == "key_leaf_type", "no answer"))
    return made.crossJoin(F.broadcast(trials.error_count(results)))  # one row


# --- notices and the gate ------------------------------------------------------------------------------------


_PROMPT_LABELS = "(['" + "','".join(X.ORGAN_PROMPTS) + "'])[1 + label % 8]"


@query(f"""
    WITH {_POLYGON_SQL}, k AS (SELECT *, '(' || array_to_string(list_transform(range(1, 33), lambda i: '(' || x[i] || ', ' || y[i] || ')'), ', ') || ')' AS points FROM r WHERE valid AND vec_id % 17 <> 0)
    SELECT vec_id::VARCHAR AS observation_id, {_PROMPT_LABELS} AS category_label,
           'notice-proposal-' || substr(sha256(vec_id || '|https://pictures.example/' || vec_id || '|' || {_PROMPT_LABELS} || '|0|' || points), 1, 16) AS proposal_id FROM k
""")
def proposal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proposal with its digest."""
    _, segments = _batch(spark, sf_dir)
    return notices.proposals(segments, "table", "1").select("observation_id", "category_label", "proposal_id")


@query("""
    WITH e AS (SELECT event_id, 'o' || (event_id % 50) AS o, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events),
    f AS (SELECT 'o' || (c_custkey % 45) AS o, arg_max('/p/' || c_custkey || '.jpg', c_custkey) AS p FROM customer GROUP BY c_custkey % 45)
    SELECT event_id AS annotation_id, e.o AS observation_id, p AS local_path, (n % 3)::INTEGER AS place_column, (n // 3)::INTEGER AS place_row FROM e JOIN f ON e.o = f.o
""")
def gallery_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a gallery with the picture that each is drawn on and its place; a tenth of them have none and go."""
    name = lambda key: F.concat(F.lit("o"), key)
    entries = table(spark, sf_dir, "events").select("event_id", name(F.col("event_id") % 50).alias("observation_id"))
    numbered = notices.numbered_by(entries, "event_id", "ordinal")
    frames = table(spark, sf_dir, "customer").select(name(F.col("c_custkey") % 45).alias("observation_id"), F.concat(F.lit("/p/"), "c_custkey", F.lit(".jpg")).alias("local_path"), F.col("c_custkey").alias("frame_index"))
    placed = notices.sheet_entries(numbered, frames, "ordinal")
    return placed.select(F.col("event_id").alias("annotation_id"), "observation_id", "local_path", F.col("place")["column"].cast("int").alias("place_column"), F.col("place")["row"].cast("int").alias("place_row"))


@query("""
    SELECT id AS observation_id, 'hypothesis:' || id AS subject_id, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS frame_index FROM (SELECT 'o' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 ORDER BY id LIMIT 25)
""")
def limited_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 ready rows of a manifest (the limit is the feature), numbered."""
    key, null = F.col("c_custkey"), lambda name: F.lit(None).cast("string").alias(name)
    status = F.when(key % 3 == 0, "ready").otherwise("no_photo")
    manifest = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), key).alias("observation_id"), status.alias("status"), null("image_url"), null("image_sha256"), null("local_path"), null("captured_at"))
    return notices.manifest_frames(manifest, 25).select("observation_id", "subject_id", "frame_index")


@query("""
    WITH r AS (SELECT o_orderkey AS k, (['POST','GET','OPTIONS','POST'])[1 + o_orderkey % 4] AS method, (['/growth-form-gate','/growth-form-gate/telemetry','/other'])[1 + o_orderkey % 3] AS path, o_orderkey % 5 <> 0 AS known,
      CASE WHEN o_orderkey % 7 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS t FROM orders),
    s AS (SELECT *, CASE WHEN method = 'OPTIONS' THEN 204 WHEN path = '/other' OR (method = 'GET' AND path = '/growth-form-gate') THEN 404 WHEN NOT known THEN 401
      WHEN k % 11 = 0 THEN 422 WHEN path = '/growth-form-gate/telemetry' THEN CASE method WHEN 'GET' THEN 200 ELSE 202 END WHEN t > 1 THEN 422 ELSE 200 END AS status FROM r)
    SELECT k AS request_id, status, CASE status WHEN 204 THEN NULL WHEN 404 THEN '{"detail":"not found"}' WHEN 401 THEN '{"detail":"invalid or missing X-API-Key"}'
      WHEN 422 THEN CASE WHEN k % 11 = 0 THEN '{"detail":"the body is no JSON object"}' ELSE '{"detail":"threshold must be between 0 and 1"}' END WHEN 202 THEN '{"accepted":true,"events":2}'
      ELSE CASE WHEN path = '/growth-form-gate' THEN '{"threshold":0.5,"image_bytes":' || length(k::VARCHAR) || '}' ELSE '{"events":["a","b"],"count":2}' END END AS body, CASE WHEN status = 204 THEN 3 ELSE 3 END::INTEGER AS headers
    FROM s
""")
def gate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw requests of every kind, with the status and body that each is answered by."""
    key = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    asked = F.to_json(F.struct(F.when(key % 7 == 0, 1.5).otherwise(0.5).alias("threshold"), F.lit("leaf").alias("prompts"), F.base64(key.cast("string").cast("binary")).alias("image_base64")))
    raw = table(spark, sf_dir, "orders").select(
        key.alias("request_id"), pick(("POST", "GET", "OPTIONS", "POST")).alias("method"), pick((*gate.PATHS, "/other")).alias("path"),
        F.when(key % 5 != 0, "secret").alias("key"), F.when(key % 11 == 0, "no JSON").otherwise(asked).alias("body"),
    )
    checked = gate.checked_requests(gate.received_requests(raw))
    telemetry = F.col("path") == gate.PATHS[1]
    detail = F.when(F.col("malformed"), "the body is no JSON object").when(~telemetry, F.col("detail"))
    status = gate.response_status(F.col("path"), F.col("method"), gate.authorise(F.col("key"), "secret"), detail)
    decision = F.when(~telemetry, F.struct(F.col("threshold"), F.octet_length("image").alias("image_bytes")))
    body = gate.response_body(F.col("status"), F.col("told"), decision, F.array(F.lit("a"), F.lit("b")))
    answered = checked.withColumn("told", detail).withColumn("status", status).withColumn("answer", body)
    return answered.select("request_id", "status", F.col("answer").alias("body"), F.size(gate.response_headers(F.col("status"), F.col("answer"))).alias("headers"))


# --- results and documents that are written ------------------------------------------------------------------


@query("SELECT o_orderkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS trial_id, o_orderstatus AS parsed, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS left_before FROM orders")
def results_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the tasks is done and written; the rest is found, done and written twice, which puts it there once."""
    path, schema = scratch(spark, "results"), "task long, parsed string, trial_id string"
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("parsed"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("trial_id"))
    left = trials.remaining(every, readers.read_results(spark, path, schema), ["task"])
    sinks.append_results(left.where("task % 3 = 0"), path, "first")
    done = readers.results_of(readers.read_results(spark, path, schema).where("batch = 'first'"), every)
    rest = trials.remaining(every, done, ["task"])
    counted = spark.range(1).select(F.lit(rest.count()).cast("long").alias("left_before"))
    for _ in range(2):  # as a job does that is started again
        sinks.append_results(rest, path, "second")
    return readers.read_results(spark, path, schema).crossJoin(F.broadcast(counted)).select("task", "trial_id", "parsed", "left_before")  # one row


@query("SELECT 'nations' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lines of no order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def input_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lost = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_anti")
    return keys.summary(**{"nations": table(spark, sf_dir, "nation"), "orders": orders, "lines of no order": lost})


@query("""
    SELECT page_id, 'data:' || CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/webp' ELSE 'image/png' END || ';base64,' || to_base64(encode(coalesce(html, ''))) AS picture FROM pages
""")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in ("a.JPG", "b.webp", "c.unknown", "d.png")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", P.data_url(name, F.coalesce("html", F.lit("")).cast("binary")).alias("picture"))


@query("SELECT 'v1' AS schema_version, 'nations' AS source, n_nationkey::BIGINT AS key, n_name AS name, (SELECT count(*) FROM nation) AS listed FROM nation")
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows gathered in one JSON document, written once, read back and taken apart."""
    path = scratch(spark, "document")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    sinks.write_once(sinks.single_document(rows, "entries", {"schema_version": "v1", "source": "nations"}, "key"), path)
    read = readers.read_document(spark, path, "entries array<struct<key: long, name: string>>, schema_version string, source string")
    return read.select("schema_version", "source", F.size("entries").cast("long").alias("listed"), F.inline("entries"))
