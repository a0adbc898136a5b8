"""Registered queries of model runs and their results, of exact numbers, masks, streams, releases and documents."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvatica.functions import floats, payloads, text
from sylvatica.functions.documents import canonical
from sylvatica.operators import calls, notices, regions, trials, workflow
from sylvatica.plans.catalogue import _LABELS_SQL, _POLYGON_SQL, TableSegmenter, query, told_frames
from sylvatica.plans.documents import _PROMPT_LABELS, scratch
from sylvatica.schemas import RELEASE_NAME, RELEASE_TABLES
from sylvatica.session import settled, table
from sylvatica.sources import ranged, readers, sinks
from sylvatica.sources.releases import read_releases
from sylvatica.streaming import telemetry

# --- calls that fail alone -----------------------------------------------------------------------------------

#: Of the turns of all conversations one in SEVENTH fails and one in LATE is late, the first time.
_SEVENTH, _LATE, _LIMIT = 7, 601, 1.0


def _first_answers():
    """A model that fails for some turns, is late for some, and else tells the length of the text."""

    def call(model: str, parts: list[dict[str, str]]) -> str:
        number, text = int(parts[0]["value"]), parts[1]["value"]
        if number % _LATE == 0:
            time.sleep(3 * _LIMIT)
        elif number % _SEVENTH == 0:
            raise LookupError(f"no answer to {number}")
        return f"{model}: {len(text)}"

    return call


def _later_answers():
    return lambda model, parts: f"{model}: {len(parts[1]['value'])}, again"


def _turn_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, the results of the first run, those of the run that asks the failed ones again)."""
    part = lambda value: F.struct(F.lit("text").alias("kind"), value.alias("value"))
    number = F.col("conv_id") * 8 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), number.alias("observation_id"), F.coalesce("role", F.lit("")).alias("feature"),
        F.array(part(number.cast("string")), part(F.coalesce("text", F.lit("")))).alias("parts"),
    )
    ask = lambda make: calls.isolated_call(make, timeout=_LIMIT)(F.col("model"), F.col("parts"))
    first = settled(calls.told_apart(rows, "raw", ask(_first_answers)).drop("parts"))
    left = trials.remaining(rows, calls.succeeded(first), trials.TASK_KEY)
    return rows, first, settled(calls.told_apart(left, "raw", ask(_later_answers)).drop("parts"))


_RUNS_SQL = f"""t AS (SELECT 'm' || (conv_id % 3) AS model, conv_id * 8 + turn AS n, coalesce(role, '') AS feature, length(coalesce(text, '')) AS chars FROM conversations),
    r AS (SELECT *, CASE WHEN n % {_LATE} = 0 THEN 'TimeoutError: no answer within {_LIMIT:g} s' WHEN n % {_SEVENTH} = 0 THEN 'LookupError: no answer to ' || n END AS error FROM t)"""


@query(f"""
    WITH {_RUNS_SQL}
    SELECT model, n AS observation_id, feature, error AS first_error, model || ': ' || chars || CASE WHEN error IS NULL THEN '' ELSE ', again' END AS raw, CASE WHEN error IS NULL THEN 1 ELSE 2 END AS attempts FROM r
""")
def isolated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is asked about; failures and late calls are rows, and a second run asks for those only."""
    _, first, again = _turn_runs(spark, sf_dir)
    done = calls.succeeded(first).select(*trials.TASK_KEY, F.lit(None).cast("string").alias("first_error"), "raw", F.lit(1).alias("attempts"))
    failed = first.where(F.col("error").isNotNull()).select(*trials.TASK_KEY, F.col("error").alias("first_error"))
    repaired = calls.succeeded(again).select(*trials.TASK_KEY, "raw").join(failed, trials.TASK_KEY)
    return done.unionByName(repaired.select(*trials.TASK_KEY, "first_error", "raw", F.lit(2).alias("attempts")))


@query(f"""
    WITH {_RUNS_SQL}
    SELECT 'first' AS run, count(error) AS errors, count(*) AS tasks FROM r UNION ALL SELECT 'again', 0, count(error) FROM r
""")
def call_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls of each run failed."""
    _, first, again = _turn_runs(spark, sf_dir)
    return trials.error_count(first).select(F.lit("first").alias("run"), "*").unionByName(trials.error_count(again).select(F.lit("again").alias("run"), "*"))


# --- exact numbers -------------------------------------------------------------------------------------------


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN ((2 * l_partkey + 1) % 1024) / 128.0::DOUBLE
        WHEN 1 THEN (2 * (l_orderkey % 1000000) + 2000001) / 2000000.0::DOUBLE ELSE ((l_suppkey * 7919 + l_orderkey) % 999983) / 999983.0::DOUBLE + 0.01::DOUBLE END AS x FROM lineitem),
    m AS (SELECT *, (x * 1152921504606846976.0::DOUBLE)::HUGEINT * 1000000 AS t FROM x),
    q AS (SELECT *, t // 1152921504606846976 AS q, t % 1152921504606846976 AS r FROM m)
    SELECT l_orderkey, l_linenumber, (q + CASE WHEN r > 576460752303423488 OR (r = 576460752303423488 AND q % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS millionths FROM q
""")
def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six digits of values that lie halfway in binary, halfway in decimal text only, and anywhere; the SQL
    divides the exact binary values as whole numbers."""
    line, kind = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 3
    value = (
        F.when(kind == 0, ((2 * F.col("l_partkey") + 1) % 1024) / F.lit(128.0))
        .when(kind == 1, (2 * (F.col("l_orderkey") % 1_000_000) + 2_000_001) / F.lit(2_000_000.0))
        .otherwise((F.col("l_suppkey") * 7919 + F.col("l_orderkey")) % 999_983 / F.lit(999_983.0) + 0.01)
    )
    return line.select("l_orderkey", "l_linenumber", F.round(floats.half_even(value, 6) * 1e6).cast("long").alias("millionths"))


@query("""
    SELECT l_orderkey, l_linenumber, (l_extendedprice::DOUBLE / pow(10.0::DOUBLE, 3 * l_linenumber - 2))::VARCHAR AS small, (l_extendedprice::DOUBLE * l_quantity::DOUBLE * pow(10.0::DOUBLE, 2 * l_linenumber))::VARCHAR AS large FROM lineitem
""")
def float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices over and times powers of ten as Python spells doubles."""
    price, line = F.col("l_extendedprice").cast("double"), F.col("l_linenumber")
    small, large = price / F.pow(F.lit(10.0), 3 * line - 2), price * F.col("l_quantity").cast("double") * F.pow(F.lit(10.0), 2 * line)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", floats.told_by_python(small).alias("small"), floats.told_by_python(large).alias("large"))


# --- masks as rows -------------------------------------------------------------------------------------------


@query("""
    WITH RECURSIVE c AS (SELECT vec_id AS m, unnest(range(64)) AS i, unnest(embedding[1:64]) AS v FROM embeddings),
    p AS MATERIALIZED (SELECT m, i::INTEGER AS i, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y FROM c WHERE v > 0.02),
    r(m, o, i, x, y) AS (SELECT m, i, i, x, y FROM p UNION SELECT r.m, r.o, q.i, q.x, q.y FROM r JOIN p AS q ON q.m = r.m AND abs(q.x - r.x) <= 1 AND abs(q.y - r.y) <= 1),
    l AS (SELECT m, i, x, y, min(o) AS region FROM r GROUP BY m, i, x, y),
    g AS (SELECT m, region, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM l GROUP BY m, region)
    SELECT m AS vec_id, area, x0, y0, x1, y1, count(*) OVER (PARTITION BY m) AS regions FROM g QUALIFY row_number() OVER (PARTITION BY m ORDER BY area DESC, region) = 1
""")
def mask_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as masks of 8 x 8 pixels: how many regions, and the largest one's size and box."""
    masks = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v > F.lit(0.02)).alias("cells"), F.lit(8).alias("width"))
    found = regions.largest(regions.region_figures(regions.labelled(regions.runs(masks, "vec_id"))))
    return found.select(F.col("mask").alias("vec_id"), "area", "x0", "y0", "x1", "y1", "regions")


# --- streams and results -------------------------------------------------------------------------------------


@query("""
    SELECT user_id % 20 AS session, event_id, epoch_us(ts) AS stamp, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id DESC) <= 200
""")
def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed from files, some a micro-batch: the last 200 of each session, each with its own stamp."""
    source, out, schema = scratch(spark, "events"), scratch(spark, "telemetry"), "session long, event_id long, stamp long, event_type string, value double"
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("session"), "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', CAST(ts AS TIMESTAMP_NTZ))").alias("stamp"), "event_type", "value")
    events.repartitionByRange(6, "event_id").write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    last = telemetry.last_events(stream, payload=["stamp", "event_type", "value"])

    def write(batch: DataFrame, number: int) -> None:
        sinks.append_results(batch.withColumn("kind", F.lit("last")), out, str(number), "kind")

    start = last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start
    telemetry.started(spark, start).awaitTermination()
    return telemetry.newest_states(readers.read_results(spark, out, f"{schema}, kind string")).drop("kind")


@query("""
    SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE 'old' END AS batch, o_orderstatus AS parsed, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus <> 'O' END AS committed FROM orders
""")
def results_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a run that did not have the column ``committed`` yet and of one that has, read as one; both wrote twice."""
    path, schema = scratch(spark, "schemas"), "task long, parsed string, committed boolean, trial_id string"
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("parsed"), (F.col("o_orderstatus") != "O").alias("committed"), F.concat(F.lit("t"), F.col("o_orderkey") % 4).alias("trial_id"))
    for _ in range(2):
        sinks.append_results(every.where("task % 3 <> 0").drop("committed"), path, "old")
        sinks.append_results(every.where("task % 3 = 0"), path, "late")
    return readers.read_results(spark, path, schema).select("task", "batch", "parsed", "committed")


# --- releases, trees and documents ---------------------------------------------------------------------------

_TABLES = [t for t in RELEASE_TABLES.values() if t not in ("devo_taxa", "devo_taxon_feature_value")]


def _release_files(spark: SparkSession, sf_dir: str) -> str:
    """A release of each group of customers, a file each: taxa and claims; some break a rule."""
    group, name = F.col("c_custkey") % 60, F.lit("plants").alias(RELEASE_NAME)
    taxon = F.struct(name, F.col("c_name").alias("taxon_name"), F.col("c_custkey").cast("string").alias("source_taxon_id"))
    claim = F.struct(name, F.col("c_name").alias("taxon_name"), F.lit("nation").alias("feature_name"), F.col("c_nationkey").cast("string").alias("vocab_id"), F.col("c_mktsegment").alias("assertion_source"), F.lit("c").alias("source_context_id"))
    listed = table(spark, sf_dir, "customer").groupBy(group.alias("g")).agg(F.to_json(F.collect_list(taxon)).alias("taxa"), F.to_json(F.collect_list(claim)).alias("claims"))
    g = F.col("g")
    source = F.concat(F.lit(f'{{"{RELEASE_NAME}": "plants", "version": "7"'), F.when(g % 11 == 3, F.lit("")).otherwise(F.lit(', "content_hash": "x"')), F.lit("}"))
    text = F.concat(
        F.lit('{"manifest": {"contract_version": "1.0", "release_id": "r'), g.cast("string"), F.lit('", "source": '), source, F.lit("}, "), F.lit(", ".join(f'"{t}": []' for t in _TABLES)),
        F.when(g % 10 == 4, F.lit("")).otherwise(F.concat(F.lit(', "devo_taxa": '), F.col("taxa"))),
        F.lit(', "devo_taxon_feature_value": '), F.when(g % 12 == 5, F.lit('{"no": "list"}')).otherwise(F.col("claims")), F.when(g % 13 == 6, F.lit("")).otherwise(F.lit("}")),
    )
    path = scratch(spark, "releases")
    listed.select(g.alias("part"), text.alias("value")).write.partitionBy("part").text(path)  # one row, so one file, a folder
    return path


_RELEASES_SQL = """g AS (SELECT DISTINCT c_custkey % 60 AS g FROM customer),
    v AS (SELECT g, unnest(CASE WHEN g % 13 = 6 THEN [{'rule': 'the document is no JSON', 'subject': 'document'}] ELSE list_filter([
        CASE WHEN g % 11 = 3 THEN {'rule': 'the manifest lacks a field', 'subject': 'source_content_hash'} END, CASE WHEN g % 10 = 4 THEN {'rule': 'a table is missing', 'subject': 'devo_taxa'} END,
        CASE WHEN g % 12 = 5 THEN {'rule': 'a table is no list', 'subject': 'devo_taxon_feature_value'} END], lambda x: x IS NOT NULL) END) AS p FROM g)"""


@query(f"WITH {_RELEASES_SQL} SELECT g, p.rule AS rule, p.subject AS subject FROM v")
def release_files_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with which of many release documents."""
    found = read_releases(spark, _release_files(spark, sf_dir)).violations
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("g"), "rule", "subject")


@query(f"""
    WITH {_RELEASES_SQL} SELECT 'r' || (c_custkey % 60) AS release_id, c_name AS taxon_name, c_nationkey::VARCHAR AS vocab_id, c_custkey::VARCHAR AS source_taxon_id, c_mktsegment AS assertion_source
    FROM customer WHERE c_custkey % 60 NOT IN (SELECT g FROM v)
""")
def release_files_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of all good release documents with their taxa."""
    found = read_releases(spark, _release_files(spark, sf_dir))
    claims, taxa = found.table("claims"), found.table("taxa")
    return claims.join(taxa, ["release_id", RELEASE_NAME, "taxon_name"]).select("release_id", "taxon_name", "vocab_id", "source_taxon_id", "assertion_source")


def _customer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree in which the parent of i is i div 3, but for some: 20 and 60, and 33 alone, are cycles, and 41 hangs on nothing."""
    key = F.col("c_custkey")
    parent = F.when(key == 20, 60).when(key == 33, 33).when(key == 41, -1).when(key > 2, F.floor(key / 3))
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("node_id"), parent.cast("string").alias("parent_id"))


_TREE_SQL = "t AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 20 THEN 60 WHEN c_custkey = 33 THEN 33 WHEN c_custkey = 41 THEN -1 WHEN c_custkey > 2 THEN c_custkey // 3 END AS p FROM customer)"


@query(f"""
    WITH RECURSIVE {_TREE_SQL}, w(id, depth, path) AS (SELECT id, 0, id::VARCHAR FROM t WHERE p IS NULL UNION ALL SELECT t.id, depth + 1, path || '/' || t.id FROM t JOIN w ON t.p = w.id)
    SELECT id::VARCHAR AS node_id, depth, path FROM w
""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from a root to each node, by a recursive query."""
    return workflow.node_paths(_customer_tree(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {_TREE_SQL}, up(id, a) AS (SELECT id, p FROM t UNION SELECT up.id, t.p FROM up JOIN t ON t.id = up.a),
    r AS (SELECT id FROM up GROUP BY id HAVING bool_or(a IS NULL))
    SELECT id::VARCHAR AS node_id, CASE WHEN id IN (SELECT id FROM up WHERE a = id) THEN 'on a cycle' ELSE 'below a cycle or nothing' END AS place FROM t WHERE id NOT IN (SELECT id FROM r)
""")
def tree_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that no root leads to: those on a cycle apart from what hangs below."""
    nodes = _customer_tree(spark, sf_dir)
    loose = settled(workflow.cycle_violations(nodes).select(F.col("subject").alias("node_id")))
    on = workflow.cycle_nodes(nodes, loose).withColumn("on", F.lit(True))
    return loose.join(on, "node_id", "left").select("node_id", F.when(F.col("on"), "on a cycle").otherwise("below a cycle or nothing").alias("place"))


@query(r"""
    WITH l AS (SELECT l_orderkey AS k, string_agg('    {' || chr(10) || '      "number": ' || l_linenumber || ',' || chr(10) || '      "price": ' || l_extendedprice::DOUBLE::VARCHAR || chr(10) || '    }', ',' || chr(10) ORDER BY l_linenumber, l_extendedprice) AS t FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, sha256('{' || chr(10) || '  "key": ' || o_orderkey || ',' || chr(10) || '  "lines": ' || CASE WHEN t IS NULL THEN '[]' ELSE '[' || chr(10) || t || chr(10) || '  ]' END || ',' || chr(10)
           || '  "note": "' || replace(o_orderstatus, '"', '\"') || '\n\u00e9\ud83c\udf3f\\",' || chr(10) || '  "total": ' || o_totalprice::DOUBLE::VARCHAR || chr(10) || '}' || chr(10)) AS document_sha256
    FROM orders LEFT JOIN l ON k = o_orderkey
""")
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its lines as a printed document; the digest of its bytes."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_extendedprice").cast("double").alias("price"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    listed = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    none = F.array().cast("array<struct<number: int, price: double>>")
    whole = listed.select("o_orderkey", F.struct(
        F.concat("o_orderstatus", F.lit("\né\U0001f33f\\")).alias("note"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("double").alias("total"), F.coalesce("lines", none).alias("lines"),
    ).alias("d"))
    return whole.select("o_orderkey", F.sha2(canonical(F.col("d"), whole.schema["d"].dataType), 256).alias("document_sha256"))


# --- a source and a table function ---------------------------------------------------------------------------


@query("""
    SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN NULL ELSE length(coalesce(html, '')) END AS n_chars, CASE WHEN page_id % 9 = 0 THEN 'JSONDecodeError' END AS error FROM pages
""")
def ranged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as lines of JSON, a ninth of them cut short, and read back by ranges of bytes."""
    path, key = scratch(spark, "lines"), F.col("page_id")
    told = F.to_json(F.struct("page_id", "url", F.coalesce("html", F.lit("")).alias("html")))
    cut = F.concat(F.lit('{"page_id": '), key.cast("string"), F.lit(', "url": '), F.to_json(F.struct("url")))
    table(spark, sf_dir, "pages").select(F.when(key % 9 == 0, cut).otherwise(told).alias("value")).write.text(path)
    lines = ranged.read_lines(spark, path, range_bytes=1 << 18)
    page = F.from_json("value", "page_id long, url string, html string")
    whole = lines.where(F.col("error").isNull()).select(page.alias("p")).select("p.page_id", "p.url", F.length("p.html").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("error"))
    bad = lines.where(F.col("error").isNotNull())
    kept = F.regexp_extract("value", r'"page_id": (\d+)', 1).cast("long"), F.from_json(F.regexp_extract("value", r'"url": (.*)$', 1), "url string")["url"]
    return whole.unionByName(bad.select(kept[0].alias("page_id"), kept[1].alias("url"), F.lit(None).cast("long").alias("n_chars"), F.regexp_extract("error", r"^\w+", 0).alias("error")))


@query(f"""
    WITH {_POLYGON_SQL}, k AS (SELECT *, 'category:' || {_LABELS_SQL} AS cat FROM r WHERE valid AND vec_id % 17 <> 0)
    SELECT vec_id::VARCHAR AS observation_id, 0 AS ordinal, cat AS category_id, score, rank() OVER (PARTITION BY cat ORDER BY score DESC) AS score_rank FROM k
""")
def table_function_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From frames to ranked proposals by a table function in SQL, which partitions by observation."""
    notices.register_segmenter(spark, "segments_of_frames", TableSegmenter)
    regions_ = spark.sql("SELECT * FROM segments_of_frames(TABLE({frames}) PARTITION BY observation_id ORDER BY frame_index)", frames=told_frames(spark, sf_dir))
    ordinals = regions_.where(F.col("error_type").isNull()).select("observation_id", "ordinal")
    found = notices.proposals_of(regions_, "table", "1")
    return spark.sql("""
        SELECT p.observation_id, o.ordinal, p.category_id, p.quality.representative_score AS score,
               CAST(rank() OVER (PARTITION BY p.category_id ORDER BY p.quality.representative_score DESC) AS BIGINT) AS score_rank
        FROM {found} AS p JOIN {ordinals} AS o ON o.observation_id = p.observation_id
    """, found=found, ordinals=ordinals)


# --- whole values --------------------------------------------------------------------------------------------


@query("""
    WITH n AS (SELECT DISTINCT (o_orderdate::DATE)::VARCHAR || substr(o_orderpriority, 1, 1) || o_orderstatus AS c, o_custkey::VARCHAR AS t FROM orders)
    SELECT c AS case_id, string_agg(t, ',' ORDER BY t) AS candidate_taxa FROM n GROUP BY c
""")
def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each case, all of them and in order."""
    case = F.concat(F.to_date("o_orderdate").cast("string"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"))
    found = table(spark, sf_dir, "orders").select(case.alias("case_id"), F.col("o_custkey").cast("string").alias("taxon_name")).distinct()
    lineage = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("taxon_name"), F.col("c_mktsegment").alias("genus"))
    return workflow.shared_taxon(found, lineage).select("case_id", F.array_join("candidate_taxa", ",").alias("candidate_taxa"))


@query(f"""
    WITH {_POLYGON_SQL}, k AS (SELECT *, {_PROMPT_LABELS} AS category_label, 'category:' || {_LABELS_SQL} AS cat,
        '(' || array_to_string(list_transform(range(1, 33), lambda i: '(' || x[i] || ', ' || y[i] || ')'), ', ') || ')' AS points FROM r WHERE valid AND vec_id % 17 <> 0),
    d AS (SELECT *, 'notice-proposal-' || substr(sha256(vec_id || '|https://pictures.example/' || vec_id || '|' || category_label || '|0|' || points), 1, 16) AS id FROM k),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY score DESC, id) AS rk FROM d)
    SELECT id AS annotation_id, vec_id::VARCHAR AS observation_id, 'https://pictures.example/' || vec_id AS image_url, x0 AS bbox_x0, y0 AS bbox_y0, x1 AS bbox_x1, y1 AS bbox_y1,
           sha256(array_to_string(list_transform(range(0, 33), lambda i: x[i % 32 + 1] || ' ' || y[i % 32 + 1]), ',')) AS ring_sha256, 'Polygon' AS geometry_type, 33 AS geometry_points, cat AS notice_category_id,
           category_label AS notice_category_label, score AS confidence, 'table' AS model_name, '1' AS model_version, category_label AS prompt, NULL::VARCHAR AS detector_label, det AS detection_confidence,
           mask AS mask_quality, stab AS stability_score, round(ars, 6) AS area_score, round(bs, 6) AS border_score, round(area, 6) AS area_fraction,
           array_to_string(list_filter([CASE WHEN area < 0.01 THEN 'small_region' END, CASE WHEN area > 0.75 THEN 'dominates_frame' END, CASE WHEN border <= 0.005 THEN 'touches_frame_edge' END,
             CASE WHEN det < 0.3 THEN 'low_detection_confidence' END, CASE WHEN mask < 0.5 THEN 'low_mask_quality' END], lambda f: f IS NOT NULL), ',') AS flags,
           'proposed' AS review_state, rk::INTEGER AS representative_rank, rk <= 5 AS selected_for_review, 0 AS frame_index, 's' || (vec_id % 20) AS subject_id FROM ranked
""")
def notice_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every annotation with all of its fields."""
    frames = told_frames(spark, sf_dir)
    found = notices.ranked(notices.proposals(notices.segmented(frames, TableSegmenter), "table", "1"))
    each = found.select(notices.annotation().alias("a")).select("a.*")
    ring = F.array_join(F.transform("polygon", lambda p: F.array_join(F.transform(p, floats.python_text), " ")), ",")
    quality = ("detection_confidence", "mask_quality", "stability_score", "area_score", "border_score", "area_fraction")
    return each.select(
        "annotation_id", "observation_id", "image_url", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", F.sha2(ring, 256).alias("ring_sha256"), F.col("geometry.type").alias("geometry_type"),
        F.size(F.get("geometry.coordinates", F.lit(0))).alias("geometry_points"), "notice_category_id", "notice_category_label", "confidence", F.col("model.name").alias("model_name"),
        F.col("model.version").alias("model_version"), "model.prompt", "model.detector_label", *[f"quality.{c}" for c in quality], F.array_join("quality.flags", ",").alias("flags"), "review_state",
        "representative_rank", "selected_for_review", "frame_index", "subject_id",
    )


@query("SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS sha256, CASE WHEN doc_id % 7 <> 0 THEN octet_length(encode(coalesce(text, '')))::BIGINT END AS n_bytes FROM documents")
def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 with and without the head of a data URL, and what is no base64: the bytes themselves."""
    key, content = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    told = F.when(key % 7 == 0, "data:image/png;base64,no*base64").when(key % 2 == 0, payloads.data_url(F.lit("a.jpg"), content)).otherwise(F.base64(content))
    decoded = table(spark, sf_dir, "documents").select("doc_id", payloads.decode_image(told).alias("b"))
    return decoded.select("doc_id", F.sha2("b", 256).alias("sha256"), F.length("b").cast("long").alias("n_bytes"))


@query("""
    SELECT g, 'sha256:' || sha256(t || chr(10)) AS image_sha256, octet_length(encode(t || chr(10)))::BIGINT AS byte_size FROM (SELECT page_id % 40 AS g, string_agg(coalesce(html, ''), '|' ORDER BY page_id) AS t FROM pages GROUP BY page_id % 40)
""")
def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files of some each, and read as files whose bytes are hashed."""
    path = scratch(spark, "media")
    listed = F.array_sort(F.collect_list(F.struct("page_id", F.coalesce("html", F.lit("")).alias("html"))))
    files = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 40).alias("g")).agg(F.array_join(F.transform(listed, lambda x: x["html"]), "|").alias("value"))
    files.write.partitionBy("g").option("lineSep", "\n").text(path)
    return readers.read_media(spark, path, "*.txt").select(F.regexp_extract("path", r"g=(\d+)/", 1).cast("long").alias("g"), "image_sha256", "byte_size")


@query("""
    WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN ' ' || p_partkey || '  ' WHEN 2 THEN '-' || p_partkey WHEN 3 THEN '+' || p_partkey WHEN 4 THEN p_name ELSE p_partkey || 'x' END AS v FROM part)
    SELECT p_partkey, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN trim(v)::BIGINT END AS number, CASE WHEN NOT regexp_full_match(trim(v), '[+-]?[0-9]+') THEN v END AS words FROM v
""")
def whole_or_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that spell a whole number, with signs and blanks, apart from those that do not."""
    key = F.col("p_partkey")
    told = F.when(key % 6 == 0, key.cast("string")).when(key % 6 == 1, F.concat(F.lit(" "), key, F.lit("  "))).when(key % 6 == 2, F.concat(F.lit("-"), key)).when(key % 6 == 3, F.concat(F.lit("+"), key)).when(key % 6 == 4, F.col("p_name")).otherwise(F.concat(key, F.lit("x")))
    number, words = text.whole_or_text(told)
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), words.alias("words"))
