"""The registered queries of the core library and the SQL that each is held against.

The driver's star schema stands in for the domain: events are scored proposals, part and lineitem the key's
routes and species, orders the claims of a release, nation a workflow tree, conversations and documents the
answers of models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvatica.functions import answers as A
from sylvatica.functions import geometry as G
from sylvatica.functions import payloads as P
from sylvatica.functions import text as X
from sylvatica.operators import frames, gate, keys, notices, ranking, releases, trials, workflow
from sylvatica.session import table
from sylvatica.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where SQL can express it."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


# --- ranking -------------------------------------------------------------------------------------------------


@query("""
    SELECT event_type, event_id, value, rk::INTEGER AS rank, rk <= 5 AS selected FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS rk FROM events)
""")
def topk_rank_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank_within(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id", top_k=5)
    return ranked.select("event_type", "event_id", "value", "rank", "selected")


@query("""
    SELECT event_type, event_id, value, rk::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rk FROM events) WHERE rk <= 5
""")
def topk_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_within(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id", top_k=5).select("event_type", "event_id", "value", "rank")


@query("""
    SELECT user_id, event_type, event_id, value, rk::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rk FROM events) WHERE rk <= 3
""")
def topk_subject_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ranking.scope_keys("subject-category", {"subject_id": "user_id", "category_id": "event_type"})
    return ranking.best_within(table(spark, sf_dir, "events"), by, "value", "event_id", top_k=3).select("user_id", "event_type", "event_id", "value", "rank")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def telemetry_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_n(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("""
    SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS ordinal,
           ((row_number() OVER (ORDER BY vec_id) - 1) % 3)::INTEGER AS sheet_column, ((row_number() OVER (ORDER BY vec_id) - 1) // 3)::INTEGER AS sheet_row FROM embeddings
""")
def sheet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = notices.numbered_by(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", "ordinal")
    place = G.grid_place(F.col("ordinal"))
    return numbered.select("vec_id", "ordinal", place["column"].alias("sheet_column"), place["row"].alias("sheet_row"))


# --- identification key --------------------------------------------------------------------------------------

_PART_FEATURES = {"Brand#11": "flower_type", "Brand#12": "plant_type", "Brand#13": "leaf_type", "Brand#21": "subgroup_1", "Brand#22": "subgroup_2"}
_MAP_SQL = "(VALUES ('Brand#11','flower_type'),('Brand#12','plant_type'),('Brand#13','leaf_type'),('Brand#21','subgroup_1'),('Brand#22','subgroup_2'))"


@query(f"""
    SELECT DISTINCT m.f AS feature, p_type AS value FROM part JOIN {_MAP_SQL} AS m(b, f) ON p_brand = m.b
    WHERE p_type IS NOT NULL AND p_type <> ''
""")
def vocab_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature_name"), F.col("p_type").alias("feature_value"))
    return keys.feature_value_pairs(steps, _PART_FEATURES)


_EVENT_TYPES = ("view", "click", "purchase", "signup", "error", "cart")


@query("""
    SELECT user_id AS route_id, """ + ", ".join(f"arg_min(props, event_id) FILTER (event_type = '{t}') AS key_{t}" for t in _EVENT_TYPES) + """
    FROM events WHERE event_type IN (""" + ", ".join(f"'{t}'" for t in _EVENT_TYPES) + """) AND props IS NOT NULL GROUP BY user_id
""")
def route_pivot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("route_id"), F.col("event_id").alias("path_k"), F.col("event_type").alias("feature_name"), F.col("props").alias("feature_value"))
    return keys.route_features(steps, {t: f"key_{t}" for t in _EVENT_TYPES})


@query("""
    WITH p AS (SELECT part.*, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
    f AS (SELECT p_size AS route_id, """ + ", ".join(f"arg_min(p_type, p_partkey) FILTER (p_brand = '{b}') AS key_{f}" for b, f in _PART_FEATURES.items()) + """, NULL AS key_subgroup_3
          FROM part WHERE p_brand IN (""" + ", ".join(f"'{b}'" for b in _PART_FEATURES) + """) GROUP BY p_size)
    SELECT s_name AS guide_species_name, s_name AS species_inat, 's' || s_suppkey AS subspecies_inat, s_name AS suggested_species_id, l_linenumber AS species_page,
           r.route_id AS key_page_range_start, r.route_id + 1 AS key_page_range_end, 'g' || (r.route_id % 5) AS key_group_number,
           key_flower_type, key_plant_type, key_leaf_type, key_subgroup_1, key_subgroup_2, key_subgroup_3::VARCHAR AS key_subgroup_3, 'route ' || r.route_id AS key_description,
           'link' AS species_inat_link, '' AS subspecies_inat_link, (l_returnflag = 'R')::DOUBLE AS warning_species_extraction, (l_linestatus = 'F')::DOUBLE AS warning_key_extraction
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT DISTINCT p_size AS route_id FROM part) r ON r.route_id = l_partkey % 50
    LEFT JOIN f ON f.route_id = r.route_id
""")
def species_path_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, lines = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    taxa = supplier.select(F.col("s_suppkey").alias("taxon_id"), F.col("s_name").alias("scientific_name"), F.col("s_name").alias("canonical_name"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("subspecies_inat"), F.lit("link").alias("species_inat_link"))
    through = lines.select(
        F.col("l_suppkey").alias("taxon_id"), (F.col("l_partkey") % 50).cast("int").alias("route_id"), F.col("l_linenumber").alias("species_page"),
        (F.col("l_returnflag") == "R").alias("warning_species_extraction"), (F.col("l_linestatus") == "F").alias("warning_key_extraction"),
    )
    routes = part.select(F.col("p_size").alias("route_id")).distinct().select(
        "route_id", F.col("route_id").alias("key_page_range_start"), (F.col("route_id") + 1).alias("key_page_range_end"), F.concat(F.lit("g"), F.col("route_id") % 5).alias("key_group_number"),
        F.concat(F.lit("route "), F.col("route_id")).alias("key_description"),
    )
    named = keys.mapped(F.col("p_brand"), _PART_FEATURES)
    steps = part.select(F.col("p_size").alias("route_id"), F.col("p_partkey").alias("path_k"), named.alias("feature_name"), F.col("p_type").alias("feature_value")).where(F.col("feature_name").isNotNull())
    return keys.species_paths(taxa, through, routes, steps)


@query("""
    SELECT DISTINCT 'guide ' || coalesce(s.species::VARCHAR, 'none') AS guide_species_name, s.species::VARCHAR AS species_inat, '' AS taxon_id, o.event_id AS observation_id, '' AS photo_id, o.props AS photo_url
    FROM (SELECT *, nullif(user_id, 3) AS species FROM events) o JOIN (SELECT DISTINCT nullif(c_custkey, 3) AS species FROM customer) s
      ON o.species IS NOT DISTINCT FROM s.species
""")
def obs_species_nullsafe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, customers = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    seen = events.select(F.col("event_id").alias("id"), F.expr("nullif(user_id, 3)").cast("string").alias("scientific_name"), F.col("props").alias("image_url"))
    species = F.expr("nullif(c_custkey, 3)").cast("string")
    paths = customers.select(F.concat(F.lit("guide "), F.coalesce(species, F.lit("none"))).alias(keys.SPECIES), species.alias("species_inat"))
    return keys.observation_sample(seen, paths)


@query(f"""
    WITH p AS (SELECT DISTINCT m.f AS feature, p_type AS value FROM part JOIN {_MAP_SQL} AS m(b, f) ON p_brand = m.b),
    c AS (SELECT m.f AS feature, arg_max(p_name, p_partkey) AS prompt FROM part JOIN {_MAP_SQL} AS m(b, f) ON p_brand = m.b GROUP BY m.f)
    SELECT p.value AS feature_value, '' AS reference_image_link, '' AS reference_illustration_path, coalesce(c.prompt, '') AS reference_description, p.feature,
           p.feature || ':' || p.value AS path_key FROM p LEFT JOIN c ON c.feature = p.feature
""")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pairs = keys.feature_value_pairs(part.select(F.col("p_brand").alias("feature_name"), F.col("p_type").alias("feature_value")), _PART_FEATURES)
    concepts = part.select(F.col("p_brand").alias("feature_name"), F.col("p_name").alias("feature_prompt"), F.col("p_partkey").alias("ordinal"))
    pictures = part.select(F.col("p_name").alias("path"))
    refs = keys.references(pairs, concepts, pictures, "/pictures", _PART_FEATURES)
    return refs.withColumn("path_key", X.composite_key(F.col("feature"), F.col("feature_value")))


@query("""
    SELECT p_partkey, u.name AS feature, u.value AS true_value FROM
      (UNPIVOT (SELECT p_partkey, p_brand, p_type, p_name FROM part) ON p_brand, p_type, p_name INTO NAME name VALUE value) u
    JOIN (SELECT DISTINCT p_type AS v FROM part UNION SELECT DISTINCT p_brand FROM part) v ON u.value = v.v
""")
def species_tags_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    long = part.unpivot(["p_partkey"], ["p_brand", "p_type", "p_name"], "feature", "true_value")
    vocabulary = part.select(F.col("p_type").alias("true_value")).union(part.select("p_brand")).distinct()
    return long.join(vocabulary, "true_value").select("p_partkey", "feature", "true_value")


# --- releases ------------------------------------------------------------------------------------------------


def _orders_release(spark: SparkSession, sf_dir: str) -> releases.Release:
    customer, nation, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    manifest = spark.range(1).select(F.lit("sha256:orders").alias("release_id"), F.lit("orders").alias("vocabulary_name"))
    registry = spark.range(2).select(F.when(F.col("id") == 0, "orders").otherwise("others").alias("devo_name"))
    taxa = customer.where("c_custkey % 10 <> 7").select(F.col("c_name").alias("taxon_name"), F.col("c_custkey").cast("string").alias("source_taxon_id"))
    values = nation.select(F.col("n_name").alias("vocab_id"), F.lit("nation").alias("feature_name"), F.col("n_nationkey").cast("string").alias("source_value_id"))
    claims = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.when(F.col("o_orderkey") % 100 == 1, "others").otherwise("orders").alias("devo_name"), F.col("c_name").alias("taxon_name"),
        F.when(F.col("o_orderkey") % 100 == 3, "continent").otherwise("nation").alias("feature_name"), F.col("n_name").alias("vocab_id"),
        F.col("o_orderstatus").alias("assertion_source"), F.col("o_orderkey").cast("string").alias("source_context_id"),
    )
    return releases.Release(manifest, registry, values, taxa, claims)


_CLAIMS_SQL = """c AS (SELECT CASE WHEN o_orderkey % 100 = 1 THEN 'others' ELSE 'orders' END AS devo, c_custkey, c_name AS taxon,
      CASE WHEN o_orderkey % 100 = 3 THEN 'continent' ELSE 'nation' END AS feature, n_name AS vocab, n_nationkey, o_orderstatus, o_orderkey
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""
    WITH {_CLAIMS_SQL}
    SELECT 'orders' AS vocabulary_name, 'sha256:orders' AS vocabulary_release_id, taxon AS canonical_taxon_id, feature AS canonical_feature_id, vocab AS canonical_value_id,
           c_custkey::VARCHAR AS source_taxon_id, n_nationkey::VARCHAR AS source_value_id, o_orderstatus AS assertion_source, o_orderkey::VARCHAR AS source_context_id
    FROM c WHERE c_custkey % 10 <> 7
""")
def experiment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.experiment_cases(_orders_release(spark, sf_dir))


@query(f"""
    WITH {_CLAIMS_SQL},
    v AS (SELECT 'registry is not the manifest''s vocabulary' AS rule, 'orders,others' AS subject
      UNION ALL SELECT 'claim of another vocabulary', taxon FROM c WHERE devo <> 'orders'
      UNION ALL SELECT CASE WHEN c_custkey % 10 = 7 THEN 'unknown taxon' ELSE 'feature is not its value''s' END, taxon FROM c WHERE c_custkey % 10 = 7 OR feature <> 'nation')
    SELECT rule, subject, count(*) AS claims FROM v GROUP BY rule, subject
""")
def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = releases.release_violations(_orders_release(spark, sf_dir))
    return found.groupBy("rule", "subject").agg(F.count(F.lit(1)).alias("claims"))


@query("""
    SELECT CASE WHEN coalesce(s, '') = '' THEN 'segment row is missing s' ELSE 'duplicate segment ID' END AS rule, s AS subject, count(*) AS rows
    FROM (SELECT CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_mktsegment || (c_custkey % 40) END AS s FROM customer) GROUP BY s HAVING coalesce(s, '') = '' OR count(*) > 1
""")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")))
    return frames.key_violations(table(spark, sf_dir, "customer").select(key.alias("s")), "s", "segment")


def _outcome() -> Column:
    return F.when(F.col("toxic") == 1, "abstained").when(F.col("doc_id") % 11 == 0, "invalid").otherwise("classified")


@query("""
    WITH r AS (SELECT *, CASE WHEN toxic = 1 THEN 'abstained' WHEN doc_id % 11 = 0 THEN 'invalid' ELSE 'classified' END AS o FROM labels)
    SELECT count(*) AS total_records, count(*) FILTER (o = 'classified') AS classified_records, count(*) FILTER (o = 'abstained') AS abstained_records,
           count(*) FILTER (o = 'invalid') AS invalid_records, count(*) FILTER (o = 'classified' AND quality = doc_id % 2) AS correct_classifications,
           count(*) FILTER (o = 'classified' AND quality = doc_id % 2) / nullif(count(*) FILTER (o = 'classified'), 0)::DOUBLE AS classification_accuracy,
           count(*) FILTER (o = 'classified') / nullif(count(*), 0)::DOUBLE AS classification_coverage FROM r
""")
def trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.classification_metrics(table(spark, sf_dir, "labels"), _outcome(), F.col("doc_id") % 2, F.col("quality"))


@query("""
    SELECT rule, subject FROM (
      SELECT doc_id::VARCHAR AS subject, unnest([CASE WHEN doc_id % 7 = 0 THEN 'release of the case is the trial''s' END,
        CASE WHEN toxic = 0 AND doc_id % 5 = 0 THEN 'a classification has a prediction' END,
        CASE WHEN toxic = 1 AND doc_id % 5 <> 0 THEN 'only a classification has a prediction' END]) AS rule FROM labels) WHERE rule IS NOT NULL
""")
def trial_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("trial_id"), F.lit("r").alias("release_id"), F.when(F.col("doc_id") % 7 == 0, "other").otherwise("r").alias("case_release_id"),
        F.lit("v").alias("vocabulary_name"), F.lit("v").alias("case_vocabulary_name"), F.when(F.col("toxic") == 1, "abstained").otherwise("classified").alias("parsed_outcome"),
        F.when(F.col("doc_id") % 5 != 0, "x").alias("predicted_value_id"),
    )
    return releases.record_violations(records)


# --- workflow and recommendation -----------------------------------------------------------------------------


def _order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of two releases: the priorities of a customer's orders, by the first and second half of the year."""
    half = F.when(F.month("o_orderdate") <= 6, "spring").otherwise("autumn")
    return table(spark, sf_dir, "orders").select(half.alias("release_id"), F.col("o_custkey").cast("string").alias("taxon_name"), F.lit("status").alias("feature_name"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("vocab_id"))


#: (case, release, value) of what is asked for.
_ASKED = (
    ("a", "spring", "F 1-URGENT"), ("a", "spring", "O 2-HIGH"), ("b", "spring", "F 1-URGENT"), ("b", "autumn", "O 3-MEDIUM"), ("c", "autumn", "no such value"),
    ("a", "spring", "F 1-URGENT"), ("d", "spring", "F 5-LOW"), ("d", "spring", "O 1-URGENT"), ("d", "autumn", "F 2-HIGH"), ("d", "autumn", "O 2-HIGH"), ("d", "autumn", "P 1-URGENT"),
)
_ASKED_SQL = "(VALUES " + ", ".join(f"('{c}','{r}','{v}')" for c, r, v in _ASKED) + ")"


def _asked(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{c}', '{r}', '{v}')" for c, r, v in _ASKED)
    return spark.sql(f"SELECT case_id, release_id, 'status' AS feature_id, value_id FROM VALUES {rows} AS t(case_id, release_id, value_id)")


_DIVISION_SQL = f"""
    cl AS (SELECT DISTINCT CASE WHEN month(o_orderdate) <= 6 THEN 'spring' ELSE 'autumn' END AS r, o_custkey::VARCHAR AS t, o_orderstatus || ' ' || o_orderpriority AS v FROM orders),
    a AS (SELECT DISTINCT * FROM {_ASKED_SQL} AS x(c, r, v)),
    d AS (SELECT a.c, a.r, cl.t FROM a JOIN cl ON a.r = cl.r AND a.v = cl.v GROUP BY a.c, a.r, cl.t HAVING count(*) = (SELECT count(*) FROM a AS y WHERE y.c = a.c AND y.r = a.r)),
    n AS (SELECT c, t FROM d GROUP BY c, t HAVING count(*) = (SELECT count(DISTINCT r) FROM a AS y WHERE y.c = d.c))"""


@query(f"WITH {_DIVISION_SQL} SELECT c AS case_id, t AS taxon_name FROM n")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.candidates(_order_claims(spark, sf_dir), _asked(spark))


@query("""
    SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
""")
def release_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(orders.where("o_orderstatus = 'O'").select("o_custkey"))


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("c_custkey").cast("string").alias("taxon_name"), F.lit("Plantae").alias("kingdom"), F.col("r_name").alias("family"), F.col("n_name").alias("genus"), F.expr("c_custkey % 3").alias("__third"),
    )


_LCA_SQL = """
    g AS (SELECT c, count(*) AS k, min(t) AS one, min(n_name) AS g1, max(n_name) AS g2, min(r_name) AS f1, max(r_name) AS f2, count(n_name) AS kn
          FROM n LEFT JOIN customer ON c_custkey::VARCHAR = t LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY c)
    SELECT c AS case_id, CASE WHEN k = 1 THEN one WHEN kn = k AND g1 = g2 THEN g1 WHEN kn = k AND f1 = f2 THEN f1 WHEN kn = k THEN 'Plantae' END AS shared_taxon,
           CASE WHEN k = 1 THEN 'species' WHEN kn = k AND g1 = g2 THEN 'genus' WHEN kn = k AND f1 = f2 THEN 'family' WHEN kn = k THEN 'kingdom' END AS taxon_rank,
           k::INTEGER AS n_candidates, CASE WHEN k = 1 THEN 'recommended' ELSE 'ambiguous' END AS status FROM g"""


@query("WITH n AS (SELECT (o_orderdate::DATE)::VARCHAR || substr(o_orderpriority, 1, 1) || o_orderstatus AS c, o_custkey::VARCHAR AS t FROM orders GROUP BY ALL), " + _LCA_SQL)
def shared_rank_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.concat(F.to_date("o_orderdate").cast("string"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"))
    found = table(spark, sf_dir, "orders").select(case.alias("case_id"), F.col("o_custkey").cast("string").alias("taxon_name")).distinct()
    named = workflow.shared_taxon(found, _lineage(spark, sf_dir))
    return named.select("case_id", "shared_taxon", "taxon_rank", F.size("candidate_taxa").alias("n_candidates"), "status")


@query(f"""
    WITH {_DIVISION_SQL}, {_LCA_SQL.replace("SELECT c AS case_id", ", l AS (SELECT c AS case_id", 1)})
    SELECT x.c AS case_id, l.shared_taxon, l.taxon_rank, coalesce(l.n_candidates, 0) AS n_candidates,
           (SELECT count(DISTINCT r) FROM a WHERE a.c = x.c)::INTEGER AS n_releases,
           CASE WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.c = x.c) THEN 'no_evidence' ELSE coalesce(l.status, 'no_match') END AS status
    FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) AS x(c) LEFT JOIN l ON l.case_id = x.c
""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.sql("SELECT case_id FROM VALUES ('a'), ('b'), ('c'), ('d'), ('e') AS t(case_id)")
    found = workflow.recommend(cases, _order_claims(spark, sf_dir), _asked(spark), _lineage(spark, sf_dir))
    return found.select("case_id", "shared_taxon", "taxon_rank", F.size("candidate_taxa").alias("n_candidates"), F.size("release_ids").alias("n_releases"), "status")


def _nation_tree(spark: SparkSession, sf_dir: str, loop: bool = False) -> DataFrame:
    """Nations as a heap: the parent of i is i div 2.  With ``loop``, 20 and 10 are each other's parent."""
    key = F.col("n_nationkey")
    parent = F.when(key > 0, F.floor(key / 2))
    if loop:
        parent = F.when(key == 10, 20).otherwise(parent)
    return table(spark, sf_dir, "nation").select(key.cast("string").alias("node_id"), F.col("n_name").alias("label"), parent.cast("string").alias("parent_id"))


@query("""
    WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS t, (user_id % 500)::VARCHAR AS c, (value * 100)::BIGINT % 25 AS k, max(event_id) AS m FROM events GROUP BY user_id, (value * 100)::BIGINT % 25),
    e AS (SELECT c, k::VARCHAR AS node, arg_max(CASE WHEN t IN ('view', 'purchase', 'click') THEN 'confirmed' WHEN t = 'error' THEN 'rejected' ELSE 'unknown' END, m) AS state FROM s GROUP BY c, k),
    n AS (SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey > 0 THEN (n_nationkey // 2)::VARCHAR END AS p FROM nation),
    x AS (SELECT DISTINCT c FROM e)
    SELECT x.c AS case_id, n.id AS node_id FROM x CROSS JOIN n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.c = x.c AND e.node = n.id)
      AND (n.p IS NULL OR EXISTS (SELECT 1 FROM e WHERE e.c = x.c AND e.node = n.p AND e.state = 'confirmed'))
""")
def workflow_next_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("t").isin("view", "purchase", "click"), "confirmed").when(F.col("t") == "error", "rejected").otherwise("unknown")
    spread = F.expr("cast(round(value * 100) as bigint) % 25")
    seen = table(spark, sf_dir, "events").groupBy("user_id", spread.alias("k")).agg(F.max_by("event_type", "event_id").alias("t"), F.max("event_id").alias("ordinal"))
    evidence = seen.select((F.col("user_id") % 500).cast("string").alias("case_id"), F.col("k").cast("string").alias("node_id"), state.alias("state"), "ordinal")
    return workflow.next_tasks(_nation_tree(spark, sf_dir), evidence, case="case_id").select("case_id", "node_id")


@query("""
    WITH RECURSIVE w(id, depth) AS (SELECT 0, 0 UNION ALL SELECT n_nationkey, depth + 1 FROM nation JOIN w ON n_nationkey > 0 AND n_nationkey // 2 = w.id)
    SELECT id::VARCHAR AS node_id, depth FROM w
""")
def workflow_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.depths(_nation_tree(spark, sf_dir))


@query("""
    WITH RECURSIVE p AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 10 THEN 20 WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS p FROM nation),
    w(id) AS (SELECT 0 UNION SELECT p.id FROM p JOIN w ON p.p = w.id)
    SELECT 'on a cycle or below one' AS rule, id::VARCHAR AS subject FROM p WHERE id NOT IN (SELECT id FROM w)
""")
def workflow_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.cycle_violations(_nation_tree(spark, sf_dir, loop=True))


@query("""
    WITH n AS (SELECT n_nationkey::VARCHAR AS id, CASE n_nationkey % 4 WHEN 0 THEN 'taxon' WHEN 1 THEN 'notice' WHEN 2 THEN 'feature' ELSE 'thing' END AS kind,
      CASE WHEN n_nationkey % 8 = 0 THEN 'genus' END AS rank, CASE WHEN n_nationkey % 3 = 0 THEN 'f' END AS src, CASE WHEN n_nationkey > 20 THEN 'x' || n_nationkey END AS p FROM nation)
    SELECT rule, subject FROM (SELECT id AS subject, unnest([CASE WHEN kind = 'thing' THEN 'kind is taxon, notice or feature' END, CASE WHEN kind = 'taxon' AND rank IS NULL THEN 'a taxon has a rank' END,
      CASE WHEN kind = 'feature' AND src IS NULL THEN 'a feature has a source feature' END, CASE WHEN kind <> 'feature' AND src IS NOT NULL THEN 'only a feature has a source feature' END]) AS rule FROM n
      UNION ALL SELECT p, 'parent does not exist' FROM n WHERE p IS NOT NULL) WHERE rule IS NOT NULL
""")
def workflow_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    kind = F.when(key % 4 == 0, "taxon").when(key % 4 == 1, "notice").when(key % 4 == 2, "feature").otherwise("thing")
    nodes = table(spark, sf_dir, "nation").select(
        key.cast("string").alias("node_id"), kind.alias("kind"), F.when(key % 8 == 0, "genus").alias("taxon_rank"), F.when(key % 3 == 0, "f").alias("source_feature_id"),
        F.when(key > 20, F.concat(F.lit("x"), key)).alias("parent_id"),
    )
    return workflow.node_violations(nodes)


@query("""
    WITH e AS (SELECT doc_id::VARCHAR AS value_id, CASE WHEN doc_id % 9 = 0 THEN 'proposed' ELSE 'confirmed' END AS review, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality * 1.5::DOUBLE END AS conf,
        CASE WHEN doc_id % 13 = 0 THEN 'gone' ELSE 'r' END AS rel, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS feature FROM labels),
    v AS (SELECT doc_id::VARCHAR AS v, 'clean' AS f FROM documents WHERE doc_id % 6 <> 0)
    SELECT rule, subject FROM (
      SELECT unnest([CASE WHEN review <> 'confirmed' THEN 'evidence is confirmed' END, CASE WHEN conf > 1 THEN 'confidence is in 0..1' END]) AS rule, value_id AS subject FROM e
      UNION ALL SELECT 'unknown release', rel FROM e WHERE rel = 'gone'
      UNION ALL SELECT CASE WHEN v.v IS NULL THEN 'unknown value' WHEN v.f <> e.feature THEN 'value of another feature' END, value_id FROM e LEFT JOIN v ON v.v = e.value_id WHERE rel = 'r') WHERE rule IS NOT NULL
""")
def feature_evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("value_id"), F.when(F.col("doc_id") % 9 == 0, "proposed").otherwise("confirmed").alias("review_state"),
        F.when(F.col("doc_id") % 4 != 0, F.col("quality") * 1.5).alias("confidence"), F.when(F.col("doc_id") % 13 == 0, "gone").otherwise("r").alias("release_id"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("feature_id"),
    )
    values = table(spark, sf_dir, "documents").where("doc_id % 6 <> 0").select(F.lit("r").alias("release_id"), F.col("doc_id").cast("string").alias("vocab_id"), F.lit("clean").alias("feature_name"))
    return workflow.feature_evidence_violations(evidence, values)


# --- regions -------------------------------------------------------------------------------------------------


def _polygon(spark: SparkSession, sf_dir: str, low: float = -0.4, high: float = 0.4) -> DataFrame:
    """Embeddings as polygons of 32 points, scaled so that most lie in the frame; their scores from the id."""
    at = lambda i: (F.element_at("embedding", i).cast("double") - low) / (high - low)
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i + 1).alias("x"), at(2 * i + 2).alias("y")))
    share = lambda n: (F.col("vec_id") % n) / F.lit(float(n - 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", points.alias("polygon"), share(11).alias("detection"), share(7).alias("mask"), share(5).alias("stability"))


_POLYGON_SQL = """
    p AS (SELECT vec_id, label, [(embedding[i]::DOUBLE + 0.4::DOUBLE) / 0.8::DOUBLE FOR i IN range(1, 64, 2)] AS x, [(embedding[i]::DOUBLE + 0.4::DOUBLE) / 0.8::DOUBLE FOR i IN range(2, 65, 2)] AS y,
          (vec_id % 11) / 10.0::DOUBLE AS det, (vec_id % 7) / 6.0::DOUBLE AS mask, (vec_id % 5) / 4.0::DOUBLE AS stab FROM embeddings),
    a AS (SELECT *, abs(list_sum([x[i] * y[i % 32 + 1] - x[i % 32 + 1] * y[i] FOR i IN range(1, 33)])) / 2 AS area, list_min(x) AS x0, list_min(y) AS y0, list_max(x) AS x1, list_max(y) AS y1 FROM p),
    b AS (SELECT *, least(x0, y0, 1 - x1, 1 - y1) AS border, (x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1) AS valid FROM a),
    q AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, border / 0.04::DOUBLE)) AS bs, CASE WHEN area < 0.02 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, area / 0.02::DOUBLE))
          WHEN area > 0.65 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - area) / 0.35::DOUBLE)) ELSE 1.0::DOUBLE END AS ars FROM b),
    r AS (SELECT *, round(0.3::DOUBLE * det + 0.3::DOUBLE * mask + 0.15::DOUBLE * stab + 0.15::DOUBLE * ars + 0.1::DOUBLE * bs, 6) AS score FROM q)"""


@query(f"""
    WITH {_POLYGON_SQL}
    SELECT vec_id, valid, round(area, 6) AS area_fraction, round(ars, 6) AS area_score, round(bs, 6) AS border_score, score AS representative_score,
           array_to_string(list_filter([CASE WHEN area < 0.01 THEN 'small_region' END, CASE WHEN area > 0.75 THEN 'dominates_frame' END, CASE WHEN border <= 0.005 THEN 'touches_frame_edge' END,
             CASE WHEN det < 0.3 THEN 'low_detection_confidence' END, CASE WHEN mask < 0.5 THEN 'low_mask_quality' END], lambda f: f IS NOT NULL), ',') AS flags
    FROM r
""")
def polygon_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _polygon(spark, sf_dir).withColumn("q", G.quality(F.col("polygon"), F.col("detection"), F.col("mask"), F.col("stability")))
    figures = [f"q.{name}" for name in ("area_fraction", "area_score", "border_score", "representative_score")]
    return scored.select("vec_id", G.valid(F.col("polygon")).alias("valid"), *figures, F.array_join("q.flags", ",").alias("flags"))


@query(f"""
    WITH {_POLYGON_SQL}
    SELECT vec_id, 33 AS ring_points, round(x[1] * 640 + 20, 6) AS first_x, round(y[1] * 480, 6) AS first_y, round(x0, 9) AS bbox_x0, round(y0, 9) AS bbox_y0, round(x1, 9) AS bbox_x1, round(y1, 9) AS bbox_y1 FROM r
""")
def polygon_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _polygon(spark, sf_dir).withColumns({"ring": G.ring(F.col("polygon")), "box": G.bbox(F.col("polygon")), "drawn": G.scale(F.col("polygon"), F.lit(640), F.lit(480), F.lit(20))})
    first = F.get("drawn", F.lit(0))
    return shapes.select("vec_id", F.size("ring").alias("ring_points"), F.round(first["x"], 6).alias("first_x"), F.round(first["y"], 6).alias("first_y"), *[F.round(f"box.{c}", 9).alias(f"bbox_{c}") for c in ("x0", "y0", "x1", "y1")])


class TableSegmenter:
    """Stands in for a model: a frame's regions are told in its license field as JSON."""

    model_name, model_version = "table", "1"

    def segment(self, frame, prompts):
        import json

        told = json.loads(frame["license"])
        if told["fail"]:
            raise RuntimeError(f"no regions in {frame['observation_id']}")
        return [{"label": prompts[told["label"] % len(prompts)], "polygon": told["polygon"], "detection_confidence": told["det"], "mask_quality": told["mask"], "stability_score": told["stab"]}]


def told_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame per polygon; every 17th fails."""
    told = F.to_json(F.struct(
        (F.col("vec_id") % 17 == 0).alias("fail"), F.col("label"), F.transform("polygon", lambda p: F.array(p["x"], p["y"])).alias("polygon"),
        F.col("detection").alias("det"), F.col("mask"), F.col("stability").alias("stab"),
    ))
    null = lambda name: F.lit(None).cast("string").alias(name)
    return _polygon(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("observation_id"), F.concat(F.lit("https://pictures.example/"), F.col("vec_id")).alias("image_url"), F.concat(F.lit("s"), F.col("vec_id") % 20).alias("subject_id"),
        null("image_sha256"), null("local_path"), null("species_name"), null("photo_id"), told.alias("license"), null("captured_at"), F.lit(0).alias("frame_index"),
    )


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frames, segments)."""
    frame = told_frames(spark, sf_dir)
    return frame, notices.segmented(frame, TableSegmenter)


_LABELS_SQL = "(['leaf','flower','fruit','stem','bark','bud','stem','plant'])[1 + label % 8]"


@query(f"""
    WITH {_POLYGON_SQL}, k AS (SELECT *, 'category:' || {_LABELS_SQL} AS cat FROM r WHERE valid AND vec_id % 17 <> 0)
    SELECT cat AS category_id, count(*) AS proposals, count(DISTINCT vec_id) AS proposal_ids, max(score) AS best_score, least(count(*), 5) AS selected, (count(*) * (count(*) + 1) // 2)::BIGINT AS rank_sum FROM k GROUP BY cat
""")
def notice_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, segments = _batch(spark, sf_dir)
    found = notices.ranked(notices.proposals(segments, "table", "1"), top_k=5)
    return found.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("proposals"), F.count_distinct("proposal_id").alias("proposal_ids"), F.max("quality.representative_score").alias("best_score"),
        F.count_if("selected_for_review").alias("selected"), F.sum("representative_rank").alias("rank_sum"),
    )


@query("SELECT vec_id::VARCHAR AS observation_id, 'RuntimeError' AS error_type, 'no regions in ' || vec_id AS message FROM embeddings WHERE vec_id % 17 = 0")
def notice_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.failures(_batch(spark, sf_dir)[1], "table").select("observation_id", "error_type", "message")


@query(f"""
    WITH {_POLYGON_SQL}
    SELECT vec_id::VARCHAR AS observation_id, CASE WHEN valid AND vec_id % 17 <> 0 THEN 1 ELSE 0 END AS annotations, CASE WHEN valid AND vec_id % 17 <> 0 THEN score END AS confidence,
           CASE WHEN valid AND vec_id % 17 <> 0 THEN 33 END AS ring_points FROM r
""")
def notice_batch_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, segments = _batch(spark, sf_dir)
    nested = notices.batch_observations(frame, notices.ranked(notices.proposals(segments, "table", "1")))
    first = F.get("annotations", F.lit(0))
    return nested.select("observation_id", F.size("annotations").alias("annotations"), first["confidence"].alias("confidence"), F.size(first["polygon"]).alias("ring_points"))


@query("SELECT o_orderkey, count(l_orderkey)::INTEGER AS n_lines, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS all_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    nested = notices.nested_lists(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", F.col("l_linenumber"), "lines", F.col("l_linenumber"))
    return nested.select("o_orderkey", F.size("lines").alias("n_lines"), F.array_join("lines", ",").alias("all_lines"))


@query("""
    WITH o AS (SELECT doc_id, 'o' || (doc_id % 97) || '-' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://x.example/p/' || source || '.jpg' END AS url, text FROM documents),
    m AS (SELECT '/media/' || id || '/' || source || '.jpg' AS path, 'sha256:' || sha256(text) AS h, octet_length(encode(text))::BIGINT AS n FROM (SELECT 'o' || (doc_id % 97) || '-' || doc_id AS id, * FROM documents) WHERE doc_id % 3 <> 0)
    SELECT o.id AS observation_id, CASE WHEN url = '' THEN 'no_photo' WHEN m.path IS NULL THEN 'missing_media' ELSE 'ready' END AS status, nullif(url, '') AS image_url, m.h AS image_sha256, m.n AS byte_size
    FROM o LEFT JOIN m ON m.path = '/media/' || o.id || '/' || split_part(o.url, '/', -1) AND o.url <> ''
""")
def photo_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("observation_id", F.concat(F.lit("o"), F.col("doc_id") % 97, F.lit("-"), F.col("doc_id")))
    url = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("https://x.example/p/"), F.col("source"), F.lit(".jpg")))
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    seen = docs.select("observation_id", url.alias("photo_url"), null("latitude", "double"), null("longitude", "double"), null("time_observed_at", "string"), null("session_id", "string"))
    media = docs.where("doc_id % 3 <> 0").select(X.joined_path(F.lit("/media"), F.col("observation_id"), F.concat("source", F.lit(".jpg"))).alias("path"), P.content_hash(F.col("text")).alias("image_sha256"), F.octet_length("text").cast("long").alias("byte_size"))
    return notices.photo_manifest(seen, media, "/media").select("observation_id", "status", "image_url", "image_sha256", "byte_size")


@query("""
    SELECT count(*) AS observations, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS ready, count(*) FILTER (doc_id % 5 = 0 OR doc_id % 3 = 0) AS non_ready FROM documents
""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.manifest_summary(photo_manifest(spark, sf_dir))


@query("""
    WITH e AS (SELECT event_id::VARCHAR AS annotation_id, 's' || (user_id % 20) AS subject_id, value AS score, CASE event_id % 4 WHEN 0 THEN 'fruit bud' WHEN 1 THEN 'Whole_Plant' WHEN 2 THEN '' ELSE event_type END AS det FROM events),
    g AS (SELECT *, CASE det WHEN 'fruit bud' THEN 'category:ambiguous_organ' WHEN 'Whole_Plant' THEN 'category:plant' WHEN '' THEN 'category:leaf' ELSE 'category:ambiguous_organ' END AS cat FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, cat ORDER BY score DESC, annotation_id) AS rk FROM g)
    SELECT annotation_id, cat AS gallery_category_id, cat = 'category:ambiguous_organ' AS requires_organ_review, subject_id || '/' || cat AS gallery_group, rk::INTEGER AS gallery_rank FROM k WHERE rk <= 3
""")
def review_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 4
    detector = F.when(turn == 0, "fruit bud").when(turn == 1, "Whole_Plant").when(turn == 2, "").otherwise(F.col("event_type"))
    annotations = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("annotation_id"), F.concat(F.lit("s"), F.col("user_id") % 20).alias("subject_id"), F.struct(F.col("value").alias("representative_score")).alias("quality"),
        F.struct(detector.alias("detector_label"), F.lit("").alias("prompt")).alias("model"), F.lit("category:leaf").alias("notice_category_id"),
    )
    chosen = notices.gallery(annotations, top_k=3, scope="subject-category")
    return chosen.select("annotation_id", "gallery_category_id", "requires_organ_review", F.array_join("gallery_group", "/").alias("gallery_group"), "gallery_rank")


@query(r"""
    WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(replace(p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'Leaf_' WHEN 1 THEN 'whole  plant' WHEN 2 THEN 'fruit bud' ELSE 'x' END, '_', ' ')), '\s+', ' ', 'g')) AS n FROM part),
    m AS (SELECT p_partkey, list_filter(['leaf','flower','fruit','stem','bark','bud','branch','whole plant'], lambda q: contains(n, q)) AS h FROM p)
    SELECT p_partkey, CASE WHEN len(h) = 1 THEN h[1] ELSE 'ambiguous organ' END AS organ,
           'category:' || CASE WHEN len(h) <> 1 THEN 'ambiguous_organ' WHEN h[1] = 'whole plant' THEN 'plant' WHEN h[1] = 'branch' THEN 'stem' ELSE h[1] END AS category FROM m
""")
def organ_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("p_partkey") % 4
    added = F.when(turn == 0, "Leaf_").when(turn == 1, "whole  plant").when(turn == 2, "fruit bud").otherwise("x")
    label = X.organ_label(F.concat_ws(" ", "p_name", added))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("organ"), X.category_id(label).alias("category"))


# --- answers and trials --------------------------------------------------------------------------------------

#: Answers that reach every branch of the readers.
_SAID = ("Yes.", "NOT SURE", "inconclusive", "It is known", "", "maybe yes", "I cannot determine it", "a", "It has small petals", "2", "4", "7", "  MEDIUM  ", "99999999999", "perhaps INC", "purple")
_SAID_SQL = "(['" + "','".join(_SAID) + f"'])[1 + event_id % {len(_SAID)}]"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(s) for s in _SAID]), (F.col("event_id") % len(_SAID) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", said.alias("said"))


_YES_NO_SQL = """CASE WHEN starts_with(upper(r), 'YES') THEN 'YES' WHEN starts_with(upper(r), 'NO') THEN 'NO' WHEN contains(upper(r), 'INC') THEN 'INCONCLUSIVE'
      WHEN contains(upper(r), 'YES') THEN 'YES' WHEN contains(upper(r), 'NO') THEN 'NO' ELSE 'INCONCLUSIVE' END"""


@query(f"SELECT 'e' || event_id AS id, {_YES_NO_SQL} AS parsed FROM (SELECT event_id, {_SAID_SQL} AS r FROM events) UNION ALL SELECT 'c' || conv_id || '-' || turn, {_YES_NO_SQL} FROM (SELECT conv_id, turn, text AS r FROM conversations)")
def parse_ync(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _answers(spark, sf_dir).select(F.concat(F.lit("e"), "event_id").alias("id"), A.parse_yes_no(F.col("said")).alias("parsed"))
    told = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), A.parse_yes_no(F.col("text")).alias("parsed"))
    return said.unionByName(told)


_VALUES = ("MEDIUM", "Small", "purple spots", "LARGE")
_CHOICE_SQL = """coalesce(list_filter(v, lambda x: lower(x) = lower(t))[1], list_filter(v, lambda x: contains(lower(t), lower(x)))[1],
      CASE WHEN contains(lower(t), 'cannot determine') THEN NULL ELSE v[nullif(try_cast(nullif(regexp_extract(t, '^([0-9]+)', 1), '') AS INTEGER), 0)] END, 'INCONCLUSIVE')"""
_VALUES_SQL = "['" + "','".join(_VALUES) + "'] AS v"


@query(f"SELECT 'e' || event_id AS id, {_CHOICE_SQL} AS parsed FROM (SELECT event_id, trim({_SAID_SQL}) AS t, {_VALUES_SQL} FROM events) UNION ALL SELECT 'd' || doc_id, {_CHOICE_SQL} FROM (SELECT doc_id, text AS t, ['que', 'the', 'und'] AS v FROM documents)")
def parse_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lambda names: F.array(*[F.lit(v) for v in names])
    said = _answers(spark, sf_dir).select(F.concat(F.lit("e"), "event_id").alias("id"), A.parse_choice(F.col("said"), values(_VALUES)).alias("parsed"))
    told = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), A.parse_choice(F.col("text"), values(("que", "the", "und"))).alias("parsed"))
    return said.unionByName(told)


@query("""
    SELECT doc_id, p = t OR p = 'INCONCLUSIVE' AS feature_correct, p = t OR p <> 'INCONCLUSIVE' AS committed
    FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'INCONCLUSIVE' ELSE quality::VARCHAR END AS p, (doc_id % 2)::VARCHAR AS t FROM labels)
""")
def stepwise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.when(F.col("toxic") == 1, A.INCONCLUSIVE).otherwise(F.col("quality").cast("string"))
    score = A.step_score(parsed, (F.col("doc_id") % 2).cast("string"))
    return table(spark, sf_dir, "labels").select("doc_id", score["feature_correct"].alias("feature_correct"), score["committed"].alias("committed"))


@query("""
    SELECT m AS model, c_custkey::VARCHAR AS observation_id, f AS feature FROM customer, (VALUES ('one'), ('two')) AS m(m), (VALUES ('key_flower_type'), ('key_plant_type'), ('key_leaf_type')) AS f(f)
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND m = CASE o_orderstatus WHEN 'F' THEN 'one' ELSE 'two' END
      AND f = CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'key_flower_type' WHEN '2' THEN 'key_plant_type' ELSE 'key_leaf_type' END)
""")
def trial_task_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("observation_id"), F.col("c_name").alias("species_inat"))
    first = F.substring("o_orderpriority", 1, 1)
    done = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("observation_id"), F.when(F.col("o_orderstatus") == "F", "one").otherwise("two").alias("model"),
        F.when(first == "1", "key_flower_type").when(first == "2", "key_plant_type").otherwise("key_leaf_type").alias("feature"),
    )
    every = trials.tasks(sample, A.PRIMARY_FEATURES, ["one", "two"])
    return trials.remaining(every, done, trials.TASK_KEY).select(*trials.TASK_KEY)


def _trial_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample, paths, references) of a trial over customers: a species is a nation, its features are its number's."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    sample = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.col("c_custkey").alias("observation_id"), F.lit("").alias("photo_id"), F.concat(F.lit("https://x.example/"), "c_custkey").alias("photo_url"), F.lit("").alias("taxon_id"),
        F.col("n_name").alias("species_inat"), F.concat(F.lit("guide "), "n_name").alias(keys.SPECIES),
    )
    key = F.col("n_nationkey")
    paths = frames.ensure_columns(nation.select(
        F.concat(F.lit("guide "), "n_name").alias(keys.SPECIES), F.col("n_name").alias("species_inat"), key.alias("species_page"), F.lit("1").alias("key_group_number"),
        F.concat(F.lit("type "), key % 3).alias("key_flower_type"), F.when(key % 4 != 0, F.concat(F.lit(" plant "), key % 2)).alias("key_plant_type"),
        F.when(key % 5 == 0, "no apparent leaves").otherwise("").alias("key_leaf_type"),
    ), keys.PATH_COLUMNS)
    refs = spark.sql("""SELECT feature, feature_value, '' AS reference_image_link, picture AS reference_illustration_path, 'what it is' AS reference_description, ordinal FROM VALUES
        ('key_flower_type', 'type 0', '/p/0.png', 0), ('key_flower_type', 'type 1', '', 1), ('key_flower_type', 'type 2', '/p/2.png', 2), ('key_plant_type', 'plant 0', '', 3),
        ('key_plant_type', 'plant 1', '', 4), ('key_leaf_type', 'no apparent leaves', '/p/l.png', 5) AS t(feature, feature_value, picture, ordinal)""")
    return sample, paths, refs


def answering_call(model: Column, parts: Column) -> Column:
    """A stand-in that sees all but every third picture and names the second option."""
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["value"]), "")
    picture = F.get(F.filter(parts, lambda p: p["kind"] == "image"), F.lit(0))["value"]
    number = F.regexp_extract(picture, r"(\d+)$", 1).try_cast("int")
    return F.when(F.contains(text, F.lit("Answer only")), F.when(number % 3 == 0, "No.").otherwise("Yes, clearly")).otherwise(F.when(number % 4 == 0, "it is type 0").otherwise("2"))


@query("""
    WITH t AS (SELECT c_custkey AS k, f, CASE f WHEN 'key_flower_type' THEN 'type ' || (c_nationkey % 3) WHEN 'key_plant_type' THEN CASE WHEN c_nationkey % 4 <> 0 THEN 'plant ' || (c_nationkey % 2) END
        ELSE CASE WHEN c_nationkey % 5 = 0 THEN 'no apparent leaves' END END AS truth FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('key_flower_type'), ('key_plant_type'), ('key_leaf_type')) AS x(f)),
    p AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'NO' ELSE 'YES' END AS p1, CASE WHEN k % 4 = 0 THEN 'it is type 0' ELSE '2' END AS raw FROM t WHERE truth IS NOT NULL),
    r AS (SELECT *, CASE WHEN p1 = 'NO' THEN 'INCONCLUSIVE' WHEN f = 'key_flower_type' THEN CASE WHEN k % 4 = 0 THEN 'type 0' ELSE 'type 1' END
        WHEN f = 'key_plant_type' THEN CASE WHEN k % 4 = 0 THEN 'INCONCLUSIVE' ELSE 'plant 1' END ELSE 'INCONCLUSIVE' END AS p2 FROM p)
    SELECT k::VARCHAR AS observation_id, f AS feature, truth AS true_value, p1 AS p1_parsed, CASE WHEN p1 = 'YES' THEN raw ELSE '' END AS p2_raw, p2 AS p2_parsed,
           p2 = truth OR p2 = 'INCONCLUSIVE' AS feature_correct, p2 = truth OR p2 <> 'INCONCLUSIVE' AS committed FROM r
""")
def stepwise_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, paths, refs = _trial_tables(spark, sf_dir)
    todo = trials.with_truth(trials.tasks(sample, A.PRIMARY_FEATURES, ["stand-in"]), paths, A.PRIMARY_FEATURES)
    values = trials.feature_values(refs.select("feature", F.col("feature_value").alias("value")))
    done = trials.second_phase(trials.first_phase(todo, answering_call), trials.options(refs), values, answering_call)
    full = trials.step_results(trials.scored(done), "t", "2024-01-01T00:00:00+00:00", "mock", "", ",".join(A.PRIMARY_FEATURES))
    return full.select("observation_id", "feature", "true_value", "p1_parsed", "p2_raw", "p2_parsed", "feature_correct", "committed")


def calibrating_call(model: Column, parts: Column) -> Column:
    """A stand-in that goes by the number of the picture: yes or no, one word or none, the second option or nothing."""
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["value"]), "")
    number = F.regexp_extract(F.get(F.filter(parts, lambda p: p["kind"] == "image"), F.lit(0))["value"], r"(\d+)$", 1).try_cast("int")
    one_word = F.contains(text, F.lit("Reply with exactly one word"))
    return (
        F.when(F.contains(text, F.lit("Answer only")), F.when(number % 3 == 0, "No, sorry").otherwise("yes"))
        .when(one_word, F.when(number % 5 == 0, "inc.").otherwise("Yes!"))
        .otherwise(F.when(number % 4 == 0, A.CANNOT).otherwise("2"))
    )


@query(f"""
    WITH r AS (SELECT ['{"','".join(A.PRIMARY_FEATURES)}'][1 + p_partkey % 3] AS f, p_type AS v, min(p_partkey) AS n, max(p_size) AS s FROM part GROUP BY p_partkey % 3, p_type),
    o AS (SELECT f, v AS second FROM r QUALIFY row_number() OVER (PARTITION BY f ORDER BY n) = 2),
    d AS (SELECT DISTINCT v FROM r WHERE n % 7 = 0),
    t AS (SELECT m, r.*, t, CASE t WHEN 'existence' THEN CASE WHEN n % 3 = 0 THEN 'No, sorry' ELSE 'yes' END WHEN 'agreement' THEN CASE WHEN n % 5 = 0 THEN 'inc.' ELSE 'Yes!' END
            ELSE CASE WHEN n % 4 = 0 THEN '{A.CANNOT}' ELSE '2' END END AS raw
          FROM r, (VALUES ('one'), ('two')) AS m(m), (VALUES ('existence'), ('agreement'), ('blind_mc')) AS t(t) WHERE s > 25 AND NOT (m = 'one' AND t = 'agreement' AND v IN (SELECT v FROM d))),
    p AS (SELECT t.*, CASE WHEN t = 'blind_mc' THEN CASE WHEN raw = '2' THEN second ELSE 'INCONCLUSIVE' END ELSE CASE raw WHEN 'No, sorry' THEN 'NO' WHEN 'inc.' THEN 'INCONCLUSIVE' ELSE 'YES' END END AS parsed,
                 CASE WHEN t = 'blind_mc' THEN v ELSE 'YES' END AS expected FROM t JOIN o ON o.f = t.f)
    SELECT m AS model, f AS feature, v AS feature_value, t AS prompt_type, raw AS raw_response, parsed, expected, parsed = expected AS correct FROM p
""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from parts (a type of a feature; those with a large part have a picture) asked about in three ways; one model has
    agreed or not on some values before."""
    key = F.col("p_partkey")
    feature = F.element_at(F.array(*map(F.lit, A.PRIMARY_FEATURES)), (key % 3 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").groupBy(feature.alias("feature"), F.col("p_type").alias("feature_value")).agg(F.min("p_partkey").alias("ordinal"), F.max("p_size").alias("s"), F.min("p_brand").alias("reference_description"))
    refs = parts.select("feature", "feature_value", "ordinal", "reference_description", F.when(F.col("s") > 25, F.concat(F.lit("/p/"), "ordinal")).otherwise("").alias("reference_illustration_path"))
    done = refs.where("ordinal % 7 = 0").select(F.lit("one").alias("model"), "feature_value", F.lit("agreement").alias("prompt_type"))
    todo = trials.remaining(trials.calibration_tasks(refs, ["one", "two"]), done, trials.CALIBRATION_KEY)
    return trials.calibrated(todo, trials.options(refs), calibrating_call)


@query("""
    SELECT c_custkey, '[{"type":"image_url","image_url":{"url":"u' || c_custkey || '"}},{"type":"text","text":"Is it \\"' || c_mktsegment || '\\"?"}]' AS content,
           '[{"image":"u' || c_custkey || '"}, "Is it \\"' || c_mktsegment || '\\"?"]' AS parts_json, true AS has_image FROM customer
""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(A.part("image", F.concat(F.lit("u"), "c_custkey")), A.part("text", F.concat(F.lit('Is it "'), "c_mktsegment", F.lit('"?'))))
    made = table(spark, sf_dir, "customer").withColumn("parts", parts)
    return made.select("c_custkey", P.chat_content(F.col("parts")).alias("content"), P.parts_json(F.col("parts")).alias("parts_json"), P.has_image(F.col("parts")).alias("has_image"))


@query("SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS answer, 'two lines' || chr(10) || role AS listed FROM conversations")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrap = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    items = F.array(F.struct(F.lit("text").alias("type"), F.lit("two lines").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.answer_content(wrap(F.col("text"))).alias("answer"), P.answer_content(wrap(items)).alias("listed"))


# --- names, gate and models ----------------------------------------------------------------------------------


@query(r"""
    SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'), 1, 120), ''), 'none') AS slug, split_part(url, '/', -1) AS file,
           'stepwise-20240101-120000-' || trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-') || '-n5-key_a-key_b' AS trial_id FROM pages
""")
def trial_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, started = F.col("url"), F.lit("2024-01-01 12:00:00").cast("timestamp")
    name = X.trial_id(started, url, F.lit("5"), F.lit("key_a, key_b,,"))
    return table(spark, sf_dir, "pages").select("page_id", X.slug(url).alias("slug"), X.file_name(url).alias("file"), name.alias("trial_id"))


@query("""
    WITH l AS (SELECT c_custkey AS n, CASE c_custkey % 5 WHEN 0 THEN '# ' || c_name WHEN 1 THEN ' export K' || (c_custkey % 50) || ' = "' || c_mktsegment || '" ' WHEN 2 THEN '' WHEN 3 THEN 'no sign' ELSE 'K' || (c_custkey % 50) || '=' || c_name || '=x' END AS t FROM customer)
    SELECT 'K' || (n % 50) AS key, arg_min(CASE WHEN n % 5 = 1 THEN c_mktsegment ELSE c_name || '=x' END, n) AS value FROM l JOIN customer ON c_custkey = n WHERE n % 5 IN (1, 4) AND n % 50 <> 4 GROUP BY n % 50
""")
def settings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, name = F.col("c_custkey") % 5, F.concat(F.lit("K"), F.col("c_custkey") % 50)
    line = (
        F.when(turn == 0, F.concat(F.lit("# "), "c_name")).when(turn == 1, F.concat(F.lit(" export "), name, F.lit(' = "'), "c_mktsegment", F.lit('" '))).when(turn == 2, "")
        .when(turn == 3, "no sign").otherwise(F.concat(name, F.lit("="), "c_name", F.lit("=x")))
    )
    set_ = table(spark, sf_dir, "customer").select("c_custkey", X.setting(line).alias("s")).where(F.col("s").isNotNull())
    first = set_.groupBy(F.col("s.key").alias("key")).agg(F.min_by("s.value", "c_custkey").alias("value"))
    return readers.new_settings(first, spark.sql("SELECT 'K4' AS key"))


@query("""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id::VARCHAR END AS a, ' ' || user_id AS b, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'u' || event_id END AS url,
        CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type END AS s1, CASE WHEN event_id % 2 = 0 THEN 'guess' END AS s2 FROM events)
    SELECT coalesce(a, trim(b)) AS observation_id, url AS image_url, coalesce(nullif(s1, ''), s2, coalesce(a, trim(b))) AS subject_id, coalesce(nullif(s1, ''), s2) AS species_name FROM e WHERE trim(url) <> '' ORDER BY event_id LIMIT 500
""")
def observation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.when(n % 7 != 0, n.cast("string")).alias("id"), F.concat(F.lit(" "), "user_id").alias("observation_id"), F.when(n % 5 == 0, "  ").otherwise(F.concat(F.lit("u"), n)).alias("image_url"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("event_type")).alias("scientific_name"), F.when(n % 2 == 0, "guess").alias("species_guess"), n,
    )
    return readers.observation_frames(rows, limit=500, order="event_id").select("observation_id", "image_url", "subject_id", "species_name")


_LAYERS = ("growth_form", "leaf", "root", "flower")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    prompts = F.when(key % 6 == 0, F.array(F.lit(" a "), F.lit(""))).when(key % 6 == 1, F.array_repeat(F.lit("p"), 11)).when(key % 6 == 2, F.array(F.repeat(F.lit("x"), F.lit(81))))
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"), F.when(key % 10 != 9, (key % 13) / 10).alias("threshold"), F.element_at(F.array(*[F.lit(x) for x in _LAYERS]), (key % 4 + 1).cast("int")).alias("layer"),
        prompts.alias("prompts"), F.concat(F.when(key % 2 == 0, "data:image/jpeg;base64,").otherwise(""), F.base64(F.col("c_name").cast("binary"))).alias("image_base64"),
    )


@query("""
    WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 <> 9 THEN (c_custkey % 13) / 10.0::DOUBLE ELSE 0.75::DOUBLE END AS t, (['growth_form','leaf','root','flower'])[1 + c_custkey % 4] AS layer FROM customer)
    SELECT k AS request_id, CASE WHEN t > 1 THEN 'threshold must be between 0 and 1' WHEN k % 6 = 1 THEN 'at most 10 probe prompts per request' WHEN k % 6 = 2 THEN 'probe prompts must be 80 characters or fewer'
             WHEN k % 6 <> 0 AND layer = 'root' THEN 'unsupported organ layer: root' END AS detail,
           CASE WHEN k % 6 = 0 THEN 'a' WHEN k % 6 = 1 THEN 'p,p,p,p,p,p,p,p,p,p,p' WHEN k % 6 = 2 THEN repeat('x', 81) WHEN layer = 'growth_form' THEN 'whole plant' WHEN layer = 'root' THEN '' ELSE layer END AS active_prompts,
           CASE WHEN t > 1 OR k % 6 IN (1, 2) OR (k % 6 <> 0 AND layer = 'root') THEN 422 ELSE 200 END AS status FROM r
""")
def gate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = gate.checked_requests(_requests(spark, sf_dir))
    status = gate.response_status(F.lit(gate.PATHS[0]), F.lit("POST"), F.lit(True), F.col("detail"))
    return checked.select("request_id", "detail", F.array_join("active_prompts", ",").alias("active_prompts"), status.alias("status"))


@query("""
    WITH p AS (SELECT o_custkey AS k, o_orderkey AS o, round(0.5::DOUBLE * ((o_orderkey % 101) / 100.0::DOUBLE) + 0.5::DOUBLE * ((o_orderkey % 7) / 6.0::DOUBLE), 6) AS c FROM orders),
    b AS (SELECT k, max(c) AS c, count(*) AS n, arg_min(o, (-c, o)) AS o FROM p GROUP BY k)
    SELECT c_custkey AS request_id, coalesce(c, 0.0::DOUBLE) AS confidence, coalesce(c >= 0.75, false) AS gate_open, 'live-leaf-' || o AS best_proposal_id, coalesce(n, 0)::INTEGER AS proposal_count FROM customer LEFT JOIN b ON k = c_custkey
""")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").cast("int").alias("ordinal"), F.lit("leaf").alias("layer"), F.lit(0.75).alias("threshold"),
        ((F.col("o_orderkey") % 101) / 100).alias("detection_confidence"), ((F.col("o_orderkey") % 7) / 6).alias("mask_quality"),
    )
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("leaf").alias("layer"), F.lit(0.75).alias("threshold"))
    made = gate.gate_decisions(gate.gate_proposals(found, ["request_id"]), requests, ["request_id"])
    return made.select("request_id", "confidence", "gate_open", "best_proposal_id", "proposal_count")


@query("""
    WITH m AS (SELECT p_partkey AS n, p_name AS id, p_partkey % 5 <> 0 AND p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 4 <> 1 AS usable FROM part)
    SELECT x.m AS model, CASE WHEN x.m LIKE 'openrouter%' THEN (SELECT arg_min(id, n) FROM m WHERE usable) ELSE x.m END AS resolved, (SELECT count(*) FROM m WHERE usable) AS usable FROM (VALUES ('openrouter/free-vision'), ('a/concrete-model')) AS x(m)
""")
def free_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    catalogue = table(spark, sf_dir, "part").select(
        n.alias("ordinal"), F.col("p_name").alias("id"), F.when(n % 5 == 0, "Safety model").otherwise("Model").alias("name"),
        F.struct(F.when(n % 3 == 0, "0").otherwise("0.1").alias("prompt"), F.when(n % 7 == 0, "free").otherwise("0.0").alias("completion")).alias("pricing"),
        F.struct(F.when(n % 4 == 1, F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("image"))).alias("input_modalities"), F.array(F.lit("text")).alias("output_modalities")).alias("architecture"),
    )
    asked = spark.sql("SELECT model FROM VALUES ('openrouter/free-vision'), ('a/concrete-model') AS t(model)")
    usable = catalogue.agg(F.count_if(P.usable_free_model(F.struct("id", "name", "pricing", "architecture"), True)).alias("usable"))
    return gate.resolve_models(asked, catalogue, require_image=True).crossJoin(F.broadcast(usable))  # one row
