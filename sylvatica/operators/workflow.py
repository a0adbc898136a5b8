"""A curated tree of tasks, and recommendations from reviewed evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.operators.frames import broken_rules, insist, key_violations, last_by_key
from sylvatica.schemas import EVIDENCE_STATES, NODE_KINDS, TAXON_RANKS
from sylvatica.session import settled

#: Groups that cases are dealt to when all of them meet the roots.
SALTS = 32


def node_violations(nodes: DataFrame) -> DataFrame:
    """(rule, subject) of nodes that are no tree's: wrong kinds, missing ranks, unknown or looping parents."""
    feature, source = F.col("kind") == "feature", F.coalesce(F.col("source_feature_id"), F.lit("")) != ""
    own = broken_rules(nodes, "node_id", {
        "kind is taxon, notice or feature": F.col("kind").isin(*NODE_KINDS),
        "a taxon has a rank": (F.col("kind") != "taxon") | F.col("taxon_rank").isin(*TAXON_RANKS),
        "a feature has a source feature": ~feature | source,
        "only a feature has a source feature": feature | ~source,
    })
    keys = key_violations(nodes, "node_id", "node").select("rule", "subject")
    parents = nodes.where(F.coalesce(F.col("parent_id"), F.lit("")) != "").select(F.col("parent_id").alias("subject"))
    ids = nodes.select(F.col("node_id").alias("subject"))
    orphans = parents.join(ids, "subject", "left_anti").distinct().select(F.lit("parent does not exist").alias("rule"), "subject")
    return own.unionByName(keys).unionByName(orphans)


def depths(nodes: DataFrame) -> DataFrame:
    """(node_id, depth) of the nodes that a root leads to.  A node on a cycle, or below one or an unknown parent, is not there.

    By pointer doubling: a round replaces every node's ancestor by that one's own, so a tree of n levels takes
    log2(n) rounds, and a node that has not met a root after as many lies on or below a cycle.  Of rows that repeat
    a node_id one counts, a root before others, then the smallest parent.
    """
    parent = F.when(F.col("parent_id") != "", F.col("parent_id"))
    one = nodes.select("node_id", parent.alias("up")).groupBy("node_id").agg(F.min(F.struct(F.col("up").isNotNull().alias("below"), F.col("up").alias("up"))).alias("p"))
    state = settled(one.select("node_id", F.col("p.up").alias("up"), F.col("p.below").cast("int").alias("depth")))
    climbing, most = state.agg(F.count("up"), F.count(F.lit(1))).first()
    for _ in range(max(1, most).bit_length()):
        if not climbing:
            break
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        there = state.where(F.col("up").isNull())
        going = state.where(F.col("up").isNotNull()).join(above, "up").select("node_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        state = settled(there.unionByName(going))
        climbing = state.agg(F.count("up")).first()[0]
    return state.where(F.col("up").isNull()).select("node_id", "depth")


#: Spark's own bound of the rows that a recursive query makes.
_RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


def node_paths(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """node_id, depth, path (from the root, joined by "/") of the nodes that a root leads to, by a recursive query.

    A level is a join, so this is for trees that are wide rather than deep; ``depths`` takes rounds by the logarithm.
    The levels are bounded by the number of nodes, or by ``deepest``, beyond which the query fails; a cycle is never entered.
    """
    spark = nodes.sparkSession
    parent = F.when(F.col("parent_id") != "", F.col("parent_id"))
    one = nodes.select("node_id", parent.alias("up")).groupBy("node_id").agg(F.min(F.struct(F.col("up").isNotNull().alias("below"), F.col("up").alias("up"))).alias("p"))
    edges = settled(one.select("node_id", "p.up"))
    count = edges.count()
    levels = min(count, deepest) if deepest is not None else count
    before = spark.conf.get(_RECURSION_ROWS, None)
    spark.conf.set(_RECURSION_ROWS, str(count + 1))  # a node is reached once
    try:
        return settled(spark.sql(f"""
            WITH RECURSIVE walk(node_id, depth, path) MAX RECURSION LEVEL {levels + 1} AS (
                SELECT node_id, 0, node_id FROM {{edges}} WHERE up IS NULL
                UNION ALL SELECT /*+ MERGE(e) */ e.node_id, w.depth + 1, concat(w.path, '/', e.node_id) FROM walk AS w JOIN {{edges}} AS e ON e.up = w.node_id)
            SELECT node_id, depth, path FROM walk
        """, edges=edges))
    finally:
        spark.conf.unset(_RECURSION_ROWS) if before is None else spark.conf.set(_RECURSION_ROWS, before)


def cycle_nodes(nodes: DataFrame, loose: DataFrame | None = None) -> DataFrame:
    """(node_id) of the nodes on a cycle, without those below one.  ``loose``: the nodes that no root leads to, if known.

    From such nodes, if their parents are known, as many steps to the parent as there are nodes lead onto a cycle, and to each of
    its nodes; the steps are doubled, so that takes rounds by the logarithm.
    """
    parent = F.when(F.col("parent_id") != "", F.col("parent_id"))
    one = nodes.select("node_id", parent.alias("up")).groupBy("node_id").agg(F.min(F.struct(F.col("up").isNotNull().alias("below"), F.col("up").alias("up"))).alias("p"))
    if loose is None:
        loose = nodes.select("node_id").join(depths(nodes).select("node_id"), "node_id", "left_anti")
    state = settled(one.select("node_id", "p.up").join(loose.select("node_id"), "node_id", "left_semi"))
    for _ in range(max(1, state.count()).bit_length()):
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"))
        state = settled(state.join(above, "up").select("node_id", F.col("next").alias("up")))  # what hangs on an unknown parent goes
    return state.select(F.col("up").alias("node_id")).distinct()


def cycle_violations(nodes: DataFrame) -> DataFrame:
    loose = nodes.select("node_id").join(depths(nodes).select("node_id"), "node_id", "left_anti")
    return loose.select(F.lit("on a cycle or below one").alias("rule"), F.col("node_id").alias("subject"))


def validate_workflow(nodes: DataFrame) -> DataFrame:
    insist(node_violations(nodes), "workflow")
    insist(cycle_violations(nodes), "workflow")
    return nodes


def evidence_violations(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    states = broken_rules(evidence, "node_id", {"state is confirmed, rejected or unknown": F.col("state").isin(*EVIDENCE_STATES)})
    strange = evidence.select("node_id").join(nodes.select("node_id"), "node_id", "left_anti").distinct()
    return states.unionByName(strange.select(F.lit("unknown node").alias("rule"), F.col("node_id").alias("subject")))


def next_tasks(nodes: DataFrame, evidence: DataFrame, case: str | None = None) -> DataFrame:
    """Nodes without any recorded state that are roots or whose parent is confirmed.

    The last state recorded for a node counts.  A parent of "" never becomes confirmed.  With ``case``, a
    column of the evidence, the tasks of every case are given: all cases are answered in one query.
    """
    keys = [case] if case else []
    states = last_by_key(evidence.select(*keys, "node_id", "state", "ordinal"), [*keys, "node_id"], "ordinal").drop("ordinal")
    confirmed = states.where(F.col("state") == "confirmed").select(*keys, F.col("node_id").alias("parent_id"))
    columns = [*keys, *nodes.columns]
    # only children of confirmed nodes and the roots can be open, so cases meet no other node
    children = confirmed.join(nodes, "parent_id").select(*columns)
    roots = nodes.where(F.col("parent_id").isNull())
    if case:  # every root is asked of every case: both are dealt by a salt of the case, and no side is sent whole
        salt = F.pmod(F.xxhash64(case), F.lit(SALTS))
        cases = evidence.select(case).distinct().withColumn("__salt", salt)
        roots = cases.join(roots.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), "__salt").select(*columns)
    return roots.unionByName(children).join(states.select(*keys, "node_id"), [*keys, "node_id"], "left_anti").select(*columns)


def feature_evidence_violations(evidence: DataFrame, values: DataFrame) -> DataFrame:
    """``values``: release_id, vocab_id, feature_name of all releases."""
    own = broken_rules(evidence, "value_id", {
        "evidence is confirmed": F.col("review_state") == "confirmed",
        "confidence is in 0..1": F.col("confidence").isNull() | F.col("confidence").between(0, 1),
    })
    releases = values.select("release_id").distinct()
    unknown = evidence.join(releases, "release_id", "left_anti").select(F.lit("unknown release").alias("rule"), F.col("release_id").alias("subject"))
    known = values.select("release_id", F.col("vocab_id").alias("value_id"), "feature_name")
    joined = evidence.join(releases, "release_id", "left_semi").join(known, ["release_id", "value_id"], "left")
    wrong = F.when(F.col("feature_name").isNull(), "unknown value").when(F.col("feature_name") != F.col("feature_id"), "value of another feature")
    return own.unionByName(unknown).unionByName(joined.select(wrong.alias("rule"), F.col("value_id").alias("subject")).where(F.col("rule").isNotNull()))


def candidates(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, taxon_name) of the taxa that hold every asked value in every release asked.

    A division: claims that were asked for are counted per case, release and taxon and compared with the
    number asked.  The evidence is small beside the claims, so the claims are reduced before any shuffle.
    """
    asked = evidence.select("case_id", "release_id", F.col("feature_id").alias("feature_name"), F.col("value_id").alias("vocab_id")).distinct()
    sizes = asked.groupBy("case_id", "release_id").agg(F.count(F.lit(1)).alias("asked"))
    releases = sizes.groupBy("case_id").agg(F.count(F.lit(1)).alias("releases"))
    met = claims.join(asked, ["release_id", "feature_name", "vocab_id"]).select("case_id", "release_id", "taxon_name", "feature_name", "vocab_id").distinct()
    whole = met.groupBy("case_id", "release_id", "taxon_name").agg(F.count(F.lit(1)).alias("met")).join(sizes, ["case_id", "release_id"]).where("met = asked")
    return whole.groupBy("case_id", "taxon_name").agg(F.count(F.lit(1)).alias("agreeing")).join(releases, "case_id").where("agreeing = releases").select("case_id", "taxon_name")


def shared_taxon(found: DataFrame, lineage: DataFrame) -> DataFrame:
    """Per case: candidates, status, and the narrowest taxon that all candidates share.

    ``lineage``: taxon_name and a column per rank above species.  One aggregate answers all ranks: a rank is
    shared if no candidate lacks it and its least and greatest names are equal.
    """
    upper = [r for r in reversed(TAXON_RANKS[:-1]) if r in lineage.columns]
    joined = found.join(lineage.select("taxon_name", *upper), "taxon_name", "left")
    same = [(F.count(r) == F.count(F.lit(1))) & (F.min(r) == F.max(r)) for r in upper]
    grouped = joined.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("taxon_name")).alias("candidate_taxa"), F.min("taxon_name").alias("one"),
        *[F.when(test, F.min(r)).alias(r) for r, test in zip(upper, same, strict=True)],
    )
    alone = F.col("n") == 1

    def pick(alone_value: Column, values: list[Column]) -> Column:
        return F.when(alone, alone_value).otherwise(F.coalesce(*values, F.lit(None).cast("string")))

    return grouped.select(
        "case_id", "candidate_taxa", pick(F.lit("species"), [F.when(F.col(r).isNotNull(), F.lit(r)) for r in upper]).alias("taxon_rank"),
        pick(F.col("one"), [F.col(r) for r in upper]).alias("shared_taxon"), F.when(alone, "recommended").otherwise("ambiguous").alias("status"),
    )


def recommend(cases: DataFrame, claims: DataFrame, evidence: DataFrame, lineage: DataFrame) -> DataFrame:
    """A recommendation for each case of ``cases`` (case_id), with the releases that took part."""
    named = shared_taxon(candidates(claims, evidence), lineage)
    asked = evidence.groupBy("case_id").agg(F.array_sort(F.collect_set("release_id")).alias("release_ids"))
    joined = cases.select("case_id").distinct().join(asked, "case_id", "left").join(named, "case_id", "left")
    none = F.array().cast("array<string>")
    status = F.when(F.col("release_ids").isNull(), "no_evidence").when(F.col("status").isNull(), "no_match").otherwise(F.col("status"))
    return joined.select(
        "case_id", "shared_taxon", "taxon_rank", F.coalesce("candidate_taxa", none).alias("candidate_taxa"), F.coalesce("release_ids", none).alias("release_ids"), status.alias("status")
    )
