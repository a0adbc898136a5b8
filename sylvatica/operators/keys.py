"""Flat inputs from an identification key: feature and value pairs, species paths, references, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.functions.text import composite_key, joined_path
from sylvatica.operators.frames import ensure_columns, last_by_key, numbered_by

#: Feature names of the key and the columns that they become.
FEATURES = {
    "flower_type": "key_flower_type",
    "plant_type": "key_plant_type",
    "leaf_type": "key_leaf_type",
    "subgroup_1": "key_subgroup_1",
    "subgroup_2": "key_subgroup_2",
    "subgroup_3": "key_subgroup_3",
}

#: The picture that illustrates a value.
ILLUSTRATIONS = {
    "3 Regular Parts": "regular_flowers.png",
    "4 Regular Parts": "regular_flowers.png",
    "5 Regular Parts": "regular_flowers.png",
    "6 Regular Parts": "regular_flowers.png",
    "7 or More Regular Parts": "regular_flowers.png",
    "Irregular Flowers": "irregular_flowers.png",
    "Wildflowers - Alternate Leaves": "alternate_leaves.png",
    "Wildflowers - Opposite or Whorled Leaves": "opposite_leaves.png",
    "Wildflowers - Basal Leaves Only": "basal_leaves.png",
    "Leaves Entire": "leaves_entire.png",
    "Leaves Toothed or Lobed": "leaves_toothed.png",
    "Leaves Divided": "leaves_divided.png",
}

SPECIES = "guide_species_name"
#: The columns of the species table, in order.
PATH_COLUMNS = (
    SPECIES, "species_inat", "subspecies_inat", "suggested_species_id", "species_page", "key_page_range_start", "key_page_range_end", "key_group_number",
    "key_flower_type", "key_plant_type", "key_leaf_type", "key_subgroup_1", "key_subgroup_2", "key_subgroup_3", "key_description", "species_inat_link",
    "subspecies_inat_link", "warning_species_extraction", "warning_key_extraction",
)
SAMPLE_COLUMNS = (SPECIES, "species_inat", "taxon_id", "observation_id", "photo_id", "photo_url")


def mapped(column: Column, names: dict[str, str]) -> Column:
    """The entry of a small dictionary, as a literal map: no join."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column)


def feature_value_pairs(steps: DataFrame, features: dict[str, str] = FEATURES) -> DataFrame:
    """Distinct (feature, value) of the steps (feature_name, feature_value) whose feature is known.

    The filters stand before the distinct, where the scan can take them.
    """
    filled = steps.where(F.col("feature_name").isin(*features) & F.col("feature_value").isNotNull() & (F.col("feature_value") != ""))
    return filled.select(mapped(F.col("feature_name"), features).alias("feature"), F.col("feature_value").alias("value")).distinct()


def route_features(steps: DataFrame, features: dict[str, str] = FEATURES) -> DataFrame:
    """A row per route with a column per feature: its value at the smallest path_k, null without one.

    The columns are given, so no job looks for them, and one that has no values is there all the same.
    """
    known = steps.where(F.col("feature_name").isin(*features) & F.col("feature_value").isNotNull())
    named = known.select("route_id", "path_k", mapped(F.col("feature_name"), features).alias("feature"), "feature_value")
    columns = [F.min_by(F.when(F.col("feature") == f, F.col("feature_value")), F.when(F.col("feature") == f, F.col("path_k"))).alias(f) for f in features.values()]
    return named.groupBy("route_id").agg(*columns)


def species_paths(taxa: DataFrame, taxon_routes: DataFrame, routes: DataFrame, steps: DataFrame) -> DataFrame:
    """Each species with each route of the key that leads to it, flat, in the columns of PATH_COLUMNS."""
    base = taxon_routes.join(taxa, "taxon_id").join(routes, "route_id").join(route_features(steps), "route_id", "left")
    base = base.withColumns({
        SPECIES: F.col("scientific_name"), "suggested_species_id": F.col("canonical_name"), "species_inat": F.col("canonical_name"),
        "warning_species_extraction": F.col("warning_species_extraction").cast("double"),
        "warning_key_extraction": F.col("warning_key_extraction").cast("double"), "subspecies_inat_link": F.lit(""),
    })
    return ensure_columns(base, PATH_COLUMNS)


def path_order() -> list[Column]:
    """The order of the species table; the later columns only break ties."""
    return [F.col(c).asc_nulls_last() for c in (SPECIES, "species_page", "key_group_number", *PATH_COLUMNS[8:15])]


def sorted_paths(paths: DataFrame) -> DataFrame:
    """The species table in its order, with the 0-based ``index`` of each row; rows that agree in the order are told
    apart by their other columns."""
    rest = [F.col(c).asc_nulls_last() for c in PATH_COLUMNS if c not in (SPECIES, "species_page", "key_group_number", *PATH_COLUMNS[8:15])]
    # the numbered ranges follow each other already: no second shuffle puts them in order
    return numbered_by(paths.select(*PATH_COLUMNS), [*path_order(), *rest], "index").sortWithinPartitions("index")


def references(pairs: DataFrame, concepts: DataFrame, pictures: DataFrame, root: str, features: dict[str, str] = FEATURES) -> DataFrame:
    """A row per pair with its picture's path and its feature's prompt, each "" where there is none.

    ``concepts``: feature_name, feature_prompt and the row's ordinal (the last of a name counts);
    ``pictures``: the paths that exist.
    """
    prompts = last_by_key(concepts.select(mapped(F.col("feature_name"), features).alias("feature"), "feature_prompt", "ordinal").where(F.col("feature").isNotNull()), ["feature"], "ordinal")
    wanted = pairs.withColumn("path", joined_path(F.lit(root.rstrip("/")), mapped(F.col("value"), ILLUSTRATIONS)))
    wanted = wanted.withColumn("path", F.when(mapped(F.col("value"), ILLUSTRATIONS).isNotNull(), F.col("path")))
    there = pictures.select("path").distinct().withColumn("exists", F.lit(True))
    joined = wanted.join(there, "path", "left").join(prompts.drop("ordinal"), "feature", "left")
    return joined.select(
        F.col("value").alias("feature_value"), F.lit("").alias("reference_image_link"),
        F.when(F.col("exists"), F.col("path")).otherwise("").alias("reference_illustration_path"),
        F.coalesce("feature_prompt", F.lit("")).alias("reference_description"), "feature",
    )


def illustration_paths(refs: DataFrame) -> DataFrame:
    """(key, path): ``feature:value`` and its picture."""
    return refs.select(composite_key(F.col("feature"), F.col("feature_value")).alias("key"), F.col("reference_illustration_path").alias("path"))


def observation_sample(observations: DataFrame, paths: DataFrame) -> DataFrame:
    """Observations of the key's species; a null name matches a null name."""
    species = paths.select(SPECIES, "species_inat").distinct()
    joined = observations.join(species, observations["scientific_name"].eqNullSafe(species["species_inat"]))
    return ensure_columns(joined, SAMPLE_COLUMNS, sources={"photo_url": "image_url", "observation_id": "id"}).distinct()


def summary(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table, counted in one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def unpivoted_truth(paths: DataFrame, features: Sequence[str]) -> DataFrame:
    """(species_inat, feature, true_value) from the first path of each species; blank values give no row."""
    from sylvatica.functions.text import strip
    from sylvatica.operators.frames import first_by_key

    first = first_by_key(paths, ["species_inat"], path_order())
    long = first.unpivot(["species_inat"], list(features), "feature", "true_value").withColumn("true_value", strip(F.col("true_value")))
    return long.where((F.col("true_value") != "") & F.col("species_inat").isNotNull())
