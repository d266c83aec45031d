"""Fuzzy merging of field names: blocked similarity join, components, canonical names."""

from __future__ import annotations

import math
import string
from difflib import SequenceMatcher
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keywords import ANTONYMS, antonym_conflict, antonym_mask
from millrace.operators.components import star_components
from millrace.session import reliable_checkpoint, spread_groups

# Fixed values of the similarity rule.
JACCARD_WEIGHT, RATIO_WEIGHT = 0.6, 0.4
AUTO_MERGE, REVIEW, CONFIRM = 0.90, 0.55, 0.62

BLOCK_ROWS = 5_000
LETTERS = string.ascii_lowercase + string.digits + "_"


@F.pandas_udf(T.StructType().add("score", "double").add("rounded", "double"))
def _score(first: pd.Series, second: pd.Series, shared: pd.Series,
           either: pd.Series) -> pd.DataFrame:
    scores = [JACCARD_WEIGHT * (s / e) + RATIO_WEIGHT * SequenceMatcher(None, a, b).ratio()
              for a, b, s, e in zip(first, second, shared, either)]
    return pd.DataFrame({"score": scores, "rounded": [round(s, 3) for s in scores]})


def letter_counts(name: Column) -> Column:
    """How often each letter occurs, and in the last place all other characters together."""
    counts = [F.length(name) - F.length(F.replace(name, F.lit(c))) for c in LETTERS]
    return F.array(*counts, F.length(name) - reduce(add, counts))


def ratio_bound(letters_a: Column, letters_b: Column, length_a: Column, length_b: Column) -> Column:
    """No string ratio can exceed this: matching blocks use each letter as often as both have it."""
    common = F.aggregate(F.zip_with(letters_a, letters_b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return 2 * common / (length_a + length_b)


def candidate_pairs(names: DataFrame, least_score: float = CONFIRM,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, name_a, name_b, shared, either, bound): the pairs of names in one scope that can
    reach ``least_score`` by their shared and all tokens and by the letters they have in
    common, without antonyms on both sides; a before b in first appearance.

    ``names(scope, name, first_run, first_ord)`` holds distinct normalized names. No pair is
    lost: a pair that reaches the score has a Jaccard index of at least
    t = (least_score - 0.4) / 0.6, hence shares at least t/(1+t) of its tokens. Small names meet
    on one shared token, all others on their two rarest shared tokens, so a token that a third
    of all names carry opens no block on its own. Blocks above ``block_rows`` are spread
    over salted sub-blocks.
    """
    floor = least_score - 0.0005  # what still rounds up to the limit
    t = (floor - RATIO_WEIGHT) / JACCARD_WEIGHT
    single_limit = math.floor((1 + t) / t + 1e-9)  # largest size sum that may share one token

    # Distinct names only, read several times below: computed once.
    base = reliable_checkpoint(names.select(
        "scope", "name", F.struct("first_run", "first_ord").alias("seen"),
        F.array_distinct(F.split("name", "_")).alias("tokens")))
    exploded = base.select("scope", "name", F.explode("tokens").alias("token"))
    frequency = exploded.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("n"))
    rare_first = (exploded.join(frequency, ["scope", "token"])
                  .groupBy("scope", "name")
                  .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("_r"))
                  .select("scope", "name", F.col("_r.token").alias("rare")))
    sized = reliable_checkpoint(
        base.drop("tokens").join(rare_first, ["scope", "name"])
        .withColumns({"size": F.size("rare"), "mask": antonym_mask(F.col("rare")), "letters": letter_counts(F.col("name"))}))

    single = F.when(F.col("size") + 1 <= single_limit,
                    F.transform("rare", lambda x: F.array(x))).otherwise(
                        F.array().cast("array<array<string>>"))
    prefix_length = F.least(
        F.col("size"), F.col("size") - F.ceil(F.col("size") * F.lit(t) - 1e-9) + 2).cast("int")
    prefix = F.slice("rare", 1, F.greatest(prefix_length, F.lit(0)))
    double = F.flatten(F.transform(prefix, lambda x, i: F.transform(
        F.slice(prefix, i + 2, F.greatest(prefix_length - i - 1, F.lit(0))),
        lambda y: F.array(x, y))))
    keyed = sized.select("*", F.explode(F.concat(single, double)).alias("key"))

    blocks = (keyed.groupBy("scope", "key").agg(F.count(F.lit(1)).alias("rows"))
              .filter("rows > 1")
              .withColumn("salts", F.ceil(F.col("rows") / block_rows).cast("int")))
    members = keyed.join(blocks.drop("rows"), ["scope", "key"])
    left = members.withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int"))
    right = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    a, b = left.alias("a"), right.alias("b")
    size_a, size_b = F.col("a.size"), F.col("b.size")
    length_a, length_b = F.length("a.name"), F.length("b.name")
    best_ratio = RATIO_WEIGHT * 2 * F.least(length_a, length_b) / (length_a + length_b)
    best_jaccard = JACCARD_WEIGHT * F.least(size_a, size_b) / F.greatest(size_a, size_b)
    # Numbers only: cheap limits in the join, before any array is compared.
    pairs = a.join(
        b,
        (F.col("a.scope") == F.col("b.scope")) & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.seen") < F.col("b.seen"))
        & (best_jaccard + best_ratio >= floor - 1e-9)
        & ~antonym_conflict(F.col("a.mask"), F.col("b.mask"))
    ).select(F.col("a.scope").alias("scope"), F.col("a.name").alias("name_a"),
             F.col("b.name").alias("name_b"), F.col("a.key").alias("key"),
             (size_a + size_b).alias("sizes"), best_ratio.alias("best_ratio"),
             F.col("a.letters").alias("letters_a"), F.col("b.letters").alias("letters_b"),
             F.array_intersect("a.rare", "b.rare").alias("shared"))
    n_shared = F.size("shared")
    n_either = F.col("sizes") - n_shared
    # One block per pair: the single shared token, or the two rarest shared tokens.
    own_block = F.when(
        F.size("key") == 1, (n_shared == 1) & (F.col("sizes") <= single_limit),
    ).otherwise((n_shared >= 2) & (F.slice("shared", 1, 2) == F.col("key")))
    kept = pairs.filter(own_block & (
        JACCARD_WEIGHT * n_shared / n_either + F.col("best_ratio") >= floor - 1e-9))
    bound = ratio_bound(F.col("letters_a"), F.col("letters_b"), F.length("name_a"), F.length("name_b"))
    limited = kept.select("scope", "name_a", "name_b", n_shared.alias("shared"), n_either.alias("either"), bound.alias("bound"))
    return limited.filter(JACCARD_WEIGHT * F.col("shared") / F.col("either") + RATIO_WEIGHT * F.col("bound") >= floor - 1e-9)


def similar_names(names: DataFrame, least_score: float = CONFIRM,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of names in one scope that reach ``least_score`` (rounded to 3 digits):
    ``(scope, name_a, name_b, score, rounded, label)``. Only candidates that can reach it cost
    a string comparison."""
    found = spread_groups(candidate_pairs(names, least_score, block_rows), ["scope", "name_a", "name_b"])
    scored = found.select("scope", "name_a", "name_b",
                          _score(F.col("name_a"), F.col("name_b"), F.col("shared"), F.col("either")).alias("s"))
    return (scored.select("scope", "name_a", "name_b", "s.score", "s.rounded",
                          F.when(F.col("s.score") >= AUTO_MERGE, "auto_merge")
                          .when(F.col("s.score") >= REVIEW, "review").alias("label"))
            .filter(F.col("label").isNotNull() & (F.col("rounded") >= least_score)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(scope, name, label): the smallest name of each component, for names with an edge."""
    return star_components(edges, ["scope"], "name_a", "name_b").select(
        "scope", F.col("node").alias("name"), F.col("root").alias("label"))


def merge_names(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, name, canonical, n_runs, group_size, conflict_in_group) for every name.

    The canonical name is seen in most runs; ties go to the shorter, then the earlier.
    ``conflict_in_group`` flags groups that joined antonyms through a third name.
    """
    labels = connected_components(edges)
    grouped = (counts.join(labels, ["scope", "name"], "left")
               .withColumn("label", F.coalesce("label", "name")))
    tokens = F.split("name", "_")
    sides = [F.array_join(F.array_sort(F.array_intersect(
        tokens, F.array(*[F.lit(w) for w in group]))), ",") for group in ANTONYMS]
    sides = [F.when(s != "", s) for s in sides]
    conflict = F.lit(False)
    for s in sides:
        conflict = conflict | F.coalesce(F.min(s) != F.max(s), F.lit(False))
    chosen = grouped.groupBy("scope", "label").agg(
        F.min_by("name", F.struct(-F.col("n_runs"), F.length("name"), "first_run", "first_ord"))
        .alias("canonical"),
        F.count(F.lit(1)).alias("group_size"), conflict.alias("conflict_in_group"))
    return grouped.join(chosen, ["scope", "label"]).select(
        "scope", "name", "canonical", "n_runs", "group_size", "conflict_in_group")
