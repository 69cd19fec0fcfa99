"""Ranks, priority scores and hidden links. Scores are advisory and keep their factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import graph
from tessera.operators.ranking import percentile_rank
from tessera.storage import stored

# fixed values: weights of the priority factors
PRIORITY_WEIGHTS = {"degree": 0.24, "betweenness": 0.20, "interactions": 0.16, "money": 0.14, "cases": 0.12, "recency": 0.08, "locations": 0.06}


def endpoint_activity(relations: DataFrame, as_of: str, days: int = 45) -> DataFrame:
    """By entity at either end of relations that aren't rejected: counts, money, recent share, evidence."""
    live = relations.where("status <> 'REJECTED'")
    money = F.col("type") == "TRANSFERRED_MONEY"
    recent = F.col("seen_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    row = live.select("src", "dst", "rid", money.alias("money"), F.when(money, F.col("amount")).otherwise(0.0).alias("paid"), recent.alias("recent"))
    ends = row.withColumn("end", F.explode(F.array(F.struct(F.col("src").alias("uid"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("uid"), F.col("src").alias("other")))))
    # by pair first: the number of others is then a count of rows
    pair = ends.groupBy("end.uid", "end.other").agg(F.count("*").alias("n"), F.count_if("money").alias("payments"), F.sum("paid").alias("paid"), F.count_if("recent").alias("recent"), F.min("rid").alias("first_rid"))
    n = F.sum("n")
    share = F.when(n >= 2, F.sum("recent") / n).when(n == 1, 0.2).otherwise(0.0)
    return pair.groupBy("uid").agg(
        n.alias("interactions"),
        F.sum("payments").alias("payments"),
        F.sum("paid").alias("paid"),
        F.count("*").alias("others"),
        share.alias("recency"),
        F.min("first_rid").alias("first_rid"),
    )


def priority(entities: DataFrame, relations: DataFrame, cases: DataFrame, locations: DataFrame, as_of: str, sources: DataFrame | None = None) -> DataFrame:
    """(uid, score, band, confidence, factors) of active entities.

    cases: (uid, case_id) open ones; locations: (uid, location). sources: pivots for an estimated betweenness.
    """
    adj, nodes = stored(graph.adjacency(graph.project(entities, relations)), "adjacency"), entities.where("active").select("uid")
    degree = graph.degrees(nodes, adj)
    between = graph.betweenness(nodes, adj, sources)
    activity = endpoint_activity(relations, as_of)
    by_case = cases.groupBy("uid").agg(F.count_distinct("case_id").alias("n_cases"))
    by_place = locations.groupBy("uid").agg(F.count_distinct("location").alias("n_locations"))
    degree = percentile_rank(percentile_rank(degree, "centrality", "degree_rank"), "weighted", "weighted_rank")
    between = percentile_rank(between, "betweenness", "betweenness_rank")
    moved = percentile_rank(activity, "interactions", "interaction_rank")
    paid = percentile_rank(activity.where("payments > 0").select("uid", "paid"), "paid", "money_rank").select("uid", "money_rank")
    out = degree.join(between.hint("merge"), "uid")
    for more in (moved, paid, by_case, by_place):  # a row an entity, however small their files look
        out = out.join(more.hint("merge"), "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    values: dict[str, Column] = {
        "degree": F.col("degree_rank"),
        "betweenness": F.col("betweenness_rank"),
        "interactions": F.greatest(zero("interaction_rank"), 0.5 * F.col("weighted_rank")),
        "money": zero("money_rank"),
        "cases": F.least(F.lit(1.0), zero("n_cases") / 2),
        "recency": zero("recency"),
        "locations": F.least(F.lit(1.0), zero("n_locations") / 4),
    }
    factors = F.array(*(F.struct(F.round(F.lit(w) * values[k] * 100, 2).alias("contribution"), F.lit(k).alias("factor"), values[k].cast("double").alias("value")) for k, w in PRIORITY_WEIGHTS.items()))
    out = out.withColumn("factors", F.sort_array(factors, asc=False))
    score = F.round(F.aggregate("factors", F.lit(0.0), lambda a, f: a + f["contribution"]), 2)
    supporting = zero("interactions") + zero("n_cases") + zero("n_locations")
    confidence = F.least(F.lit(0.95), 0.35 + 0.05 * F.least(supporting, F.lit(12)))
    return out.select("uid", score.alias("score"), geo.band(score, geo.SCORE_BANDS, "LOW").alias("band"), confidence.alias("confidence"), "factors")


def hidden_links(entities: DataFrame, relations: DataFrame, least: float = 0.35, kinds: tuple[str, ...] = ("person", "organization")) -> DataFrame:
    """(a, b, shared, score, confidence): pairs that aren't linked but share neighbours, with the shared kinds weighed."""
    adj = stored(graph.adjacency(graph.project(entities, relations)), "adjacency")
    kind = entities.select("uid", "type")
    wanted = kind.where(F.col("type").isin(*kinds)).select(F.col("uid").alias("u"))
    degree = adj.groupBy(F.col("u").alias("mid")).agg(F.count("*").alias("degree"))
    one = lambda *types: F.col("type").isin(*types).cast("int")
    middles = degree.join(kind.withColumnRenamed("uid", "mid"), "mid").select(
        "mid", graph.rarity().alias("score"), one("person", "organization").alias("people"), one("transaction", "bank_account").alias("financial"), one("location").alias("places"),
    )
    grouped = graph.pair_sums(adj, adj.join(wanted, "u", "left_semi"), middles)
    cap = lambda c, k: F.least(F.lit(1.0), F.col(c) / k)
    confidence = F.least(F.lit(0.92), 0.30 * cap("score", 2) + 0.24 * cap("people", 2) + 0.18 * cap("financial", 2) + 0.12 * cap("places", 2) + 0.16 * cap("shared", 4))
    return grouped.withColumn("confidence", confidence).where(F.col("confidence") >= least).select("a", "b", "shared", "score", "confidence")


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)
