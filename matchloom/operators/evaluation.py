"""Recall of candidates, entity-level F0.5, thresholds, errors and curves.

Truth is a table of links (q_id, c_id); ``entities`` (q_id) names everything
that is judged, with links or without. Scored pairs have ``probability`` and
``label``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored

BETA2 = 0.25


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The pairs with label 1 if they are links, else 0."""
    links = truth.select("q_id", "c_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(links, ["q_id", "c_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def hardness(pairs: DataFrame) -> Column:
    """Best retrieval score, and a little for every channel that found the pair."""
    scores = [F.col(f"{c}_retrieval_score") for c in ("name", "address", "structured")]
    flags = [F.col(f"from_{c}_blocker") for c in ("name", "address", "structured", "embedding")]
    return F.greatest(*scores) + 0.05 * sum(flags[1:], flags[0])


def mined(pairs: DataFrame, keep: int = 20) -> DataFrame:
    """All positives and the hardest ``keep`` negatives of every training query; everything of validation queries. Needs label and split."""
    return marked(pairs, F.lit(True), keep).where("kept").drop("kept")


def marked(pairs: DataFrame, among: Column, keep: int = 20) -> DataFrame:
    """All pairs with their hardness, and ``kept``: whether ``mined`` keeps the pair if it has only those that meet ``among``."""
    order = Window.partitionBy("q_id", "label", "__among").orderBy(F.col("hardness").desc(), "c_id")
    ranked = pairs.withColumns({"hardness": F.round(hardness(pairs), 6), "__among": among}).withColumn("nth", F.row_number().over(order))
    stays = F.col("__among") & ((F.col("split") == "val") | (F.col("label") == 1) | (F.col("nth") <= keep))
    return ranked.withColumn("kept", stays).drop("nth", "__among")


def batch_statistics(pairs: DataFrame, keep: int = 20) -> DataFrame:
    """Per country and split: candidates, those that mining keeps, positives and queries. Needs label, split and country."""
    order = Window.partitionBy("q_id", "label").orderBy(F.round(hardness(pairs), 6).desc(), "c_id")
    ranked = pairs.withColumn("nth", F.row_number().over(order))
    stays = (F.col("split") == "val") | (F.col("label") == 1) | (F.col("nth") <= keep)
    return ranked.groupBy("country", "split").agg(
        F.count("*").alias("candidates"), F.count_if(stays).alias("kept"), F.sum("label").alias("positives"), F.countDistinct("q_id").alias("queries")
    )


def recall(entities: DataFrame, truth: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = ()) -> DataFrame:
    """Per K (of the candidates' rank; -1: all): links, links found, recall, candidates per entity, entities found in full, in part and not at all."""
    grid = F.explode(F.array(*[F.lit(k) for k in (*ks, -1)])).alias("k")
    within = (F.col("k") < 0) | (F.col("rank") <= F.col("k"))
    ranked = candidates if "rank" in candidates.columns else candidates.withColumn("rank", F.lit(1))
    some = ranked.select("q_id", "c_id", "rank").groupBy("q_id", "c_id").agg(F.min("rank").alias("rank"))
    links = truth.select("q_id", "c_id").distinct().join(entities.select("q_id").distinct(), "q_id", "left_semi")
    found = links.join(some, ["q_id", "c_id"], "left").select("*", grid).groupBy("k", "q_id").agg(
        F.count("*").alias("links"), F.count_if(F.col("rank").isNotNull() & within).alias("found")
    )
    size = some.join(entities.select("q_id").distinct(), "q_id", "left_semi").select("*", grid).groupBy("k").agg(F.count_if(within).alias("candidates"))
    n = entities.select("q_id").distinct().count()
    per = found.groupBy("k").agg(
        F.sum("links").alias("links"),
        F.sum("found").alias("found"),
        F.count_if(F.col("found") == F.col("links")).alias("full"),
        F.count_if((F.col("found") > 0) & (F.col("found") < F.col("links"))).alias("partial"),
        F.count_if(F.col("found") == 0).alias("none"),
    )
    return per.join(size, "k", "left").select(
        "k", "links", "found", F.round(F.col("found") / F.col("links"), 6).alias("recall"),
        F.round(F.coalesce(F.col("candidates"), F.lit(0)) / F.lit(n), 6).alias("average_candidates"), "full", "partial", "none",
    )


def candidate_counts(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Total, mean, median, 95th and 99th percentile and most candidates of an entity, those with none included."""
    per = entities.select("q_id").distinct().join(candidates.select("q_id", "c_id").distinct().groupBy("q_id").agg(F.count("*").alias("n")), "q_id", "left").fillna({"n": 0})
    at = lambda p: F.round(F.percentile("n", p), 6)
    return per.agg(
        F.sum("n").alias("candidates"), F.round(F.avg("n"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
        F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("without"),
    )


def missed(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    return truth.select("q_id", "c_id").distinct().join(candidates.select("q_id", "c_id"), ["q_id", "c_id"], "left_anti")


def contributions(truth: DataFrame, merged: DataFrame) -> DataFrame:
    """Per channel: pairs, links found, and links that no other channel finds."""
    flags = [c for c in merged.columns if c.startswith("from_")]
    total = sum((F.col(c) for c in flags[1:]), F.col(flags[0]))
    marked = labelled(merged.withColumn("__channels", total), truth)
    long = marked.select("label", "__channels", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("on")) for c in flags])).alias("x"))
    return long.where("x.on = 1").groupBy("x.channel").agg(
        F.count("*").alias("pairs"), F.sum("label").alias("links"), F.count_if((F.col("label") == 1) & (F.col("__channels") == 1)).alias("only_here")
    )


def f_half(tp: Column, fp: Column, fn: Column) -> Column:
    """F0.5 of one entity; 1 if it has neither links nor matches."""
    below = (1 + BETA2) * tp + BETA2 * fn + fp
    return F.when(below == 0, F.lit(1.0)).otherwise((1 + BETA2) * tp / below)


def entity_scores(entities: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: mean F0.5 over all entities, and the sums of true, false and missed matches.

    Entities without candidates count: 0, or 1 if they have no links either. Pairs
    and entities are counted by how many thresholds they reach, so that no pair and
    no entity is repeated for every threshold before the last sums.
    """
    return scores_of(entities, truth, labelled(scored, truth), thresholds)


def scores_of(entities: DataFrame, truth: DataFrame, pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """``entity_scores`` of labelled pairs."""
    levels = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    reached = sum((F.when(F.col("probability") >= t, 1).otherwise(0) for t in sorted(set(thresholds))), F.lit(0))
    known = truth.select("q_id", "c_id").distinct().groupBy("q_id").agg(F.count("*").alias("links"))
    steps = (
        pairs.select("q_id", "label", reached.alias("at")).where("at > 0")
        .groupBy("q_id", "at").agg(F.sum("label").alias("tp"), F.sum(1 - F.col("label")).alias("fp"))
        .groupBy("q_id").agg(F.collect_list(F.struct("at", "tp", "fp")).alias("steps"))
    )
    every = entities.select("q_id").distinct().join(known, "q_id", "left").join(steps, "q_id", "left")
    total = lambda field: F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, s: n + F.when(s["at"] > F.col("place"), s[field]).otherwise(0))
    per = every.select(F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("steps", F.array().cast("array<struct<at:int,tp:bigint,fp:bigint>>")).alias("steps"), F.posexplode(levels).alias("place", "threshold"))
    per = per.select("links", "threshold", total("tp").alias("tp"), total("fp").alias("fp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("links") - F.col("tp")
    return per.groupBy("threshold").agg(
        F.round(F.avg(f_half(tp, fp, fn)), 6).alias("f_half"), F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn")
    )


def grid(low: float, high: float, step: float) -> list[float]:
    return [round(low + i * step, 6) for i in range(int(round((high - low) / step)) + 1)]


def best_threshold(scores: DataFrame) -> tuple[float, float]:
    """Threshold with the largest score, the smallest of equals."""
    row = scores.orderBy(F.col("f_half").desc(), "threshold").first()
    return row["threshold"], row["f_half"]


def search_threshold(entities: DataFrame, truth: DataFrame, scored: DataFrame) -> tuple[float, float]:
    """Coarse grid over (0, 1), then a fine one around its best."""
    pairs = stored(labelled(scored, truth).select("q_id", "label", "probability"))
    coarse, _ = best_threshold(scores_of(entities, truth, pairs, grid(0.05, 0.95, 0.025)))
    fine = [t for t in grid(coarse - 0.04, coarse + 0.04, 0.002) if 0 < t < 1]
    return best_threshold(scores_of(entities, truth, pairs, fine))


def oracle(entities: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """What a perfect classifier of the candidates would score: F0.5 and recall."""
    perfect = labelled(candidates.select("q_id", "c_id").distinct(), truth).where("label = 1").withColumn("probability", F.lit(1.0))
    best = entity_scores(entities, truth, perfect.drop("label"), [0.5])
    return best.select("f_half", "tp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"))


def outcome(threshold: float) -> Column:
    said = F.col("probability") >= threshold
    return F.when(said & (F.col("label") == 1), "TP").when(said, "FP").when(F.col("label") == 1, "FN").otherwise("TN")


def confusion(scored: DataFrame, threshold: float, near: float = 0.05, sure: float = 0.9) -> DataFrame:
    """Per outcome: pairs, pairs near the threshold, and pairs that the model was sure of."""
    p = F.col("probability")
    return scored.withColumn("outcome", outcome(threshold)).groupBy("outcome").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.abs(p - threshold) <= near).alias("near_threshold"),
        F.count_if((p >= sure) | (p <= 1 - sure)).alias("sure"),
    )


def error_profile(scored: DataFrame, threshold: float, features: list[str]) -> DataFrame:
    """Per outcome and feature: mean, quartiles and the share of pairs at 0 and at 1."""
    long = scored.withColumn("outcome", outcome(threshold)).select(
        "outcome", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("x")
    )
    v = F.col("x.v")
    at = lambda p: F.round(F.percentile(v, p), 6)
    return long.groupBy("outcome", "x.feature").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"),
        F.round(F.count_if(v == 0) / F.count("*"), 6).alias("at_zero"), F.round(F.count_if(v == 1) / F.count("*"), 6).alias("at_one"),
    )


def coverage(values: DataFrame, columns: list[str], levels: list[float]) -> DataFrame:
    """Share of rows at or above each level, per column."""
    long = values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    level = F.explode(F.array(*[F.lit(float(t)) for t in levels])).alias("level")
    return long.select("x.*", level).groupBy("column", "level").agg(F.round(F.avg((F.col("v") >= F.col("level")).cast("int")), 6).alias("share"))


def failure_buckets(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows per combination of named conditions, written name+name, ``other`` for none."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return rows.withColumn("bucket", F.when(F.size(names) == 0, "other").otherwise(F.array_join(names, "+"))).groupBy("bucket").agg(F.count("*").alias("n"))


def curves(scored: DataFrame) -> DataFrame:
    """ROC area (ties count half) and average precision, from running sums over the distinct scores."""
    by = scored.groupBy("probability").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    # Distinct scores can be many: they are added up in ranges of the score first, so no task holds all of them.
    spans = by.withColumn("__span", F.floor(F.col("probability") * 1024))
    inside = Window.partitionBy("__span").orderBy(F.col("probability").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(F.col("__span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy("__span").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    carried = sums.select("__span", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"))
    run = spans.join(F.broadcast(carried), "__span").select(  # 1025 spans at most
        "p", "n", (F.sum("p").over(inside) + F.col("bp")).alias("tp"), (F.sum("n").over(inside) + F.col("bn")).alias("fp")
    )
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / (F.sum("p") * F.sum("n"))
    precision = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")
    return run.agg(F.round(area, 6).alias("roc_auc"), F.round(precision, 6).alias("average_precision"))


def truth_by_source(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """Per country and which sources an entity has links in (their prefixes joined by +, none): entities, links, and the most links of one entity."""
    source = F.substring_index("c_id", "-", 1)
    per = truth.select("q_id", "c_id").distinct().groupBy("q_id").agg(F.count("*").alias("links"), F.array_join(F.array_sort(F.collect_set(source)), "+").alias("sources"))
    every = entities.join(per, "q_id", "left").fillna({"links": 0, "sources": "none"})
    return every.groupBy("country", "sources").agg(F.count("*").alias("entities"), F.sum("links").alias("links"), F.max("links").alias("most"))
