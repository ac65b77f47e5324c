"""Temperature mixing of sources (operator 5, DataFrame functions only).

A source's weight is its token share to the power ``alpha``, normalised. ``alpha`` = 1 keeps the natural
mixture, 0 makes sources equal. It is bisected, several points a step, to the point nearest 1 that meets a
target entropy (nats), or to the smallest that keeps every source within ``max_repeat`` passes. A source's
tokens are then taken as whole blocks (seeded permutations of all its rows) and a last partial
block: the rows, in the permutation's order, whose running tokens stay within the rest of its budget.

Without a ``budget`` (tokens) it is the least that takes every source once: nothing is dropped, small
sources repeat. Null sources are one source. A source without tokens (empty or null texts only) has no weight
and is taken once. Equal ids share a place in the permutation and come or stay out together. No rows: none.

Texts are not shuffled: rows are compared with their source's cut in the permutation, found from token sums
per hash bucket and, in the one bucket where the budget ends, per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaic.llm.graph import free_names, small_side
from voltaic.llm.ranks import bucket_count, bucket_of, rank_in_groups, seeded
from voltaic.session import cut_lineage

POINTS = 16           # exponents tried at once in a bisection step
STEPS = 8             # 16**8 parts of [0, 1]


def n_tokens(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def source_key(col):
    return F.when(F.col(col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(col)))


def bisect_exponent(totals: DataFrame, max_repeat: float | None, target_entropy: float | None,
                    budget: int | None) -> float:
    """The exponent for (src, tokens) totals; only one number a step comes to the driver."""
    t = totals.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        step = (hi - lo) / POINTS
        powers = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS))))
        powers = powers.withColumn("p", F.pow("t", F.lit(lo) + F.col("i") * F.lit(step)))
        # a source's passes, p * budget / (t * sum(p)); the least budget takes the rarest drawn source once
        sums = powers.groupBy("i").agg(
            F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"),
            F.max(F.col("p") / F.col("t")).alias("most"), F.min(F.col("p") / F.col("t")).alias("least"))
        if target_entropy is not None:
            ok = (F.log("z") - F.col("plogp") / F.col("z")) >= F.lit(target_entropy)      # falls with alpha
            best = sums.where(ok).agg(F.max("i")).first()[0]
            at = 0 if best is None else best
            lo, hi = lo + at * step, lo + min(at + 1, POINTS) * step
        else:
            passes = (F.col("most") / F.col("least") if budget is None
                      else F.col("most") * F.lit(float(budget)) / F.col("z"))
            best = sums.where(passes <= F.lit(max_repeat)).agg(F.min("i")).first()[0]     # falls with alpha
            at = POINTS if best is None else best
            lo, hi = lo + max(at - 1, 0) * step, lo + at * step
        if hi <= lo:
            break
    return lo if target_entropy is not None else hi


def source_plan(docs: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None,
                budget: int | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """Per source (src, tokens, weight, passes, full, cut): whole blocks and the last hash of the partial one."""
    rows = cut_lineage(docs.select(source_key(source_col).alias("src"), n_tokens(F.col(text_col)).alias("tokens"),
                                   seeded(seed, id_col).alias("h")), "mix-rows")
    buckets = bucket_count(rows.count())
    sums = cut_lineage(rows.withColumn("b", bucket_of("h", buckets)).groupBy("src", "b")
                       .agg(F.sum("tokens").alias("tokens")), "mix-sums")
    totals = cut_lineage(sums.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    alpha = bisect_exponent(totals, max_repeat, target_entropy, budget)
    p = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    norm = totals.where("tokens > 0").agg(F.sum(p).alias("z"), F.min(p / F.col("tokens")).alias("least")).first()
    z, least = norm["z"] or 1.0, norm["least"] or 1.0
    spend = z / least if budget is None else float(budget)
    passes = F.round(p / F.lit(z) * F.lit(spend) / F.col("tokens"), 9)
    shares = (totals
              .withColumn("weight", F.when(F.col("tokens") > 0, p / F.lit(z)).otherwise(0.0))
              .withColumn("passes", F.when(F.col("tokens") > 0, passes).otherwise(1.0))
              .withColumn("full", F.floor("passes").cast("int"))
              .withColumn("rest", F.floor((F.col("passes") - F.col("full")) * F.col("tokens")).cast("long"))
              .select("src", "tokens", "weight", "passes", "full", "rest"))
    shares = cut_lineage(shares, "mix-shares")
    run = Window.partitionBy("src").orderBy("b")
    ends = (sums.withColumnRenamed("tokens", "in_bucket").withColumn("upto", F.sum("in_bucket").over(run))
            .join(shares.select("src", "rest"), "src").where("upto > rest")
            .groupBy("src").agg(F.min(F.struct("b", F.expr("rest - upto + in_bucket").alias("left"))).alias("e"))
            .select("src", F.col("e.b").alias("b"), F.col("e.left").alias("left")))
    ends = cut_lineage(ends, "mix-ends")
    by_row = Window.partitionBy("src").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # rows of the one bucket per source where its budget ends
    edge = (rows.withColumn("b", bucket_of("h", buckets)).join(small_side(ends), ["src", "b"])
            .withColumn("run", F.sum("tokens").over(by_row)).where("run <= left").groupBy("src")
            .agg(F.max("h").alias("last")))
    below = rows.withColumn("b", bucket_of("h", buckets)).join(small_side(
        ends.select("src", F.col("b").alias("end"))), "src").where("b < end").groupBy("src").agg(F.max("h").alias("before"))
    return cut_lineage(shares.join(ends, "src", "left").join(edge, "src", "left")
                       .join(below, "src", "left").select(
        "src", "tokens", "weight", "passes", "full",
        F.when(F.col("rest") == 0, F.lit(-1)).otherwise(F.coalesce("last", "before", F.lit(-1))).cast("long").alias("cut")),
        "mix-plan")


def mix_sources(docs: DataFrame, plan: DataFrame, seed: str = "mix", id_col: str = "doc_id",
                source_col: str = "source", epoch: str = "epoch") -> DataFrame:
    """Every row of ``docs`` once per block that takes it, with the block's number in ``epoch``."""
    src, full, cut, key, taken, block = free_names(docs, "_src", "_full", "_cut", "_key", "_taken", "_block")
    cuts = small_side(plan.select(F.col("src").alias(src), F.col("full").alias(full), F.col("cut").alias(cut)))
    times = F.col(full) + (seeded(seed, id_col) <= F.col(cut)).cast("int")
    return (docs.withColumn(key, source_key(source_col)).join(cuts, F.col(key) == F.col(src))
            .withColumn(taken, times).where(F.col(taken) > 0)
            .withColumn(block, F.explode(F.sequence(F.lit(1), F.col(taken))))
            .select(*[c for c in docs.columns if c != epoch], F.col(block).alias(epoch)))


def block_positions(mixed: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", epoch: str = "epoch") -> DataFrame:
    """(id, source, epoch, tokens, position): the place of a row in its block's own permutation."""
    rows = cut_lineage(mixed.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(epoch).alias("block"),
        source_key(source_col).alias("src"), n_tokens(F.col(text_col)).alias("tokens"),
        seeded(seed, F.col(epoch), F.col(id_col)).alias("h")), "mix-blocks")
    ranked = rank_in_groups(rows, ["src", "block"], "h", ["id", "tokens"], bucket_count(rows.count()),
                            "position", "of")
    return ranked.select(F.col("id").alias(id_col), F.col("source").alias(source_col),
                         F.col("block").alias(epoch), "tokens", "position")
