"""Line dedup by log templates (operator 2, DataFrame functions only).

A fixed-depth tree sorts lines: the first level is the number of tokens, the next ``DEPTH`` levels are the
leading tokens; tokens with a digit count as a variable field everywhere. The lines of a leaf are
generalised: at every further position the token of at least half of the leaf's variants is constant, the
others are fields. A variant that agrees with ``SIMILAR`` of the leaf's tokens takes the leaf's
template, any other is its own. Lines whose template occurs in ``min_texts`` different texts are dropped.

Lines are parted by newlines; lines with fewer than ``MIN_TOKENS`` tokens are never judged. Exact copies of
a text count once. Null text stays null with no lines; a text all of whose lines go becomes empty. Other
columns are kept, but for input columns named ``n_lines`` or ``n_dropped``, which give way. No whole group meets in one task: counts are aggregated before they are shuffled, and a
line reaches the shuffles as hashes unless its leaf is shared by ``min_texts`` texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm.graph import free_names, small_side
from voltaic.session import cut_lineage

DEPTH = 3
MIN_TOKENS = 3
SIMILAR = 0.7


def masked(line: Column) -> Column:
    """The line's tokens, one space apart, with variable fields replaced. Each pattern runs only over lines
    that need it and never goes back over a token."""
    line = F.trim(line)
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0B\f\r":
        odd = odd | F.contains(line, F.lit(c))
    line = F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]++", " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def tokens_of(form: Column) -> Column:
    return F.octet_length(form) - F.octet_length(F.replace(form, F.lit(" "), F.lit(""))) + F.when(form == "", 0).otherwise(1)


def leaf_of(form: Column) -> Column:
    return F.xxhash64(tokens_of(form), F.substring_index(form, " ", DEPTH))


def recurring_forms(docs: DataFrame, text_col: str, min_texts: int) -> tuple[DataFrame, DataFrame]:
    """(line forms of every text as hashes; hashes of the forms whose template recurs)."""
    lines = (docs.where(F.col(text_col).isNotNull())
             .select(F.xxhash64(text_col).alias("key"),
                     F.explode(F.split(text_col, "\n")).alias("line"))
             # one-element explode: the masked line is computed once and not again in every later expression
             .select("key", F.explode(F.array(masked(F.col("line")))).alias("form")).where(tokens_of(F.col("form")) >= MIN_TOKENS))
    hashed = cut_lineage(lines.select("key", leaf_of(F.col("form")).alias("leaf"), F.xxhash64("form").alias("f"))
                         .distinct(), "line-forms")
    per_leaf = hashed.select("leaf", "key").distinct().groupBy("leaf").agg(F.count("*").alias("texts"))
    busy = cut_lineage(per_leaf.where(F.col("texts") >= min_texts).select("leaf"), "line-leaves")

    variants = cut_lineage(lines.withColumn("leaf", leaf_of(F.col("form"))).join(small_side(busy), "leaf")
                           .select("leaf", "form").distinct(), "line-variants")
    counts = variants.groupBy("leaf").agg(F.count("*").alias("variants"))
    words = (variants.join(counts.where("variants > 1"), "leaf")
             .select("leaf", "variants", F.xxhash64("form").alias("f"), F.posexplode(F.split("form", " ")).alias("pos", "word"))
             .where(F.col("pos") >= DEPTH))
    common = (words.groupBy("leaf", "pos", "word", "variants").agg(F.count("*").alias("n"))
              .where(F.col("n") * 2 >= F.col("variants")).groupBy("leaf", "pos")
              .agg(F.min(F.struct(-F.col("n"), F.col("word"))).alias("best"))
              .select("leaf", "pos", F.col("best.word").alias("word")))
    agrees = (words.join(common, ["leaf", "pos", "word"]).groupBy("leaf", "f").agg(F.count("*").alias("agree")))
    mapped = variants.select("leaf", F.xxhash64("form").alias("f"), tokens_of(F.col("form")).alias("tokens")).join(
        agrees, ["leaf", "f"], "left")
    general = (F.coalesce("agree", F.lit(0)) + F.least("tokens", F.lit(DEPTH))) >= F.lit(SIMILAR) * F.col("tokens")
    mapped = cut_lineage(mapped.select("leaf", "f", F.when(general, F.col("leaf")).otherwise(F.col("f")).alias("template"),
                                       general.alias("general")), "line-templates")
    seen = hashed.join(mapped, ["leaf", "f"])
    recur = (seen.select("general", "template", "key").distinct().groupBy("general", "template")
             .agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts).drop("texts"))
    return hashed, cut_lineage(mapped.join(recur, ["general", "template"]).select("f").distinct(), "line-dropped")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", min_texts: int = 5) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text_col``, and ``n_lines``, ``n_dropped``."""
    hashed, dropped = recurring_forms(docs, text_col, min_texts)
    key, gone, kept = free_names(docs, "_key", "_gone", "_kept")
    per_text = (hashed.select("key", "f").join(dropped, "f").groupBy(F.col("key").alias(key))
                .agg(F.collect_set("f").alias(gone)))
    per_text = cut_lineage(per_text, "line-gone")
    lines = F.split(F.col(text_col), "\n")
    stays = lambda x: ~F.array_contains(F.col(gone), F.xxhash64(masked(x)))
    rows = docs.withColumn(key, F.xxhash64(text_col)).join(small_side(per_text), key, "left")
    rows = rows.withColumn(kept, F.when(F.col(gone).isNull(), lines).otherwise(F.filter(lines, stays)))
    null = F.col(text_col).isNull()
    n, left = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(kept), F.lit(0))
    rows = rows.withColumn("n_lines", F.when(null, 0).otherwise(n)).withColumn(
        "n_dropped", F.when(null, 0).otherwise(n - left))
    return rows.withColumn(text_col, F.when(~null, F.array_join(kept, "\n"))).select(
        *[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
