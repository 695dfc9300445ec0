"""Mixing to target weights: iterative proportional fitting on source, language and topic, then sampling.

Tokens are summed per (source, language, topic) cell. Each round scales the cells' weights to the
targets of one margin after another; the factor of a cell over its own tokens, divided by the
largest factor of all cells, is the probability with which each of its documents stays. So the
expected tokens keep the raked mix exactly, whatever the cells' sizes, and no document is repeated;
a scarce value with a large target makes the sample small. margins() sets the expected and the kept
shares beside the targets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import cut, parts_counted

OTHER = "other"
MARGINS = ("source", "lang", "topic")
GROUPS = [f"g_{m}" for m in MARGINS]
Targets = dict[str, dict[str, float]]
GAPS = r"[\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    return parts_counted(text, GAPS)


def form_of(text: Column) -> Column:
    """A topic for tables without one: the form of the text."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(text.contains(" | "), "table")
        .when(F.length(text) < 1500, "short")
        .otherwise("long")
    )


def uniform(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from a hash of the keys: the same for a row wherever it stands."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def grouped(docs: DataFrame, targets: Targets) -> DataFrame:
    """docs with g_<margin>: the value if the targets name it, else 'other' (null too)."""
    named = {m: [F.lit(x) for x in targets[m] if x != OTHER] for m in MARGINS}
    return docs.withColumns({f"g_{m}": F.when(F.col(m).isin(*named[m]), F.col(m)).otherwise(OTHER) if named[m] else F.lit(OTHER) for m in MARGINS})


def rake(cells: DataFrame, targets: Targets, rounds: int = 20) -> DataFrame:
    """cells (g_source, g_lang, g_topic, tokens) with weight: the raked share of all tokens.

    A target whose value has no tokens is left out and the others of its margin grow; a value
    without a target gets none. The cells are at most the product of the targets' counts plus one
    each, whatever the number of documents, so a single task's windows hold them.
    """
    out = cells.coalesce(1).withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        goal = F.lit(0.0)
        for value, share in sorted(targets[m].items()):
            goal = F.when(F.col(f"g_{m}") == value, float(share)).otherwise(goal)
        out = out.withColumn(f"t_{m}", goal)
    for _ in range(rounds):
        for m in MARGINS:
            own = F.sum("weight").over(Window.partitionBy(f"g_{m}"))
            out = out.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"t_{m}") / own).otherwise(0.0))
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0)).drop(*[f"t_{m}" for m in MARGINS])


def calibrated(docs: DataFrame, targets: Targets, rounds: int = 20) -> DataFrame:
    """A row per cell of docs (source, lang, topic, tokens): tokens, n_docs, weight, probability.

    A cell without tokens keeps all its documents: they weigh nothing in the mix.
    """
    cells = cut(grouped(docs.select(*MARGINS, "tokens"), targets).groupBy(*GROUPS).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("n_docs")))
    out = rake(cells, targets, rounds)
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    top = F.max(factor).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).when(top > 0, F.round(factor / top, 9)).otherwise(1.0))


def mix(docs: DataFrame, targets: Targets, seed: str = "mix", rounds: int = 20, id_col: str = "doc_id") -> DataFrame:
    """docs (with source, lang, topic, tokens) with g_<margin>, probability and kept; columns of these names are replaced.

    Rows with one id share their fate; null tokens count as none, and an empty table gives no rows.
    The cells' table is bounded by the targets (see rake) and so broadcast: documents are not shuffled.
    """
    docs = docs.drop(*GROUPS, "probability", "kept")
    cells = cut(calibrated(docs, targets, rounds).select(*GROUPS, "probability"))
    out = grouped(docs, targets).join(F.broadcast(cells), GROUPS).select(*docs.columns, *GROUPS, "probability")
    return out.withColumn("kept", uniform(seed, id_col) < F.col("probability"))


def margins(mixed: DataFrame, targets: Targets) -> DataFrame:
    """margin, value, wanted, expected, kept: of mix()'s rows, the shares of tokens by target, by probability and in the sample."""
    rows = mixed.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"g_{m}").alias("value")) for m in MARGINS])).alias("x"), "tokens", "probability", "kept")
    sums = rows.groupBy("x.margin", "x.value").agg(F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("k"))
    wanted = F.lit(0.0)
    for m in MARGINS:
        for value, share in sorted(targets[m].items()):
            wanted = F.when((F.col("margin") == m) & (F.col("value") == value), float(share)).otherwise(wanted)
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("margin")), F.lit(0))
    return sums.select("margin", "value", wanted.alias("wanted"), share("e").alias("expected"), share("k").alias("kept"))
