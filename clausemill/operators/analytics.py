"""What is reported from readings: tallies, checklists, runs of highlights, agreement of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAVOURS = ("you", "them", "neutral", "unclear")
GROUPS = ("them", "unclear", "you", "neutral")


def tally(labels: DataFrame, keys: list[str], favours_col: str = "favours") -> DataFrame:
    """Clauses by label, with a column for each of the four labels."""
    return labels.groupBy(*keys).agg(*[F.count_if(F.col(favours_col) == f).alias(f"n_{f}") for f in FAVOURS])


def checklist(findings: DataFrame, id_col: str = "doc_id", shown: int = 3) -> DataFrame:
    """Of each document and rule: number of clauses, the first `shown` of them, and the rule's place in the document."""
    by_rule = findings.groupBy(id_col, "rule_id", "topic", "favours").agg(F.sort_array(F.collect_set("clause_id")).alias("ids"), F.min(F.struct("clause_id", "rn")).alias("place"))
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("place.clause_id", "place.rn"))
    return by_rule.select(id_col, "rule_id", "topic", "favours", F.size("ids").alias("n_clauses"), F.array_join(F.slice("ids", 1, shown), ",").alias("first_ids"), order.alias("place"))


def never_found(catalogue: DataFrame, findings: DataFrame, favours: str = "them") -> DataFrame:
    """Rules of one side that no finding has."""
    return catalogue.where(F.col("favours") == favours).join(findings.select("rule_id").distinct(), "rule_id", "left_anti")


def unlabelled(clauses: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Clauses without a reading."""
    return clauses.join(labels.select(*keys).distinct(), keys, "left_anti")


def agreement(hand: DataFrame, found: DataFrame, keys: list[str], hand_labels: list, found_labels: list, missing: str = "none") -> DataFrame:
    """Confusion of hand labels (rows) with found ones (columns), with totals in a last row of label `all`."""
    both = hand.join(found, keys, "left").withColumn("found", F.coalesce("found", F.lit(missing)))
    cells = [F.count_if(F.col("found") == f).alias(f"n_{f}") for f in [*found_labels, missing]]
    return both.where(F.col("hand").isin(*hand_labels)).rollup("hand").agg(*cells, F.count(F.lit(1)).alias("total")).withColumn("hand", F.coalesce("hand", F.lit("all")))


def highlight_runs(ranges: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Runs [start, end) of one mark that cover each range: where marks overlap the one of the lowest number wins, -1 is none.

    ranges: keys, start, end. marks: keys, mark, start, end. Every border is a
    cut; each stretch between cuts takes its mark, and equal neighbours merge.
    """
    inside = marks.join(ranges.select(*keys, F.col("start").alias("_lo"), F.col("end").alias("_hi")), keys)
    inside = inside.select(*keys, "mark", F.greatest("start", "_lo").alias("s"), F.least("end", "_hi").alias("e")).where("s < e")
    cuts = ranges.select(*keys, F.explode(F.array("start", "end")).alias("at")).union(inside.select(*keys, F.explode(F.array("s", "e")).alias("at"))).distinct()
    by_place = Window.partitionBy(*keys).orderBy("at")
    stretches = cuts.withColumn("to", F.lead("at").over(by_place)).where(F.col("to").isNotNull())
    marked = stretches.join(inside.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("s") <= F.col("at"), F.col("to") <= F.col("e")], "left")
    one = marked.groupBy(*keys, "at", "to").agg(F.coalesce(F.min("mark"), F.lit(-1)).alias("mark"))
    new = F.when(F.lag("mark").over(by_place) == F.col("mark"), 0).otherwise(1)
    runs = one.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by_place))
    return runs.groupBy(*keys, "_run", "mark").agg(F.min("at").alias("start"), F.max("to").alias("end")).select(*keys, "start", "end", "mark")


def next_with(labelled: DataFrame, keys: list[str], at: Column, id_col: str = "clause_id") -> DataFrame:
    """Of each group the next clause after `at`, or else the first."""
    return labelled.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(id_col) > at, F.col(id_col))), F.min(id_col)).alias("next_id"))


def paragraph_gaps(segments: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Line breaks between each segment and the one before (0 for the first)."""
    order = Window.partitionBy(id_col).orderBy("start")
    rows = segments.withColumn("_before", F.lag("end").over(order)).join(docs.select(F.col(id_col), F.col("text").alias("_t")), id_col)
    gap = F.substring("_t", F.col("_before").cast("int") + 1, (F.col("start") - F.col("_before")).cast("int"))
    return rows.withColumn("breaks", F.coalesce(F.regexp_count(gap, F.lit("\n")), F.lit(0))).drop("_before", "_t")
