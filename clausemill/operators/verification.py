"""Quotes held against documents: a relational plan that places each quote in a clause or says why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What counts as evidence, and the labels an item may have.
EVIDENCE_CHARS, EVIDENCE_WORDS, READING_CHARS = 15, 3, 280
FAVOURS, CONFIDENCES = ("you", "them", "neutral", "unclear"), ("high", "medium", "low")
BLANK = r"^\s+|\s+$"


def clip(reading: Column) -> Column:
    """A reading on one line of at most 280 characters, cut at a space."""
    flat = F.regexp_replace(F.regexp_replace(reading, r"\s+", " "), BLANK, "")
    head = F.substring(flat, 1, READING_CHARS - 1)
    at = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(flat) <= READING_CHARS, flat).otherwise(F.concat(F.regexp_replace(cut, "[,;:]+$", ""), F.lit("…")))


def parsed_items(outputs: DataFrame, id_col: str = "doc_id", json_col: str = "output") -> DataFrame:
    """id, item_no, claimed_id, quote, favours, reading, confidence and malformed of every entry of {"clauses": [...]}.

    An output of another shape gives no rows. An id must be a JSON integer:
    true, 1.0 and "1" are malformed, though true is kept as a claim of 1.
    """
    parsed = F.try_parse_json(F.col(json_col))
    listed = F.try_variant_get(parsed, "$.clauses", "array<variant>")
    rows = outputs.select(id_col, F.posexplode(listed).alias("pos", "v"))
    v = F.col("v")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))

    whole = kind("$.id") == "BIGINT"
    claim = F.when(whole, F.try_variant_get(v, "$.id", "long")).when(kind("$.id") == "BOOLEAN", F.try_variant_get(v, "$.id", "boolean").cast("long"))
    text = {k: F.when(kind(f"$.{k}") == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in ("quote", "favours", "reading", "confidence")}
    good = whole & text["quote"].isNotNull() & F.coalesce(text["favours"].isin(*FAVOURS), F.lit(False)) & F.coalesce(text["confidence"].isin(*CONFIDENCES), F.lit(False))
    good = good & (F.length(F.regexp_replace(F.coalesce(text["reading"], F.lit("")), BLANK, "")) > 0)
    return rows.select(id_col, (F.col("pos") + 1).alias("item_no"), claim.alias("claimed_id"), *[c.alias(k) for k, c in text.items()], (~good).alias("malformed"))


def placed_quotes(items: DataFrame, docs: DataFrame, clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """items with clause_id, quote_start, quote_end, moved and reason (null if the quote stands).

    docs: id, text. clauses: id, clause_id, start, end, and body if it is there.
    The first reason that holds counts. A quote found once in another clause
    moves there; of several items for one clause the first stays. All matching
    is by code points. A quote is sought in the body of its claimed clause; only
    the others meet the whole text, all those of a document at once.
    """
    quote = F.regexp_replace("quote", BLANK, "")
    base = items.withColumn("quote", F.when(~F.col("malformed"), quote))
    text = docs.select(F.col(id_col), F.col("text").alias("_text"))
    if "body" not in clauses.columns:
        cut = F.substring("_text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
        clauses = clauses.join(text, id_col).withColumn("body", cut).drop("_text")
    spans = clauses.select(F.col(id_col).alias("_d"), F.col("clause_id").cast("long").alias("_cid"), F.col("start").cast("int").alias("_s"), F.col("end").cast("int").alias("_e"), F.col("body").alias("_body"))
    rows = base.join(spans.drop("_e"), (F.col(id_col) == F.col("_d")) & (F.col("claimed_id") == F.col("_cid")), "left").drop("_d", "_cid")
    inside = F.position(F.col("quote"), F.col("_body"))
    rows = rows.withColumn("_in", F.when(inside > 0, F.col("_s") + inside - 1)).drop("_s", "_body")
    # Quotes below the size of evidence stand only where they are a whole clause.
    short = ~((F.length("quote") >= EVIDENCE_CHARS) | (F.size(F.split("quote", r"\s+")) >= EVIDENCE_WORDS))
    bodies = spans.where(F.length("_body") < EVIDENCE_CHARS).select(F.col("_d").alias("_b"), "_body").distinct().withColumn("_whole", F.lit(True))
    rows = rows.withColumn("_short", short).join(bodies, (F.col(id_col) == F.col("_b")) & (F.col("quote") == F.col("_body")), "left").drop("_b", "_body")
    sought = F.col("_in").isNull() & ~F.col("malformed")
    once = rows.where(sought).groupBy(id_col).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != id_col])).alias("_items")).join(text, id_col, "left")

    def found(x: Column) -> Column:
        first = F.position(x["quote"], F.col("_text"))
        return F.struct(x.alias("x"), F.when(first > 0, first - 1).alias("_first"), (F.position(x["quote"], F.col("_text"), first + 1) > 0).alias("_again"))

    missed = once.select(id_col, F.explode(F.transform("_items", found)).alias("_i")).select(id_col, "_i.x.*", "_i._first", "_i._again")
    missed = missed.join(spans.drop("_body").withColumnsRenamed({"_cid": "_oid", "_s": "_os", "_e": "_oe"}), (F.col(id_col) == F.col("_d")) & ~F.col("_again") & (F.col("_os") <= F.col("_first")) & (F.col("_first") < F.col("_oe")), "left").drop("_d", "_os")
    rows = rows.where(~sought).unionByName(missed, allowMissingColumns=True)
    reason = (
        F.when(F.col("malformed"), "malformed").when(F.col("quote").contains("\n"), "crosses_clause").when(F.col("_short") & F.col("_whole").isNull(), "too_short")
        .when(F.col("_in").isNotNull(), None).when(F.col("_first").isNull(), "not_found").when(F.col("_again"), "ambiguous").when(F.col("_oid").isNull(), "not_found")
        .when(F.col("_first") + F.length("quote") > F.col("_oe"), "crosses_clause")
    )
    rows = rows.withColumn("reason", reason).withColumn("moved", F.col("reason").isNull() & F.col("_in").isNull())
    rows = rows.withColumn("clause_id", F.when(F.col("reason").isNull(), F.when(F.col("_in").isNotNull(), F.col("claimed_id")).otherwise(F.col("_oid")))).withColumn("quote_start", F.when(F.col("reason").isNull(), F.coalesce("_in", "_first")))
    turn = F.row_number().over(Window.partitionBy(id_col, "clause_id").orderBy("item_no"))
    rows = rows.withColumn("reason", F.when(F.col("clause_id").isNotNull() & (turn > 1), "duplicate").otherwise(F.col("reason")))
    return rows.withColumn("quote_end", F.col("quote_start") + F.length("quote")).drop("_in", "_first", "_again", "_short", "_whole", "_oid", "_oe")


def verification_report(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """received, verified, dropped and relocated of each document. A moved item counts as relocated even where it is a duplicate."""
    return placed.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("reason").isNull()).alias("verified"), F.count_if(F.col("reason").isNotNull()).alias("dropped"), F.count_if(F.coalesce("moved", F.lit(False))).alias("relocated")
    )


def with_quotes(readings: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Quote texts cut from the documents for stored offsets; offsets outside the text are left out."""
    rows = readings.join(docs.select(F.col(id_col), F.col("text").alias("_text")), id_col)
    sane = (F.col("quote_start") >= 0) & (F.col("quote_start") < F.col("quote_end")) & (F.col("quote_end") <= F.length("_text"))
    return rows.where(sane).withColumn("quote", F.substring("_text", F.col("quote_start") + 1, F.col("quote_end") - F.col("quote_start"))).drop("_text")
