"""Documents split into parts that a reader takes, and the parts' readings joined again."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Size of a part (UTF-16 units), what joins parts, and after which notices a part can be read again.
PART, JOINT = 10_000, "\n\n"
RETRYABLE = ("model_busy", "model_error", "model_timeout", "model_interrupted", "bad_output")
SENTENCE_GAP = re.compile(r"\s+(?=[\"'“(]?[A-Z0-9])")
SENTENCE_STOP = re.compile(r"[.!?][\"'”’)]*$")


def units(text: str) -> int:
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def _filled(pieces: list[str], joint: str, most: int) -> list[str]:
    """Neighbouring pieces joined as long as they fit."""
    out: list[str] = []
    room = -1
    for piece in filter(None, pieces):
        need = units(piece) + len(joint)
        if out and need <= room:
            out[-1] += joint + piece
            room -= need
        else:
            out.append(piece)
            room = most - units(piece)
    return out


def _sentences(text: str) -> list[str]:
    out, at = [], 0
    for gap in SENTENCE_GAP.finditer(text):
        if SENTENCE_STOP.search(text, max(at, gap.start() - 40), gap.start()):
            out.append(text[at : gap.start()])
            at = gap.end()
    return [*out, text[at:]]


def _hard_cut(text: str, most: int) -> list[str]:
    """Cut at the last space that fits, or else where the room ends; a character is never split."""
    out = []
    while units(text) > most:
        reach, used = 0, 0
        while used < most + 1 and reach < len(text):  # to the character that starts at or before unit `most`
            used += 1 + (ord(text[reach]) > 0xFFFF)
            reach += 1
        space = text.rfind(" ", 0, reach)
        if space <= 0:
            space, used = 0, 0
            while used + 1 + (ord(text[space]) > 0xFFFF) <= most:
                used += 1 + (ord(text[space]) > 0xFFFF)
                space += 1
            space = max(space, 1)
        out.append(text[:space].rstrip())
        text = text[space:].lstrip()
    return [*out, text] if text else out


def _within(text: str, most: int) -> list[str]:
    if units(text) <= most:
        return [text]
    for pieces, joint in ((text.split("\n"), "\n"), (_sentences(text), " ")):
        if len(pieces) > 1:
            return _filled([x for p in pieces for x in _within(p, most)], joint, most)
    return _hard_cut(text, most)


def split_text(text: str, most: int = PART) -> list[str]:
    """Parts of at most `most` units: whole paragraphs if they fit, else lines, sentences, words."""
    paragraphs = [p.strip() for p in re.split(r"\n{2,}", text)]
    return _filled([x for p in paragraphs if p for x in _within(p, most)], JOINT, most)


def part_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PART) -> DataFrame:
    """id, part_no and text of every part."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else split_text(x, most) for x in texts.to_pylist()], pa.list_(pa.string()))

    rows = docs.select(id_col, F.posexplode_outer(F.arrow_udf(run, "array<string>")(F.col(text_col))).alias("pos", "text")).where("pos is not null")
    return rows.select(id_col, (F.col("pos") + 1).alias("part_no"), "text")


def stitched(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """parts (id, part_no, chars, clauses, segments, failed) with the offset, clause number and segment count that come before each.

    A failed part adds nothing to what follows it.
    """
    before = Window.partitionBy(id_col).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)

    def sum_of(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(~F.col("failed"), value)).over(before), F.lit(0)).cast("long")

    return parts.withColumns({"offset": sum_of(F.col("chars") + 2), "id_base": sum_of(F.col("clauses")), "seg_start": sum_of(F.col("segments"))})


def shifted(rows: DataFrame, stitched_parts: DataFrame, id_col: str = "doc_id", places: tuple = ("start", "end"), number: str | None = "clause_id") -> DataFrame:
    """Segments or readings of parts with places and clause numbers in the whole document. Those of failed parts are left out."""
    own = rows.join(stitched_parts.where(~F.col("failed")).select(id_col, "part_no", "offset", "id_base"), [id_col, "part_no"])
    own = own.withColumns({p: F.col(p) + F.col("offset") for p in places})
    return (own.withColumn(number, F.col(number) + F.col("id_base")) if number else own).drop("offset", "id_base")


def latest_attempts(attempts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each part the row of its last attempt: a retry replaces one part, and the document is stitched anew."""
    last = Window.partitionBy(id_col, "part_no").orderBy(F.desc("attempt"))
    return attempts.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def document_totals(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sums, sources and models over a document's parts, unread clauses, failures, and the last known budget."""
    read = ~F.col("failed")
    return parts.groupBy(id_col).agg(
        F.sum(F.when(read, F.col("received"))).alias("received"), F.sum(F.when(read, F.col("verified"))).alias("verified"), F.sum(F.when(read, F.col("dropped"))).alias("dropped"),
        F.sum(F.when(read, F.col("clauses") - F.coalesce("verified", F.lit(0)))).alias("unread"), F.count_if("failed").alias("failed"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
        F.max_by("budget_left", F.when(F.col("budget_left").isNotNull(), F.col("part_no"))).alias("budget_left"),
        F.bool_and(F.coalesce(F.col("source") == "cache", F.lit(False))).alias("all_cached"), F.bool_or(F.coalesce(F.col("source") == "cache", F.lit(False))).alias("some_cached"),
    )
