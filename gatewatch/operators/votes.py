"""Votes over several readings of one plate: by length, then by position, weighted by confidence and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plates as P


def votes(readings: DataFrame, key: str = "track_id") -> DataFrame:
    """text, consensus, confidence, reads, exact, total, valid, stable of each key's readings (text, confidence, crop_quality, reading_id).

    Readings of one length vote for every position; the weightiest character wins, the surer reading on ties, then the first one.
    The length with the most weight wins, a valid plate counting 8 % more. Grouping is by key, length and position throughout."""
    weight = F.greatest(F.lit(0.05), F.col("confidence")) * (0.5 + 0.5 * F.coalesce("crop_quality", F.lit(0.5)))
    rows = readings.filter(F.col("text").isNotNull() & (F.col("text") != "")).select(key, "reading_id", "text", "confidence", F.coalesce("crop_quality", F.lit(0.5)).alias("crop_quality"), weight.alias("w"), F.length("text").alias("n"))
    spread = rows.select(key, "n", "w", "confidence", "reading_id", F.posexplode(F.split("text", "")).alias("at", "char"))
    chars = spread.groupBy(key, "n", "at", "char").agg(F.sum("w").alias("cw"), F.max("confidence").alias("cc"), F.min("reading_id").alias("first"))
    order = F.struct(F.round("cw", 12).alias("cw"), "cc", (-F.col("first")).alias("f"))
    winners = chars.groupBy(key, "n", "at").agg(F.max_by("char", order).alias("char"), F.max_by("cw", order).alias("won"), F.sum("cw").alias("all"))
    made = winners.groupBy(key, "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "char"))), lambda s: s["char"]), "").alias("vote"), F.avg(F.col("won") / F.col("all")).alias("consensus"), F.max("all").alias("group_weight"))
    made = made.withColumn("valid", P.is_valid(F.col("vote")))
    best = Window.partitionBy(key).orderBy(F.desc(F.round(F.col("group_weight") * F.when(F.col("valid"), 1.08).otherwise(1.0), 12)), F.desc("valid"), "n")
    chosen = made.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    same = F.size(F.filter(F.zip_with(F.split("text", ""), F.split("vote", ""), lambda a, b: a == b), lambda x: x)) / F.col("n")
    joined = rows.join(chosen, [key, "n"]).withColumn("agree", same).withColumn("supports", F.col("agree") >= 0.75)
    joined = joined.withColumn("backed", F.max("supports").over(Window.partitionBy(key)))  # else all count as they are
    joined = joined.withColumns({"supports": F.col("supports") | ~F.col("backed"), "agree": F.when(F.col("backed"), F.col("agree")).otherwise(1.0)})
    used = F.col("supports")
    surest = F.struct("agree", (0.55 * F.col("crop_quality") + 0.45 * F.col("confidence")).alias("s"), (-F.col("reading_id")).alias("i"))
    found = joined.groupBy(key).agg(
        F.first("vote").alias("text"), F.first("consensus").alias("consensus"), F.first("valid").alias("valid"), F.count("*").alias("reads"), F.count_if(F.col("text") == F.col("vote")).alias("exact"),
        (F.sum(F.when(used, F.col("confidence") * F.col("w") * F.col("agree"))) / F.sum(F.when(used, F.col("w"))) * F.first("consensus")).alias("confidence"), F.max_by(F.when(used, F.col("crop_quality")), F.when(used, surest)).alias("crop_quality"),
    )
    stable = F.col("valid") & (F.col("reads") >= 2) & (F.col("consensus") >= 0.70) & (F.col("confidence") >= 0.65) & ((F.col("exact") >= 2) | (F.col("consensus") >= 0.85))
    return found.join(totals, key).withColumn("stable", stable)


def best_variant(candidates: DataFrame, key: str) -> DataFrame:
    """The best text variant of a capture; each other variant with the same text adds to its score, up to 0.99."""
    agreeing = F.count("*").over(Window.partitionBy(key, "text")) - 1
    scored = candidates.withColumn("score", F.least(F.lit(0.99), F.col("confidence") + 0.03 * agreeing))
    return scored.groupBy(key).agg(F.max_by(F.struct("text", "variant", F.round("score", 6).alias("score")), F.struct("score", (-F.col("variant")).alias("v"))).alias("b")).select(key, "b.*")


def best_valid(captures: DataFrame) -> DataFrame:
    """The surest valid candidate of each capture (capture_id, candidates)."""
    rows = captures.select("capture_id", F.explode("candidates").alias("c")).filter(P.is_valid(F.col("c.text")))
    return rows.groupBy("capture_id").agg(F.max_by(F.struct("c.text", "c.confidence"), F.struct("c.confidence", "c.text")).alias("b")).select("capture_id", "b.text", "b.confidence")


def merged_fragments(items: DataFrame, height: float = 12.0) -> DataFrame:
    """text, confidence of each group's fragments (group_id, text, x, y, confidence): tax dates go, the others are put into lines from
    top to bottom; the line that makes a known plate wins, then the surer one, then the upper one."""
    w = Window.partitionBy("group_id").orderBy("y", "x")
    line = F.sum(F.when(F.col("y") - F.lag("y").over(w) > height, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = items.filter(~P.is_tax_date(F.col("text"))).withColumn("line", line)
    lines = rows.groupBy("group_id", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ").alias("joined"), F.avg("confidence").alias("confidence"))
    cut = lines.withColumn("s", P.segment(F.col("joined")))
    best = F.struct(F.col("s.known"), F.col("s.valid"), F.round("confidence", 9), -F.col("line"))
    return cut.groupBy("group_id").agg(F.max_by(F.struct(F.col("s.text").alias("text"), F.round("confidence", 6).alias("confidence")), best).alias("b")).select("group_id", "b.*")


def merged_boxes(items: DataFrame, least: float = 0.20) -> DataFrame:
    """SF-36: group_id, text, formatted, confidence, known of each group's pieces of text (group_id, place, text, confidence, x1, y1, x2, y2; the box may
    be null). Pieces under `least` and blank ones go. Of several pieces tax dates go, and what lies below and is short, a number, or
    small; if nothing is left, all stay. The others are put into lines from top to bottom, a piece joining the first line whose mean centre is near; the
    line wins that makes a plate, then by confidence and height. A group's pieces are few; groups are walked along sorted partitions."""
    from ..streaming.folds import fold_batch

    boxed = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    side = lambda lo, hi: F.when(boxed, F.greatest(F.lit(1.0), F.col(hi) - F.col(lo))).otherwise(0.0)
    rows = items.filter(F.col("confidence") >= least).withColumn("text", F.trim("text")).filter("text <> ''")
    rows = rows.select("group_id", "place", "text", "confidence", F.when(boxed, F.col("x1")).otherwise(0.0).alias("x"), F.when(boxed, (F.col("y1") + F.col("y2")) / 2).otherwise(0.0).alias("y"), side("y1", "y2").alias("h"))
    group = Window.partitionBy("group_id")
    rows = rows.withColumns({"n": F.count("*").over(group), "tallest": F.max("h").over(group), "top": F.min("y").over(group)})
    plain = F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "")
    below = (F.col("y") - F.col("top")) > F.greatest(F.lit(8.0), F.col("tallest") * 0.5)
    small = (F.col("tallest") > 0) & (F.col("h") <= 0.6 * F.col("tallest"))
    rows = rows.withColumn("good", (F.col("n") == 1) | ~(P.is_tax_date(F.col("text")) | (below & (plain.rlike("^[0-9]+$") | (F.length(plain) <= 3) | small))))
    rows = rows.withColumn("some", F.max("good").over(group)).filter(F.col("good") | ~F.col("some"))

    def step(state: list | None, row: dict) -> tuple[list, list[dict]]:
        lines = state or []
        for line in lines:
            if abs(row["y"] - sum(i["y"] for i in line) / len(line)) <= max(4.0, sum(i["h"] for i in line) / len(line) * 0.40):
                line.append(row)
                return lines, []
        return [*lines, [row]], []

    def lines_of(lines: list) -> list[dict]:
        out = []
        for k, line in enumerate(lines):
            text = " ".join(i["text"] for i in sorted(line, key=lambda i: i["x"]))
            out.append({"group_id": line[0]["group_id"], "line": k, "joined": text, "confidence": sum(i["confidence"] for i in line) / len(line), "weight": sum(i["confidence"] + i["h"] for i in line), "alone": line[0]["n"] == 1})
        return out

    lines = fold_batch(rows, ["group_id"], ["y", "place"], step, "group_id long, line int, joined string, confidence double, weight double, alone boolean", lines_of)
    cut = lines.withColumn("s", P.segment(F.col("joined")))
    score = F.when(F.col("s.known"), 30.0).when(F.col("s.valid"), 15.0).otherwise(0.0) + F.col("weight")
    best = cut.groupBy("group_id").agg(F.max_by(F.struct("joined", "confidence", "alone", "s"), F.struct(score, -F.col("line"))).alias("b")).select("group_id", "b.*")
    raw = F.when(F.col("alone"), F.col("joined")).otherwise(F.regexp_replace(F.upper("joined"), "[^A-Z0-9]", ""))
    return best.select("group_id", F.when(F.col("s.valid"), F.col("s.text")).otherwise(raw).alias("text"), F.when(F.col("s.valid"), F.col("s.formatted")).otherwise(F.col("joined")).alias("formatted"), "confidence", F.col("s.known").alias("known"))
