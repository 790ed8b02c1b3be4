"""Document fingerprints: bottom-k sketches of shingle hashes, mergeable, estimating resemblance, containment and size.

Column expressions only. A shingle is five consecutive words (a shorter text is one shingle); its hash has 40 bits. Words end
at white space of any script; of scripts that are written without spaces every character is a word. A sketch is the ascending
array of the K least distinct hashes. Sketches of parts merge into that of the whole by union.

Defined cases: a null text counts as empty; an empty text has an empty sketch; two empty sketches are alike (1), an empty
one and another are not (0); rows of equal doc_id are ordered by a hash of their text; null doc_ids come last; an empty
table gives an empty result; other columns are not read. Rows equal in doc_id and text are ordered anyhow: they are each
other's next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHINGLE, table, text_of

K, BITS = 128, 40
#: Scripts written without spaces, and the words of a text.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"(?U)[{UNSPACED}]|[^\s{UNSPACED}]+"
#: Parts by hash of text that the rows of one frequent doc_id are dealt out to.
WAYS = 64


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def sketch_of(words: Column, k: int = K) -> Column:
    """Bottom-k sketch of an array of word hashes; name the array with withColumn first, so that it is computed once."""
    n = F.size(words)
    several = F.transform(F.slice(words, 1, n - (SHINGLE - 1)), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, SHINGLE)]))
    hashes = F.when(n >= SHINGLE, several).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - BITS)))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(2**BITS) / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r = resemblance(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * distinct(merge(a, b, k), k) / distinct(a, k)))


def fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


def merged_sketches(parts: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of all parts of each key. Hashes are made distinct before the ranking, which keeps k per key."""
    hashes = parts.select(*keys, F.explode(sketch).alias("h")).distinct()
    ranked = hashes.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def followers(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: the next document in descending doc_id; after the last, the first.

    Documents are dealt by quantiles of doc_id, so that only the first row of each range crosses to another one. A doc_id that
    fills more than a range, and null, are dealt out further by a hash of the text, by which their rows are ordered."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    frequent = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    bounds = sorted({*cuts, *(c + 1 for c in frequent)})
    segment = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in bounds]).cast("array<bigint>"), lambda b: b <= F.col("doc_id"))))
    order = F.xxhash64("text")
    split = F.col("doc_id").isNull() | F.col("doc_id").isin(*frequent)
    part = F.when(split, WAYS // 2 - 1 - F.shiftright(order, 64 - 6)).otherwise(0)  # descending, as the segments are
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.withColumn("range", (segment * WAYS + part).cast("int"))
    taken = sorted((r["range"] for r in rows.select("range").distinct().collect()), reverse=True)  # a few a partition
    if not taken:
        taken = [0]
    above = spark.createDataFrame(list(zip(taken[1:] + taken[:1], taken)), "range int, before int")
    dealt = rows.repartition("range")  # before anything else is computed: only the text moves
    w = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), order)
    rows = dealt.withColumn("rank", F.row_number().over(w)).withColumn("words", word_hashes(F.col("text"))).withColumn("sketch", sketch_of(F.col("words")))
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w)).drop("words")
    heads = rows.filter(F.col("rank") == 1).select("range", F.struct("text", "sketch").alias("head"))
    around = heads.join(above, "range").select(F.col("before").alias("range"), "head")  # one row a range
    joined = rows.join(around, "range")
    return joined.select("doc_id", "text", "sketch", F.coalesce("next_text", "head.text").alias("next_text"), F.coalesce("next_sketch", "head.sketch").alias("next_sketch"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, their likeness to each other and to the next document's,
    the share of its shingles that the edited text keeps, and how many distinct ones it has, as the sketches estimate them."""
    rows = followers(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.expr("left(text, cast(n_chars as int) - half)"), F.expr("left(next_text, half)"))
    rows = rows.withColumn("edited", edited).withColumn("words", word_hashes(F.col("edited"))).withColumn("edited_sketch", sketch_of(F.col("words")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"), distinct(F.col("sketch")).alias("n_shingles"),
    )
