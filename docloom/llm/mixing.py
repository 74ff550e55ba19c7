"""Mixing sources to target weights, in DataFrame operations only.

Sources get weights, which cycle over the sources in code point order (null last). Together they share ``share`` of all
sizes; no target goes beyond ``cap`` times its source's size, and the excess is shared again by weight (water filling, in
closed form over one row a source). Within a source, complete epochs come first. What is left of the target is filled by
Efraimidis-Spirakis sampling: each document has the key -ln(u) / quality weight, u from a hash of its id; documents are
taken in key order until their prefix sum comes nearest to the budget.

The prefix sum runs in two levels, so that a source with a third of all rows is spread: keys are cut into buckets, of
which a source has as many as its share of rows asks for; sums of buckets are scanned within the source, rows within their
bucket. A key is exponential with its document's quality as rate, so a source's keys are spread by a mixture of
exponentials; its distribution function, from counts of qualities by steps of 12%, makes the buckets even.

What a source's sample takes is a prefix of its order. ``mix_documents`` ranks thin rows, keeps the last one taken of each
source, and compares documents with that, so texts are in no shuffle.

Defined results: null text has size 0; a null source is a source of its own; a null id is hashed as an empty string; equal
rows are interchangeable and each is counted (``mix_documents`` takes or leaves them together); documents without words cost
nothing: they come once an epoch, and with the sample while it has room; an empty table gives an empty mix; other columns pass through untouched
(``mix_*`` names are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.storage import materialise

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>!]"
BUCKETS = 1024
BUCKET_ROWS = 100_000
#: qualities, from 0.05 to 1, are counted in steps of this ratio
QUALITY_STEP = 1.12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Document quality weight between 0.05 and 1: fewer symbols a character and more than 20 words count as better."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)).cast("double")
    chars = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * symbols / chars) * F.when(size >= 20, F.lit(1.0)).otherwise(F.lit(0.5))


def uniform_of(key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the id's SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def sized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with mix_size, mix_quality, and mix_key, the exponential key scaled by quality."""
    out = docs.withColumn("mix_size", size_of(F.col(text_col)))
    out = out.withColumn("mix_quality", quality_of(F.col(text_col), F.col("mix_size")))
    return out.withColumn("mix_key", -F.log(uniform_of(F.col(id_col))) / F.col("mix_quality"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` has mix_source, mix_source_size, mix_rows, mix_rates; adds mix_target and the number of key buckets."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("c", F.lit(float(cap)) * F.col("mix_source_size")).withColumn("r", F.col("c") / F.col("w"))
    fill = Window.orderBy("r", F.col("mix_source").asc_nulls_last())
    s = s.withColumn("total", F.lit(float(share)) * F.sum("mix_source_size").over(everything)).withColumn("rows", F.sum("mix_rows").over(everything))
    s = s.withColumn("c0", F.coalesce(F.sum("c").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("w0", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("c0")) / F.col("w0")).withColumn("nth", F.row_number().over(fill))
    # the first source, by ratio of cap to weight, that stays below its cap sets the level of all after it
    s = s.withColumn("rate", F.min_by(F.when(F.col("level") <= F.col("r"), F.col("level")), F.when(F.col("level") <= F.col("r"), F.col("nth"))).over(everything))
    target = F.least(F.col("c"), F.coalesce(F.col("rate") * F.col("w"), F.col("c")))
    of_all = F.greatest(F.lit(float(BUCKETS)), F.col("rows") / BUCKET_ROWS)
    return s.select("mix_source", "mix_source_size", target.alias("mix_target"), F.ceil(of_all * F.col("mix_rows") / F.col("rows")).alias("mix_buckets"), "mix_rows", "mix_rates")


def counted(docs: DataFrame, source_col: str) -> DataFrame:
    """Size, rows and qualities of each source; qualities as up to 27 (rows, mean)."""
    step = F.floor(F.log("mix_quality") / F.log(F.lit(QUALITY_STEP)))
    by = docs.groupBy(F.col(source_col).alias("mix_source"), step.alias("step")).agg(F.sum("mix_size").alias("size"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("mix_quality").alias("rate"))
    rates = F.array_sort(F.collect_list(F.struct("rate", "n")))
    return by.groupBy("mix_source").agg(F.sum("size").alias("mix_source_size"), F.sum("n").cast("long").alias("mix_rows"), rates.alias("mix_rates"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` must have mix_size, mix_quality and mix_key. Adds mix_source_size, mix_target, mix_epochs, and mix_copies, how often
    each is taken. Equal keys are in the order of id, size and ``ties``."""
    plan = materialise(targets(counted(docs, source_col), weights, share, cap), "mix-plan")  # one row a source
    keyed = docs.withColumn("mix_src", F.col(source_col)).join(plan, F.col("mix_src").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    # the share of the source's keys below this one; a bucket has the same share of it as any other
    below = F.aggregate("mix_rates", F.lit(0.0), lambda sum_, r: sum_ + r["n"] * (F.lit(1.0) - F.exp(-r["rate"] * F.col("mix_key")))) / F.col("mix_rows")
    place = F.least(F.col("mix_buckets") - 1, F.floor(below * F.col("mix_buckets")))
    keyed = keyed.withColumn("mix_bucket", place.cast("long")).drop("mix_rates", "mix_rows")
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(F.col("mix_src").alias("src"), F.col("mix_bucket").alias("bucket")).agg(F.sum("mix_size").alias("sum"))
    sums = sums.select("src", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("mix_before"))
    inside = Window.partitionBy("mix_src", "mix_bucket").orderBy("mix_key", F.col(id_col).asc_nulls_first(), "mix_size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.withColumn("mix_upto", F.sum("mix_size").over(inside))
    ranked = ranked.join(sums, F.col("mix_src").eqNullSafe(F.col("src")) & (F.col("mix_bucket") == F.col("bucket")), "left").drop("src", "bucket")
    before = F.col("mix_before") + F.col("mix_upto") - F.col("mix_size")
    epochs = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("mix_target") - epochs * F.col("mix_source_size")
    copies = epochs + F.when(before + F.col("mix_size") / 2.0 <= rest, F.lit(1)).otherwise(F.lit(0))
    return ranked.withColumn("mix_epochs", epochs).withColumn("mix_copies", copies.cast("long")).drop("mix_src", "mix_buckets", "mix_bucket", "mix_before", "mix_upto")


def mix_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with mix_copies, from thin rows: a document is taken with the sample if it stands no later in the order than the
    last one taken of its source."""
    tie = F.xxhash64(text_col).alias("mix_tie")
    thin = sized(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), tie))
    ranked = mix(materialise(thin.drop("text"), "mix-sizes"), ties=("mix_tie",), **kw)
    place = F.struct("mix_key", F.col("doc_id").alias("id"), "mix_size", "mix_tie")
    last = ranked.groupBy(F.col("source").alias("mix_source")).agg(F.first("mix_epochs").alias("mix_epochs"), F.max(F.when(F.col("mix_copies") > F.col("mix_epochs"), place)).alias("mix_last"))
    last = materialise(last, "mix-last")  # one row a source
    out = sized(docs, text_col, id_col).withColumn("mix_tie", F.xxhash64(text_col))
    out = out.join(last, F.col(source_col).eqNullSafe(F.col("mix_source")), "left")
    own = F.struct("mix_key", F.col(id_col).alias("id"), "mix_size", "mix_tie")
    copies = F.col("mix_epochs") + F.when(own <= F.col("mix_last"), F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("mix_copies", copies).drop("mix_source", "mix_epochs", "mix_last", "mix_tie", "mix_key", "mix_quality")


def report(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The digest of the contract; texts are read once and stay out of every shuffle."""
    thin = sized(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")))
    thin = materialise(thin.select("doc_id", "source", "mix_size", "mix_quality", "mix_key"), "mix-sizes")
    return mix(thin, **kw).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]'))::DOUBLE AS symbols,
         greatest(length(coalesce(text, '')), 1)::DOUBLE AS chars
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / (greatest(0.1, 1.0 - 5.0 * symbols / chars) * CASE WHEN size >= 20 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS c, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM s),
r AS (
  SELECT *, c / w AS r,
         coalesce(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
         sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w0,
         row_number() OVER (ORDER BY c / w, source NULLS LAST) AS nth
  FROM w),
rate AS (SELECT min_by((total - c0) / w0, nth) AS rate FROM r WHERE (total - c0) / w0 <= r),
t AS (SELECT source, source_size, least(c, coalesce(rate * w, c)) AS target FROM r CROSS JOIN rate),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""
