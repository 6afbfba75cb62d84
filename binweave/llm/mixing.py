"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Only DataFrame functions are used. Each document draws an exponential key
``-ln(u) / quality``; within a source the documents are ordered by that key and their
sizes are prefix-summed to the source's budget. A budget above the source's own size
is first served by complete epochs, the fraction that remains by the ordered prefix.

A source may hold most of the rows, so nothing is ordered source by source in one task:
keys are cut into ``buckets`` ranges, even in the keys' logarithm so that no weight gathers
its documents in one, the ranges' sizes are summed (with map-side combining), and only the
one range per source in which the budget ends is ordered. The list of sources is broadcast
if it has no more than MOST_BROADCAST rows. Rows, with whatever wide columns they carry, are
written once with their sizes and keys, and not shuffled except those of that range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, guarded, materialise

SOURCE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Sources up to which their targets are sent to all executors.
MOST_BROADCAST = 20_000
#: Octaves that the ranges of keys span, and the least one; keys beyond go to the ends.
OCTAVES, LEAST_OCTAVE = 32, -24


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def symbol_quality(text: str = "text") -> Column:
    """A weight in (0, 1]: falls with the share of the characters #*$%&|<> in the text.
    A null or empty text weighs 1."""
    n = F.coalesce(F.length(text), F.lit(0))
    clean = F.coalesce(F.length(F.translate(F.col(text), "#*$%&|<>", "")), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * (n - clean) / F.greatest(n, F.lit(1)))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone, so reruns agree."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = SOURCE_WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """Targets of sources, given rows (__src, __size): sources in code point order, null
    last, weigh ``weights`` in turn and divide ``share`` times the sum of sizes; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight.

    In the order of cap / weight the capped sources come first, so the level at which the
    others meet follows from running sums and needs no iteration. One row per source: the
    windows below run over the list of sources, never over documents."""
    by_name = Window.orderBy(F.col("__src").asc_nulls_last())
    # by cap / weight; running sums before and after
    ratio = Window.orderBy(F.col("__ratio"), F.col("__src").asc_nulls_last())
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(after)
    return (
        sizes.withColumn("__weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("__cap", F.lit(float(most)) * F.col("__size"))
        .withColumn("__budget", F.lit(float(share)) * F.sum("__size").over(everything))
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
        .withColumn("__level", level)
        .withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(everything)["__level"])
        .select("__src", F.col("__size").alias("__source_size"), F.least("__cap", F.coalesce(F.col("__level") * F.col("__weight"), F.col("__cap"))).alias("__target"))
    )


@guarded
def mix(
    docs: DataFrame,
    size: Column | None = None,
    quality: Column | None = None,
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[float] = SOURCE_WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    buckets: int = 1 << 16,
) -> DataFrame:
    """All rows of docs with four more columns: size, source_size, target and taken, the
    number of words that the mix takes of the row, repeats counted. Columns of docs with
    these names are replaced; other columns pass.

    Each source's taken words add up to the whole part of its target. The document at which
    the budget ends gives the words that are still missing. Null text: size 0, taken 0. A
    null source is a source of its own. A null key draws one fixed number. Rows that repeat
    count as often as they come; very long texts count whole. Equal keys go by the row's
    key, then by size, then by a hash of the whole row. An empty table gives an empty result."""
    octave = (F.log2("__key") - LEAST_OCTAVE) * (buckets / OCTAVES)
    rows = (
        docs.withColumn("__size", word_count() if size is None else size)
        .withColumn("__src", F.col(source))
        .withColumn("__key", -F.ln(uniform(F.col(key), seed)) / (symbol_quality() if quality is None else quality))
        .withColumn("__cell", F.greatest(F.lit(0), F.least(F.floor(octave), F.lit(buckets - 1))).cast("int"))
    )
    rows = materialise(rows, "sizes")
    cells = rows.groupBy("__src", "__cell").agg(F.sum("__size").alias("__size"))
    targets = source_targets(cells.groupBy("__src").agg(F.sum("__size").alias("__size")), weights, share, most)
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    targets = targets.withColumn("__epochs", epochs).withColumn("__rest", F.floor(F.col("__target") - F.col("__epochs") * F.col("__source_size")))
    # the cell in which a source's budget ends, and the words of the cells before it
    upto = F.sum("__size").over(Window.partitionBy("__src").orderBy("__cell"))
    ends = (
        cells.withColumn("__upto", upto)
        .join(targets.withColumnRenamed("__src", "__t"), F.col("__src").eqNullSafe(F.col("__t")))
        .groupBy("__src", "__source_size", "__target", "__epochs", "__rest")
        .agg(
            F.min(F.when(F.col("__upto") > F.col("__rest"), F.col("__cell"))).alias("__end"),
            F.min(F.when(F.col("__upto") > F.col("__rest"), F.struct("__cell", (F.col("__upto") - F.col("__size")).alias("b"))))["b"].alias("__before"),
        )
        .withColumn("__end", F.coalesce("__end", F.lit(buckets)))
        .withColumnRenamed("__src", "__t")
    )
    ends = materialise(ends, "ends")
    few = ends.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = rows.join(F.broadcast(ends) if few else ends, F.col("__src").eqNullSafe(F.col("__t")))
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    out = lambda df, extra: df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__epochs") * F.col("__size") + extra).cast("long").alias("taken"),
    )
    whole = out(rows.where(F.col("__cell") != F.col("__end")), F.when(F.col("__cell") < F.col("__end"), F.col("__size")).otherwise(0))
    rest = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    ordered = Window.partitionBy("__src").orderBy("__key", F.col(f"`{key}`"), "__size", rest).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(ordered), F.lit(0))
    last = out(
        rows.where(F.col("__cell") == F.col("__end")).withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), left))),
        F.col("__extra"),
    )
    return whole.unionByName(last)


@guarded
def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each time that the mix takes a document: whole texts, and for what is
    left below the size the first words of the text, joined by single spaces."""
    times = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.least(F.col("size"), F.col("taken") - F.col("__n") * F.col("size"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, part.cast("int")), " ")
    return (
        mixed.where(F.col("taken") > 0)
        .withColumn("__n", F.explode(F.sequence(F.lit(0).cast("long"), (times - 1).cast("long"))))
        .withColumn(text, F.when(part < F.col("size"), cut).otherwise(F.col(text)))
        .drop("size", "source_size", "target", "taken", "__n")
    )


def op8_mix_sources(spark, sf_dir) -> DataFrame:
    # texts are left behind once their sizes and weights are taken
    rows = documents(spark, sf_dir).select("doc_id", "source", word_count().alias("words"), symbol_quality().alias("quality"))
    mixed = mix(rows, F.col("words"), F.col("quality"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (coalesce(length(text), 0) - coalesce(length(translate(text, '#*$%&|<>', '')), 0)) / greatest(coalesce(length(text), 0), 1))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (SELECT 1.5::DOUBLE * sum(size)::DOUBLE FROM d) AS budget FROM s),
l AS (SELECT *, cap / weight AS ratio,
    (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size,
    least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::BIGINT AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""
