"""Mixing sources to target weights with a low-discrepancy schedule.

Built-in expressions, joins and windows only.

Targets: the mix takes ``share`` times all words; sources in code point order
(NULL last) weigh 3, 1, 2, 3, 1, ...; a source's target stops at ``most``
times its size and the excess is shared again by weight. So a target is
least(cap, level * weight), and the level is found in one pass over the
sources ordered by cap / weight.

Schedule: slot k has the point frac(k * golden ratio); cumulated target
shares map the point to a source; slots are ranked per source. A source's
documents, shuffled by a hash, form one stream of words cut into blocks of
``block`` words; the slot of rank r plays block r of the stream, and starts
again at the front for the second epoch. Slots run until each source has
played its target; the last slot of a source is cut to what the target
leaves, and slots that the finite schedule still owes a source come at the
end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarmac.llm.common import grouped_prefix, materialise, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 1024               # words of a slot
BUCKET_ROWS = 4096         # documents ordered together
GOLDEN = 0.6180339887498949
GOLDEN_HIGH = (GOLDEN * (1 << 26)) % 1.0


def _key(source: Column) -> Column:
    """Sources as a non-NULL key in code point order, NULL last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _same(doc_id: Column, text: Column) -> Column:
    """32 hexadecimal digits that rows of equal id and equal text share (NULL text: empty)."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), digest).cast("binary"))


def _shuffled(same: Column, chunk: Column) -> Column:
    """32 hexadecimal digits that order the documents of a source."""
    return F.md5(F.concat(same, F.lit(":"), chunk.cast("string")).cast("binary"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, skey, size, mixkey, row) of every row, and (skey, size, mixkey)
    as a stored table.

    ``mixkey`` deals the documents of a source into buckets: a hash of id and
    text, so rows without an id, or with one id, are dealt out by their texts.
    Equal rows beyond BUCKET_ROWS are numbered by their place in a table
    written once, and each chunk of BUCKET_ROWS of them has a key of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("source")).alias("skey"),
                       word_count(F.col("text")).alias("size"), _same(F.col("doc_id"), F.col("text")).alias("same"),
                       F.struct("*").alias("row"))
    narrow = materialise(rows.select("skey", "same", "size"), "mixsizes")        # the texts are counted once here
    hot = materialise(narrow.groupBy("skey", "same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS)
                      .select("skey", "same"), "mixhot")
    first = _shuffled(F.col("same"), F.lit(0)).alias("mixkey")
    if hot.isEmpty():
        return rows.select("doc_id", "skey", "size", first, "row"), narrow.select("skey", "size", first)
    many = materialise(rows.join(hot, ["skey", "same"], "left_semi"), "mixcopies")
    at = many.metadataColumn("_metadata")
    place = F.struct(at["file_path"].alias("file"), F.floor(at["row_index"] / BUCKET_ROWS).alias("chunk"))
    many = many.select("*", at["row_index"].alias("place"), F.lit(1).alias("one"), place.alias("chunk"))
    many = grouped_prefix(many, ["skey", "same"], "chunk", [F.col("place")], "one", "number")
    many = many.withColumn("mixkey", _shuffled(F.col("same"), F.expr(f"number DIV {BUCKET_ROWS}")))
    few = rows.join(hot, ["skey", "same"], "left_anti").select("doc_id", "skey", "size", first, "row")
    narrow_few = narrow.join(hot, ["skey", "same"], "left_anti").select("skey", "size", first)
    return (few.unionByName(many.select(few.columns)),
            materialise(narrow_few.unionByName(many.select("skey", "size", "mixkey")), "mixkeys"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(skey, source_size, source_docs, target, take, cum, whole, length) per
    source of ``sizes`` (skey, size); ``take`` is the rounded target, ``cum``
    and ``whole`` cumulate it, ``length`` is the number of slots of the mix. One row per source after a map-side combined sum;
    the windows below run over that table, not over documents."""
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    n = F.row_number().over(Window.orderBy("skey"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (n - 1) % len(weights) + 1)
    rows = (per.withColumn("weight", weight)
            .withColumn("cap", F.col("source_size") * F.lit(most))
            .withColumn("ratio", F.col("cap") / F.col("weight")))
    by_ratio = Window.orderBy("ratio", "skey")
    every = Window.partitionBy()
    rows = (rows
            .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
            .withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("level", (F.col("total") - F.col("caps")) / F.col("open")))
    # Sources before the water level are stopped (level > ratio); beyond it the level only falls.
    rows = rows.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    target = F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    rows = rows.withColumn("target", target).withColumn("take", F.round("target").cast("long"))
    front = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("cum", F.coalesce(F.sum("take").over(front), F.lit(0)))
            .withColumn("whole", F.sum("take").over(every))
            .withColumn("length", F.sum(F.ceil(F.col("take") / F.lit(block))).over(every))
            .select("skey", "source_size", "source_docs", "target", "take", "cum", "whole", "length"))


def schedule(targets: DataFrame) -> DataFrame:
    """(skey, rank, position): the place in the mix of each source's slots.

    As many slots as blocks of all targets. A point meets its source over a
    grid of cells (an equi-join), so no slot is compared with all sources.
    """
    spark = targets.sparkSession
    size = targets.agg(F.coalesce(F.max("length"), F.lit(0)).alias("slots"), F.count(F.lit(1)).alias("n")).first()
    slots, cells = int(size["slots"]), 1 << max(4, int(size["n"]).bit_length() + 2)
    k = F.col("position")
    point = F.expr(f"pmod(shiftright(position, 26) * {GOLDEN_HIGH!r}D + (position & {(1 << 26) - 1}) * {GOLDEN!r}D, 1.0D)")
    points = spark.range(slots).select(F.col("id").alias("position")).withColumn("u", point)
    points = points.withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    spans = (targets.where("take > 0")
             .select("skey", (F.col("cum") / F.col("whole")).alias("a"),
                     ((F.col("cum") + F.col("take")) / F.col("whole")).alias("b"))
             .withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("a") * cells), F.lit(cells - 1)),
                                                      F.least(F.floor(F.col("b") * cells), F.lit(cells - 1))))))
    hits = points.join(spans, "cell").where("u >= a AND u < b").select("skey", "position")
    hits = hits.withColumn("one", F.lit(1)).withColumn("part", F.expr(f"position DIV {BUCKET_ROWS * 4}"))
    return grouped_prefix(hits, ["skey"], "part", [k], "one", "rank").select("skey", "rank", "position")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, row), one row per
    input row; ``row`` holds all its columns.

    ``taken``: words that the mix plays of the document, repeats counted, at
    most twice its size; every source plays its rounded target exactly.
    ``first_slot``: place in the mix of the slot that plays the document's
    first word, NULL if nothing is taken; slots that the finite schedule still
    owes a source have the schedule's length. NULL texts have size zero; a
    NULL source is a source of its own, the last; repeated rows are single
    documents, and which of two equal rows comes first makes no difference;
    an empty table gives an empty result.
    """
    return _played(docs, block).select("doc_id", "size", "source_size", "target", "taken",
                                       F.when(F.col("taken") > 0, F.col("slot0")).alias("first_slot"), "row")


def _bucket() -> Column:
    """Bucket of a row in its source: ranges of ``mixkey``, about BUCKET_ROWS rows each."""
    share = F.conv(F.substring("mixkey", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.floor(share * F.ceil(F.col("source_docs") / BUCKET_ROWS))


def _played(docs: DataFrame, block: int) -> DataFrame:
    """Every document with its words taken and its slots in both epochs.

    Documents of a source are ordered in buckets of about BUCKET_ROWS rows,
    so no task holds a whole source; a bucket carries the slots of its blocks.
    """
    rows, narrow = _keyed(docs)
    targets = materialise(source_targets(narrow, block=block), "targets")
    bucket = _bucket().alias("bucket")

    front = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (narrow.join(targets.select("skey", "source_docs"), "skey").select("skey", "size", bucket)
               .groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
               .withColumn("off", F.coalesce(F.sum("words").over(front), F.lit(0)))
               .join(targets.select("skey", "source_size"), "skey"))
    slots = schedule(targets)
    blocks = (buckets.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("at", F.col("off") + F.col("epoch") * F.col("source_size"))
              .withColumn("rank", F.explode(F.sequence(F.expr(f"at DIV {block}"),
                                                       F.expr(f"(at + greatest(words, 1L) - 1) DIV {block}"))))
              .join(slots, ["skey", "rank"], "left")
              .withColumn("slot", F.struct("rank", "position")))
    carried = materialise(
        blocks.groupBy("skey", "bucket", "off")
        .agg(*[F.sort_array(F.collect_list(F.when(F.col("epoch") == e, F.col("slot")))).alias(f"slots{e}") for e in (0, 1)]),
        "mixbuckets")

    inner = (Window.partitionBy("skey", "bucket").orderBy("mixkey", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.join(targets, "skey")
              .select("skey", "doc_id", "size", "mixkey", "row", "source_size", "target", "take", "length", bucket)
              .withColumn("run", F.coalesce(F.sum("size").over(inner), F.lit(0)))
              .join(carried, ["skey", "bucket"])
              .withColumn("begin", F.col("off") + F.col("run")))

    def overlap(upto: Column) -> Column:
        return F.greatest(F.least(F.col("begin") + F.col("size"), upto) - F.col("begin"), F.lit(0)).cast("long")

    def slot(e: int) -> Column:
        at = F.expr(f"CAST((begin + {e} * source_size) DIV {block} - (off + {e} * source_size) DIV {block} AS INT)")
        return F.coalesce(F.get(f"slots{e}", at)["position"], F.col("length"))

    return (placed.withColumn("taken0", overlap(F.col("take")))
            .withColumn("taken1", overlap(F.col("take") - F.col("source_size")))
            .withColumn("taken", F.col("taken0") + F.col("taken1"))
            .withColumn("slot0", slot(0)).withColumn("slot1", slot(1)))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``, in the order of the
    schedule inside each partition: a document is repeated for each epoch that
    plays it. A document that the end of its source's target cuts stays whole
    if at least half of it is played in that epoch."""
    plays = F.filter(F.array(*[F.struct((F.col(f"taken{e}") * 2 >= F.col("size")).alias("on"), F.col(f"slot{e}").alias("slot"))
                               for e in (0, 1)]), lambda p: p["on"])
    out = (_played(docs, block).where("size > 0").withColumn("play", F.explode(plays))
           .select("row", F.col("play")["slot"].alias("slot")))
    return (out.repartition(F.expr("slot DIV 64")).sortWithinPartitions("slot").select("row.*"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS same,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey FROM documents),
c AS (SELECT *, md5(same || ':' || CAST((row_number() OVER (PARTITION BY skey, same) - 1) // {BUCKET_ROWS} AS VARCHAR)) AS mixkey FROM d),
p AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
        [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY skey) - 1) % {len(WEIGHTS)} + 1] AS weight FROM d GROUP BY skey),
r AS (SELECT *, source_size * {MOST} AS cap, CAST(source_size * {MOST} AS DOUBLE) / weight AS ratio,
        CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} AS total FROM p),
l AS (SELECT *, (total - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / CAST(sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
w AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM l),
t AS (SELECT skey, source_size, CASE WHEN water IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), water * weight) END AS target FROM w),
u AS (SELECT *, CAST(round(target) AS BIGINT) AS take FROM t),
v AS (SELECT *, CAST(coalesce(sum(take) OVER (ORDER BY skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS cum,
        CAST(sum(take) OVER () AS DOUBLE) AS whole, CAST(sum((take + {BLOCK} - 1) // {BLOCK}) OVER () AS BIGINT) AS length FROM u),
k AS (SELECT g AS position, fmod((g >> 26) * CAST({GOLDEN_HIGH!r} AS DOUBLE) + (g & {(1 << 26) - 1}) * CAST({GOLDEN!r} AS DOUBLE), 1.0) AS x
      FROM generate_series(0, (SELECT coalesce(max(length), 0) - 1 FROM v)) s(g)),
h AS (SELECT skey, position, row_number() OVER (PARTITION BY skey ORDER BY position) - 1 AS rank
      FROM k JOIN v ON take > 0 AND x >= cum / whole AND x < (cum + take) / whole),
b AS (SELECT c.*, source_size, target, take, length, CAST(coalesce(sum(size) OVER (PARTITION BY c.skey ORDER BY mixkey, doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c JOIN v USING (skey)),
o AS (SELECT *, CAST(greatest(least(start + size, take) - start, 0) + greatest(least(start + size, take - source_size) - start, 0) AS BIGINT) AS taken FROM b)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN coalesce(h.position, length) END AS first_slot
FROM o LEFT JOIN h ON h.skey = o.skey AND h.rank = o.start // {BLOCK}"""
