"""Sharding by extendible hashing, with built-in expressions only.

A document's key is 60 bits of a hash over its id and text. The directory
starts with one bucket; a bucket above the byte limit splits on the next bit
of the key, until every shard fits. The splits are decided on sums: bytes are
summed (map-side combined) per prefix of the deepest level of a round, every
prefix is rolled up to its ancestors, and a leaf takes its shallowest ancestor
that fits. Leaves that do not fit at a round's depth go into the next round,
STEP bits deeper; so a later round reads only what is still too large.

A bucket with a single document is a shard at any size. Rows with all 60 bits
equal (same id and text) cannot be split by bits; their shard overflows into
pages that fit the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tarmac.llm.common import fresh, grouped_prefix, materialise

BITS = 60
STEP = 8                   # bits that a round adds
LIMIT = 1 << 20            # bytes of a shard
CHUNK = 10_000             # copies of one row numbered at a time


def key_column() -> Column:
    """60 bits of a hash over id and text; a NULL id is ``-``, a NULL text empty."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", BITS - depth)


def directory(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, bytes, docs) of every shard that holds a document.

    ``sized``: (key, bytes). The leading ``depth`` bits of a key equal to
    ``prefix`` name its shard; shards do not overlap. The first round's depth
    follows the total size, so most buckets settle in it.
    """
    total = int(sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"])
    depth = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + 3)
    top, settled, rest = 0, None, sized
    while True:
        leaf = materialise(rest.groupBy(_prefix(depth).alias("leaf"))
                           .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "leaves")
        sums = (leaf.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(depth))))
                .groupBy("depth", F.expr(f"shiftrightunsigned(leaf, {depth} - depth)").alias("prefix"))
                .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")))
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1)
        if depth == BITS:
            fits = fits | (F.col("depth") == BITS)
        # A bucket that fits is a shard if its parent does not, or if it has no parent.
        split = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        child = sums.where(fits).withColumn("parent", F.shiftrightunsigned("prefix", 1))
        found = child.join(split, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes", "docs")
        if top == 0:
            found = found.unionByName(sums.where(fits & (F.col("depth") == 0)).select("depth", "prefix", "bytes", "docs"))
        found = materialise(found, "shards")
        settled = found if settled is None else settled.unionByName(found)
        if depth == BITS:
            return settled
        late = materialise(leaf.where((F.col("bytes") > limit) & (F.col("docs") > 1)).select("leaf"), "late")
        if late.isEmpty():
            return settled
        rest = rest.withColumn("leaf", _prefix(depth)).join(late, "leaf", "left_semi").drop("leaf")
        top, depth = depth, min(BITS, depth + STEP)


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, bytes, key, depth, shard, shard_bytes, shard_docs, page), one
    row per input row. ``shard``: the bits of its prefix as text (empty: the
    only shard); ``shard_bytes`` and ``shard_docs`` count all its pages.

    ``bytes`` is the UTF-8 size of the text, 0 for NULL and empty texts;
    repeated rows have equal keys and share a shard, or its pages; an empty
    table gives an empty result; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_column().alias("key"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    rows = materialise(rows, "keys")                      # the texts are hashed once
    shards = materialise(directory(rows.select("key", "bytes"), limit), "directory")
    depths = sorted(int(r["depth"]) for r in shards.select("depth").distinct().collect())     # at most 61
    levels = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths or [0]])
    out = (rows.withColumn("c", F.explode(levels)).select("doc_id", "key", "bytes", "c.depth", "c.prefix")
           .join(shards.withColumnsRenamed({"bytes": "shard_bytes", "docs": "shard_docs"}), ["depth", "prefix"]))
    bits = F.expr(f"substring(lpad(bin(prefix), {BITS}, '0'), {BITS + 1} - depth, depth)")
    out = out.withColumn("shard", bits).drop("prefix")
    over = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    cols = ["doc_id", "bytes", "key", "depth", "shard", "shard_bytes", "shard_docs", "page"]
    plain = out.withColumn("page", F.lit(0).cast("long"))
    if depths and depths[-1] == BITS:
        # Equal rows are told apart by number only: count them and write the numbers out, in chunks.
        copies = out.where(over).groupBy(*cols[:-1]).agg(F.count(F.lit(1)).alias("n"))
        chunk = copies.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
        number = chunk.withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("n")) - 1)))
        room = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
        paged = number.withColumn("page", F.floor(F.col("at") / room).cast("long"))
        return plain.where(~over).select(cols).unionByName(paged.select(cols))
    return plain.select(cols)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write all columns of ``docs`` below ``path``, one folder for each shard
    (column ``shard``, or a free name derived from it) and in it one for each
    page (column ``page``, likewise); a page is a file.

    Equal rows of an oversized shard are written to the shared folder once and
    numbered by their place there, so a task that runs again gives equal pages."""
    key, name, page = (fresh(docs, c) for c in ("_key", "shard", "page"))
    shards = assign(docs, limit).groupBy("key").agg(F.concat(F.lit("b"), F.first("shard")).alias("_shard"),   # the empty prefix needs a folder name
                                                    (F.max("page") + 1).alias("_pages"))
    shards = materialise(shards.select(F.col("key").alias(key), "_shard", "_pages"), "shardkeys")
    rows = docs.select(key_column().alias(key), F.struct(*docs.columns).alias("_row")).join(shards, key)
    out = rows.where("_pages = 1").select("_row", "_shard", F.lit(0).cast("long").alias("_page"))
    if not shards.where("_pages > 1").isEmpty():
        many = materialise(rows.where("_pages > 1").select(key, "_row", "_shard"), "copies")
        at = many.metadataColumn("_metadata")
        many = many.select("*", at["row_index"].alias("_place"), F.lit(1).alias("_one"),
                           F.struct(at["file_path"].alias("file"), F.floor(at["row_index"] / CHUNK).alias("chunk")).alias("_chunk"))
        many = grouped_prefix(many, [key], "_chunk", [F.col("_place")], "_one", "_number")
        size = F.greatest(F.coalesce(F.octet_length("_row.text"), F.lit(0)), F.lit(1))
        room = F.greatest(F.floor(F.lit(limit) / size), F.lit(1))
        out = out.unionByName(many.select("_row", "_shard", F.floor(F.col("_number") / room).cast("long").alias("_page")))
    out = out.select("_row.*", F.col("_shard").alias(name), F.col("_page").alias(page))
    out.repartition(F.col(name), F.col(page)).write.partitionBy(name, page).parquet(path)


# Sums of every prefix length at once; a document takes its shortest prefix that fits. Equal keys overflow into pages.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
p AS (SELECT d.*, CAST(g AS INT) AS depth, key >> ({BITS} - g) AS prefix FROM d, generate_series(0, {BITS}) t(g)),
s AS (SELECT depth, prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
m AS (SELECT p.doc_id, p.key, p.bytes, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix)
      WHERE shard_bytes <= {LIMIT} OR shard_docs = 1 OR depth = {BITS} GROUP BY ALL)
SELECT d.doc_id, CAST(d.bytes AS BIGINT) AS bytes, m.depth,
  substr(right(bin(d.key + (CAST(1 AS BIGINT) << {BITS})), {BITS}), 1, m.depth) AS shard, shard_bytes, shard_docs,
  CASE WHEN m.depth = {BITS} AND shard_bytes > {LIMIT} AND shard_docs > 1
    THEN CAST(floor((row_number() OVER (PARTITION BY d.doc_id, d.key, d.bytes) - 1)
                    / greatest({LIMIT} // greatest(d.bytes, 1), 1)) AS BIGINT) ELSE 0 END AS page
FROM d JOIN m ON d.key = m.key AND d.doc_id IS NOT DISTINCT FROM m.doc_id
JOIN s ON s.depth = m.depth AND s.prefix = d.key >> ({BITS} - m.depth)"""
