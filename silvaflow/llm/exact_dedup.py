"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of BLOCK bytes. The distinct blocks are sorted and numbered; the number is the
block's name. Then neighbouring names are paired, the distinct pairs sorted and numbered, and so on until each document
has one name. Two documents with as many blocks have the same name if and only if their texts are equal byte for byte:
names stand for contents, never for hashes of them.

Null text counts as empty; an empty text has one empty block. Rows that share a doc_id are told apart by their text,
rows that share both count as so many members of their group. A null doc_id is an id like others, but stays only where
the whole group has none. Very long texts are cut into blocks like others; ties don't arise. Other columns of the input stay
as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hottest, join_bearing_hot

BLOCK = 4096
#: Stands for "no right neighbour"; never a name.
NONE = -(1 << 62)


def normalised(text: Column) -> Column:
    """text with each run of [\\x20\\x09-\\x0D] replaced by one space; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a column name: one integer for each distinct key, in sorted order within its share of the keys.

    Keys that very many rows hold are told by a hash, numbered apart (below zero) and joined by broadcast; all others
    are aggregated where they lie, shuffled once, numbered there, and joined to their rows in the same partition."""
    tag = F.xxhash64(*keys)
    hot = [r.tag for r in hottest(rows.groupBy(tag.alias("tag")).agg(F.count("*").alias("n")), ["tag"]).collect()]
    rest = rows.filter(~tag.isin(hot)) if hot else rows
    names = (
        rest.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .drop("n")
        .sortWithinPartitions(*keys)
        .withColumn("name", F.monotonically_increasing_id())
    )
    out = rest.join(names.hint("merge"), keys).drop(*keys)
    if hot:
        few = rows.filter(tag.isin(hot)).select(*keys).distinct().orderBy(*keys).collect()
        numbered = rows.sparkSession.createDataFrame(
            [(*r, -1 - i) for i, r in enumerate(few)], rows.select(*keys).withColumn("name", F.lit(0).cast("long")).schema
        )
        out = out.unionByName(rows.filter(tag.isin(hot)).join(F.broadcast(numbered), keys).drop(*keys))
    return out


def identities(docs: DataFrame, doc_id: str, text: Column, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, n_blocks, name: n_blocks and name are equal for two rows if and only if their texts are. fp, a hash of
    the text, only tells rows apart that share a doc_id; rows equal in both may come as one or several rows."""
    data = docs.select(F.col(doc_id).alias("doc_id"), text.cast("binary").alias("data")).withColumn("fp", F.xxhash64("data"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block)).cast("int")
    piece = lambda i: F.substring(F.col("data"), i * block + 1, F.lit(block))
    blocks = data.select("doc_id", "fp", n.alias("n_blocks"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), piece)).alias("pos", "block"))
    level = cut(named(blocks, ["block"]))
    done = level.filter("n_blocks = 1").drop("pos")
    left = level.filter("n_blocks > 1")
    width = left.agg(F.max("n_blocks")).first()[0] or 1
    step = 1
    while step < width:
        step *= 2
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        half = F.shiftright("pos", 1).alias("half")
        pairs = left.groupBy("doc_id", "fp", "n_blocks", half).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(NONE)).alias("b"))
        level = cut(named(pairs.withColumnRenamed("half", "pos"), ["a", "b"]))
        # a document is done as soon as one name of this level covers it
        done = done.unionByName(level.filter(F.col("n_blocks") <= step).drop("pos"))
        left = level.filter(F.col("n_blocks") > step)
    return done


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, fp, copies (rows with both), keep_id, group_size, kept."""
    norm = normalised(F.col(text))
    ids = identities(docs, doc_id, norm, block).distinct()
    copies = docs.groupBy(F.col(doc_id).alias("doc_id"), F.xxhash64(norm.cast("binary")).alias("fp")).agg(F.count("*").alias("copies"))
    ids = cut(ids.join(copies.filter("copies > 1"), [F.equal_null(ids.doc_id, copies.doc_id), ids.fp == copies.fp], "left").select(ids["*"], F.coalesce("copies", F.lit(1)).alias("copies")))
    groups = ids.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = join_bearing_hot(ids, cut(groups), ["n_blocks", "name"], "group_size")
    return out.select("doc_id", "fp", "copies", "keep_id", "group_size", F.equal_null("doc_id", "keep_id").alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text equals that of a row with a smaller doc_id; of rows that share doc_id and text,
    one stays."""
    kept = cut(exact_groups(docs).filter("kept").select("doc_id", "fp", "copies"))
    own = F.xxhash64(normalised(docs["text"]).cast("binary"))
    same = lambda other: [F.equal_null(docs["doc_id"], other["doc_id"]), own == other["fp"]]
    out = docs.join(kept, same(kept), "left_semi")
    many = kept.filter("copies > 1")
    if many.isEmpty():
        return out
    rows = out.join(many, same(many), "left_semi").select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"], own.alias("fp"))
    once = rows.groupBy("doc_id", "fp").agg(F.first("row").alias("row")).select("row.*")
    return out.join(many, same(many), "left_anti").unionByName(once)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = normalised(F.col("text")).cast("binary")
    sha = docs.select("doc_id", F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"))
    groups = exact_groups(docs).drop("copies")
    return groups.join(sha, [F.equal_null(groups.doc_id, sha.doc_id), groups.fp == sha.fp]).select(groups["*"], "text_sha256").drop("fp")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
