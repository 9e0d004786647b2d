"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed size. Distinct blocks are sorted and their places in that order are
their integer names. Then neighbouring names are paired, distinct pairs are sorted and named in the same way, again
and again, until a text has one name left. Names stand for contents one to one, so equal names (of texts with equally
many characters) mean equal texts, and no hash is trusted.

Whole blocks are not sorted as they are, which would move every text several times more: they are sorted by a pair of
integers that stands for the content one to one, the 64-bit hash and the place of the content among the sorted
contents of that hash. Nearly every hash has one content, whose place is 0. ``shared_buckets`` proves that by grouping
the contents themselves, each of which crosses the network once per input partition that holds it. From then on only
integers move.

Only DataFrame functions are used. Copies are merged before each shuffle, so a block that a third of all texts hold
is one row a task, and the joins of names to places are ones that Spark splits where a name is frequent.

Defined results: a null text counts as empty, empty texts are equal; ids may repeat or be null (the smallest stays, null
ids last; of rows that agree in id and text ``keep_first`` lets one stay); very long texts are cut into as many blocks
as they need; an empty table gives an empty one; ``keep_first`` passes all other columns on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few, fresh, materialise

#: Characters in a block; most texts have several.
BLOCK = 1024
#: Rows of about 100 bytes that may be broadcast.
FEW = 1 << 18
#: Text is normalised by replacing each run of white space by one space; runs that are one space already are left.
SPACES = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def blocks_of(text: Column, size: int = BLOCK) -> Column:
    """The text in blocks of ``size`` characters (one empty block for an empty text), in one pass."""
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def bucket_of(*content: Column) -> Column:
    return F.xxhash64(*content)


def shared_buckets(blocks: DataFrame) -> DataFrame:
    """Buckets that hold two or more contents, with these sorted: (bucket, contents)."""
    distinct = blocks.groupBy("bucket", "block").agg(F.lit(1).alias("one"))
    several = materialise(distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    if several.isEmpty():
        return several.select("bucket", F.lit(None).cast("array<string>").alias("contents"))
    again = blocks.join(several, "bucket", "left_semi")
    return materialise(again.groupBy("bucket").agg(F.sort_array(F.collect_set("block")).alias("contents")))


def integers(contents: DataFrame, *keys: str) -> DataFrame:
    """(keys, name): distinct contents, sorted, with their places in the order as integer names (rising, not without gaps)."""
    return materialise(contents.select(*keys).distinct().orderBy(*keys).withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK, bucket=bucket_of) -> DataFrame:
    """``docs`` as (doc_id, text_sha256, n_chars, name): the last two together are the identity of the text."""
    base = docs.select(F.col(doc_id).alias("doc_id"), normalise(F.col(text)).alias("body"))
    base = base.select("doc_id", F.sha2("body", 256).alias("text_sha256"), F.char_length("body").alias("n_chars"), blocks_of(F.col("body"), size).alias("blocks"))
    blocks = base.select(F.explode("blocks").alias("block")).select(bucket(F.col("block")).alias("bucket"), "block")
    shared = shared_buckets(blocks)
    if shared.isEmpty():
        named = base.select("doc_id", "text_sha256", "n_chars", F.transform("blocks", lambda b: F.struct(bucket(b).alias("bucket"), F.lit(0).alias("place"))).alias("names"))
    else:
        rows = materialise(base.withColumn("row", F.monotonically_increasing_id()))
        cells = rows.select("row", F.posexplode("blocks").alias("at", "block")).select("row", "at", "block", bucket(F.col("block")).alias("bucket"))
        place = F.coalesce(F.array_position("contents", F.col("block")) - 1, F.lit(0)).cast("int")
        cells = cells.join(shared, "bucket", "left").select("row", F.struct("at", "bucket", place.alias("place")).alias("cell"))
        lists = cells.groupBy("row").agg(F.transform(F.sort_array(F.collect_list("cell")), lambda c: F.struct(c.bucket.alias("bucket"), c.place.alias("place"))).alias("names"))
        named = rows.drop("blocks").join(lists, "row").drop("row")
    # From here on the rows are small: two integers for each block.
    named = materialise(named.withColumn("row", F.monotonically_increasing_id()))
    cells = named.select("row", F.size("names").alias("left"), F.posexplode("names").alias("at", "c")).select("row", "left", "at", "c.bucket", "c.place")
    cells = cells.join(integers(cells, "bucket", "place"), ["bucket", "place"]).select("row", "left", "at", "name")
    done, more = _split(cells)
    while not more.isEmpty():
        half = F.shiftright("at", 1)
        side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
        # An odd name at the end is paired with nothing, which no name is.
        pairs = more.groupBy("row", half.alias("at")).agg(F.max("left").alias("left"), side(0).alias("first"), F.coalesce(side(1), F.lit(-1)).alias("second"))
        pairs = materialise(pairs.withColumn("left", F.shiftright(F.col("left") + 1, 1)))
        numbers = integers(pairs, "first", "second")
        cells = pairs.join(numbers, ["first", "second"]).select("row", "left", "at", "name")
        ended, more = _split(cells)
        discard(pairs, numbers)
        done = done.unionByName(ended)
    return named.drop("names").join(done, "row").drop("row")


def _split(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that have one name left, and the cells of the others."""
    cells = materialise(cells)
    return cells.where(F.col("left") == 1).select("row", "name"), cells.where(F.col("left") > 1)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK, bucket=bucket_of) -> DataFrame:
    """One row per document: the id that stays of its group, the group's size, and whether this row's id is that one.

    Rows of a group that have the same id, or no id at all, share the verdict; ``keep_first`` lets one of them stay.
    """
    rows = materialise(identities(docs, doc_id, text, size, bucket))
    key = ["n_chars", "name"]
    kept = materialise(rows.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(kept, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with its own columns: that of the smallest id, null ids last, whatever ids repeat."""
    found = groups(docs, doc_id, text)
    g_id, g_sum, total = (fresh(docs, x) for x in ("g_id", "g_sum", "_sum"))
    drop = few(materialise(found.where("not kept").select(F.col("doc_id").alias(g_id), F.col("text_sha256").alias(g_sum)).distinct()), FEW)
    tagged = docs.withColumn(total, F.sha2(normalise(F.col(text)), 256))
    rest = tagged.join(drop, F.col(doc_id).eqNullSafe(F.col(g_id)) & (F.col(total) == F.col(g_sum)), "left_anti")
    again = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (rest if again.isEmpty() else rest.dropDuplicates([doc_id, total])).drop(total)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""
