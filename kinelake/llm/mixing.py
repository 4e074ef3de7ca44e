"""Mixing sources to target weights by packed blocks and index permutations, in DataFrame functions only.

1. Every source's documents are laid end to end in a fixed pseudorandom order and cut into blocks of
   ``block`` words (prefix sums over small chunks of a source, then over groups of chunks, then over the groups).
2. Targets: weights share all sizes; a target stops at ``times`` its source's size and the excess is
   reshared by weight (water filling over the sorted sources).
3. The mix is output shards of ``shard`` slots.  Each slot draws its source from the targets, so a shard's
   source counts are multinomial.  Draws beyond a source's quota of slots are handed to sources that fell
   short, so the totals meet the quotas exactly; these are about the square root of all draws.
4. A source's slots are numbered through the shards; number ``j`` is block ``perm(j mod blocks)`` of pass
   ``j div blocks``, with a new pseudorandom permutation for each source and pass (swap-or-not rounds,
   which permute any range of numbers exactly).  Blocks join documents by index.

No step puts one source's documents, shards or blocks into one task: documents meet by chunk, shards by ``GROUP`` neighbours,
blocks by number.  One task sees a row for each ``GROUP`` chunks or shards of a source (half a million documents,
or 67 million words), and ``source_table`` one for each source.

Memory: DataFrame operators only, whose sorts and joins spill; the table of sources is broadcast up to ``BROADCAST_SOURCES`` rows.

Defined results: null text has size 0; documents of size 0 take 0 words; null sources form one source,
last in order; a source without words has target 0; repeated rows are rows of their own; extra columns
are ignored; an empty table gives an empty mix.  Reruns agree: all draws are hashes of fixed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.llm._common import WORD, materialize, word_count

WEIGHTS = (5, 2, 1)
TIMES = 3
BLOCK = 64
SHARD = 1024
CHUNK = 512
#: Chunks or shards that a prefix sum goes through at once.
GROUP = 1024
SEED = 20240229
ROUNDS = 18
#: Pieces of the draw range that the sources' ranges are filed under.
RANGES = 4096
#: Sources up to which their table is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not: a bijection of ``0..n-1`` for each ``key``, whatever ``n``."""

    def one(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - x, n)
        swap = F.xxhash64(F.lit(SEED + 1), r, *key, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.reduce(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), one)


def prefix_sums(rows: DataFrame, value: str, unit: str, *by: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over smaller ``unit`` of the same ``by``; units are distinct there.

    Sums run over ``GROUP`` neighbouring units, and over the groups' totals.
    """
    rows = rows.withColumn("group", F.floor(F.col(unit) / GROUP))
    earlier = lambda unit, *by: Window.partitionBy(*by).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "group").agg(F.sum(value).alias("of_group"))
    totals = totals.withColumn("start", F.coalesce(F.sum("of_group").over(earlier("group", *by)), F.lit(0))).drop("of_group")
    inside = F.coalesce(F.sum(value).over(earlier(unit, *by, "group")), F.lit(0))
    return rows.join(totals, [*by, "group"]).withColumn("before", F.col("start") + inside).drop("group", "start")


def source_table(sizes: DataFrame, weights=WEIGHTS, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """One row per source: index, size, documents, weight, target, blocks, quota of slots, and its range of draws."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("s", F.row_number().over(one) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("s", F.lit(len(weights))) + 1))
    cap = F.lit(float(times)) * F.col("source_size")
    rising = Window.orderBy(cap / F.col("w"), "s")
    every = Window.partitionBy()
    per = per.withColumn("cap", cap)
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest_w", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.col("before")) / F.col("rest_w"))
    per = per.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))).over(every))
    per = per.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.col("level") * F.col("w"))))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    quota = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * times)
    per = per.withColumn("quota", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(quota).cast("long"))
    upto = Window.orderBy("s")
    per = per.withColumn("draw_end", F.sum("quota").over(upto)).withColumn("draw_start", F.col("draw_end") - F.col("quota"))
    return per.withColumn("draws", F.sum("quota").over(every)).drop("before", "rest_w", "level", "cap", "w")


def slot_table(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """The mix: rows ``shard, s, j, pass, block`` where ``j`` numbers a source's slots through the shards."""
    spark = sources.sparkSession
    width = F.greatest(F.ceil(F.col("draws") / F.lit(RANGES)), F.lit(1)).cast("long")
    ranges = sources.where("quota > 0").select(
        "s", "draw_start", "draw_end", F.explode(F.sequence(F.floor(F.col("draw_start") / width), F.floor((F.col("draw_end") - 1) / width))).alias("piece")
    )
    total = sources.agg(F.max("draws").alias("draws")).where("draws > 0")
    shards = total.select("draws", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / shard))).alias("shard"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = shards.repartition(parts, "shard").select(
        "draws", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard).cast("long"), F.col("draws") - F.col("shard") * shard) - 1)).alias("slot")
    )
    draw = F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", "slot"), "draws")
    drawn = slots.withColumn("u", draw).withColumn("piece", F.floor(F.col("u") / width))
    drawn = drawn.join(ranges, (drawn["piece"] == ranges["piece"]) & (F.col("u") >= F.col("draw_start")) & (F.col("u") < F.col("draw_end")))
    counts = materialize(drawn.groupBy("shard", "s").agg(F.count("*").alias("m")), "mix-draws")
    # Meet the quotas: a source's draws count up to its quota, the rest goes to sources that fell short.
    quotas = sources.where("quota > 0").select("s", "quota")
    held = prefix_sums(counts, "m", "shard", "s").join(quotas, "s")
    held = materialize(held.select("shard", "s", "m", F.greatest(F.lit(0), F.least(F.col("m"), F.col("quota") - F.col("before"))).alias("kept")), "mix-held")
    spare = held.groupBy("shard").agg(F.sum(F.col("m") - F.col("kept")).alias("spare")).where("spare > 0")
    spare = prefix_sums(spare, "spare", "shard").repartition(parts, "shard")
    spare = spare.select("shard", F.explode(F.sequence("before", F.col("before") + F.col("spare") - 1)).alias("e"))
    short = quotas.join(held.groupBy("s").agg(F.sum("kept").alias("kept")), "s", "left").withColumn("short", F.col("quota") - F.coalesce("kept", F.lit(0))).where("short > 0")
    short = short.withColumn("start", F.sum("short").over(Window.orderBy("s")) - F.col("short"))  # a row for each source
    short = short.select("s", F.explode(F.sequence("start", F.col("start") + F.col("short") - 1)).alias("e"))
    moved = spare.join(short, "e").groupBy("shard", "s").agg(F.count("*").alias("m"))
    final = held.select("shard", "s", F.col("kept").alias("m")).unionByName(moved.select("shard", "s", "m")).groupBy("shard", "s").agg(F.sum("m").alias("m")).where("m > 0")
    final = prefix_sums(materialize(final, "mix-final"), "m", "shard", "s").join(sources.select("s", "blocks"), "s").repartition(parts, "shard", "s")  # few bytes here, many rows from here on
    numbered = final.select("shard", "s", "blocks", F.explode(F.sequence("before", F.col("before") + F.col("m") - 1)).alias("j"))
    numbered = numbered.withColumn("pass", F.floor(F.col("j") / F.col("blocks")))
    return numbered.select("shard", "s", "j", "pass", permuted(F.pmod("j", "blocks"), F.col("blocks"), F.col("s"), F.col("pass")).alias("block"))


def packed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with ``s``, the source's figures and ``offset``, the document's place in its source's stream of words."""
    few = sources.count() <= BROADCAST_SOURCES
    table = sources.select("source", "s", "source_size", "target", "n_docs")
    table = F.broadcast(table) if few else table
    docs = sizes.join(table, sizes["source"].eqNullSafe(table["source"])).drop(table["source"])
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.ceil(F.col("n_docs") / CHUNK)))
    inside = Window.partitionBy("s", "chunk").orderBy("doc_id", "text_hash", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    chunks = prefix_sums(docs.groupBy("s", "chunk").agg(F.sum("size").alias("chunk_size")), "chunk_size", "chunk", "s").drop("chunk_size")
    return docs.join(chunks, ["s", "chunk"]).withColumn("offset", F.col("before") + F.col("inside")).drop("chunk", "inside", "before", "n_docs")


def with_sizes(docs: DataFrame, *keep: Column) -> DataFrame:
    """``docs`` with a row key, the size and a hash of the text, written once so the key is fixed."""
    cols = [F.monotonically_increasing_id().alias("uid"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")]
    return materialize(docs.select(*cols, *keep), "mix-sizes")


def mix(sizes: DataFrame, weights=WEIGHTS, times: int = TIMES, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The documents with their figures, and their parts in the mix: rows ``uid, start, n, takes, passes``.

    A part is the words ``start .. start+n-1`` of a document that lie in one block; ``takes`` is how often the
    mix takes that block and ``passes`` how many whole passes over the source it makes.
    """
    sources = materialize(source_table(sizes, weights, times, block), "mix-sources")
    docs = packed(sizes, sources)
    taken = materialize(slot_table(sources, shard).groupBy("s", "block").agg(F.count("*").alias("takes")), "mix-taken")
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    parts = docs.where("size > 0").select("uid", "doc_id", "s", "size", "source_size", "target", "offset", F.explode(F.sequence(first, last)).alias("block"))
    parts = parts.withColumn("start", F.greatest(F.lit(0), F.col("block") * block - F.col("offset")))
    parts = parts.withColumn("n", F.least("size", (F.col("block") + 1) * block - F.col("offset")) - F.col("start"))
    parts = parts.join(taken, ["s", "block"], "left").withColumn("takes", F.coalesce("takes", F.lit(0)))
    return docs, parts


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, parts = mix(with_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    words = parts.groupBy("uid", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("n") * F.col("takes")).alias("taken")).drop("uid")
    none = docs.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return words.unionByName(none)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix.

    A document comes once for every time all of its blocks are taken, with its text unchanged, and once more
    with the words of the blocks taken beyond that, if any.  Documents no block of which is drawn go.
    """
    kept = with_sizes(docs, F.struct(*docs.columns).alias("row"))
    _, parts = mix(kept.drop("row"))
    whole = parts.groupBy("uid").agg(F.min("takes").alias("whole"), F.sort_array(F.collect_list(F.struct("start", "n", "takes"))).alias("parts"))
    rows = kept.join(whole, "uid").withColumn("words", F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)))
    extra = F.filter("parts", lambda p: p["takes"] > F.col("whole"))
    some = F.array_join(F.flatten(F.transform(extra, lambda p: F.slice("words", (p["start"] + 1).cast("int"), p["n"].cast("int")))), " ")
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("whole").cast("int")), F.when(F.size(extra) > 0, F.array(some)).otherwise(F.array().cast("array<string>")))
    rows = rows.select("row", F.explode(texts).alias("new"))
    put = {"text": F.col("new"), "n_chars": F.length("new")}
    return rows.select(*[(put[f.name].cast(f.dataType) if f.name in put else F.col("row")[f.name]).alias(f.name) for f in docs.schema])
