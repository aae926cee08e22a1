"""Mixing sources to target weights, in DataFrame functions only.

Sizes are words. Each source is one stream of words, its documents in a fixed
order, packed into blocks of ``block`` words. A source's target is a number of
words; its slots are as many whole passes over its blocks as fit, and a last,
partial pass that stops within a block where the target is met.

The mix is made of output shards of ``shard_slots`` slots. Each slot of a shard
draws a source with the sources' shares of all slots as probabilities, so a
shard's counts by source are multinomial. The counts decide which slots of a
source the shard gets: the next ones, as long as the source has any; the slots
that are left over in the end make the last shards, which reconcile the counts
with the targets. Slot k of a source takes block p(k mod blocks), where p is a
pseudorandom permutation of the source's block indexes, another one for each
pass ("swap-or-not": a fixed number of rounds that each swap an index with its
mirror image or don't, an exact permutation of any number of indexes). Another
permutation orders the slots of a shard.

Shards' slots join the documents' stretches of blocks by index: ``mix`` gives
the words that the mix takes of each document, ``packed`` the blocks with their
text. No source lies in one task: offsets are sums over ``parts`` parts of a
source and then within a part, draws and slots are made in runs, and joins are
on (source, block).

Defined cases: a null or empty text has size 0 and gives nothing; a very long
text gives pieces of many blocks; null is a source of its own, the last; null
ids come first in their part; of rows equal in id, source and size each is a
stretch of its own; sources without words have target 0; other columns aren't
read, whatever their names; an empty table gives an empty result. The same
input gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, PARTS, ROUNDS, SHARD_SLOTS, RUN, RUNS_A_TASK, SEED = 256, 1 << 16, 16, 1 << 14, 4096, 4, 20240229
#: Stretches of the number line of draws, each with few sources, and rows that a running sum takes in one task.
CELLS, FAN = 4096, 256
#: Sources up to which their table is broadcast.
FEW_SOURCES = 1 << 16
_P = 2147483647
#: A word of the corpus.
WORD = r"[^\x20\x09-\x0D]+"


# The permutation, as SQL text that differs only in the sign of integer division.


def _round_key(rank: str, epoch: str, r: str) -> str:
    return f"(({SEED} + {rank} * 7919 + {epoch} * 104729 + {r} * 1299709) % {_P})"


def _scrambled(c: str) -> str:
    """A second number from a round's key."""
    return f"((({c} * 69621 + 12345) % {_P}) * 48271 % {_P})"


def _wide(c: str) -> str:
    """A number below 2^62 from a round's key, for mirrors anywhere among the indexes."""
    return f"({_scrambled(c)} * {_P} + {_scrambled(_scrambled(c))})"


def _swapped(x: str, k: str, c: str, n: str, div: str) -> str:
    """One round: x, or its mirror image in [0, n)."""
    mirror = f"(({k} % {n} + {n} - {x}) % {n})"
    upper = f"greatest({x}, {mirror})"
    t = f"((({upper} * 48271 + {c}) % {_P}) * 69621 % {_P})"
    return f"CASE WHEN (({t} * {t} + {upper}) % {_P}) {div} 1024 % 2 = 1 THEN {mirror} ELSE {x} END"


def _keys(rank: str, epoch: str) -> F.Column:
    c = _round_key(rank, epoch, "r")
    return F.expr(f"transform(sequence(1L, {ROUNDS}L), r -> struct({_wide(c)} AS k, {c} AS c))")


def permuted(x: str, keys: str, n: str, *, inverse: bool = False) -> F.Column:
    """The image of x among n indexes; rounds are their own inverses."""
    rounds = f"reverse({keys})" if inverse else keys
    return F.expr(f"aggregate({rounds}, CAST({x} AS BIGINT), (x, r) -> {_swapped('x', 'r.k', 'r.c', n, 'div')})")


def _before(rows: DataFrame, at: str, size: str) -> DataFrame:
    """Add ``before``: the sum of ``size`` over the rows of the same rank with a smaller ``at``, in two levels."""
    order = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("fan", F.expr(f"{at} div {FAN}"))
    far = near.groupBy("rank", "fan").agg(F.sum(size).alias("fan_size"))
    far = far.select("rank", "fan", F.coalesce(F.sum("fan_size").over(order("rank").orderBy("fan")), F.lit(0)).alias("far"))
    near = near.withColumn("near", F.coalesce(F.sum(size).over(order("rank", "fan").orderBy(at)), F.lit(0)))
    return near.join(far.hint("merge"), ["rank", "fan"]).withColumn("before", F.expr("far + near")).drop("fan", "far", "near")


# The plan of the sources


def plan(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row a source: rank, source, source_size, weight, target, blocks, and its slots.

    Targets share ``share`` times all words by weight and stop at ``most`` times
    the source's size; what is over is shared again, which is solved in one pass
    in the order in which sources reach their stop.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("rank", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest)
    shared = ranked.withColumn("level", level).withColumn("full", F.col("source_size") * most / F.col("weight") <= F.col("level"))
    first = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") * most / F.col("weight"), F.col("rank"), F.col("level").alias("at")))).over(everything)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(first["at"] * F.col("weight"))
    out = shared.withColumn("target", target).select("rank", "source", "source_size", "weight", "target")
    out = out.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    out = out.withColumn("passes", F.expr("CASE WHEN source_size > 0 THEN words div source_size ELSE 0L END"))
    out = out.withColumn("need", F.expr("words - passes * source_size")).withColumn("lack", F.expr(f"blocks * {block} - source_size"))
    # Where the short last block stands in the partial pass decides how many blocks that pass takes.
    out = out.withColumn("keys", _keys("rank", "passes"))
    out = out.withColumn("short_at", F.when(F.col("blocks") > 0, permuted("blocks - 1", "keys", "blocks", inverse=True)))
    out = out.withColumn("due", F.expr(f"CASE WHEN short_at < need div {block} OR short_at = need div {block} AND need % {block} > {block} - lack THEN need + lack ELSE need END"))
    out = out.withColumn("whole", F.expr(f"due div {block}")).withColumn("part", F.expr(f"due % {block}"))
    return out.withColumn("slots", F.expr("CASE WHEN blocks > 0 THEN passes * blocks + whole + CAST(part > 0 AS BIGINT) ELSE 0L END"))


def shard_counts(plan: DataFrame, *, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The draw: shard, rank, and the slots [first, first + n) of the source that the shard gets."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards, width = -(-total // shard_slots), -(-total // CELLS) or 1
    sums = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    lain = plan.where("slots > 0").select("rank", "slots", F.coalesce(F.sum("slots").over(sums), F.lit(0)).alias("low"))
    cells = lain.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (low + slots - 1) div {width})")))
    tasks = 1 + total // (RUNS_A_TASK * RUN)
    c = f"((id % {_P}) * 48271 + (id div {_P}) * 69621 + {SEED}) % {_P}"
    drawn = spark.range(0, total, 1, tasks).select("id", F.expr(c).alias("c"))
    drawn = drawn.select("id", F.expr(f"(c * c + c) % {_P}").alias("c")).select("id", "c", F.expr(f"(c * 48271 + 12345) % {_P}").alias("d"))
    drawn = drawn.select(F.expr(f"id div {shard_slots}").alias("shard"), F.expr(f"(((d * d + c) % {_P}) * {_P} + d) % {max(total, 1)}").alias("v"))
    met = drawn.withColumn("cell", F.expr(f"v div {width}")).join(_shared(cells), "cell").where("v >= low AND v < low + slots")
    counts = met.groupBy("shard", "rank").agg(F.count("*").alias("drawn"), F.first("slots").alias("slots"))
    summed = checkpoint(_before(counts, "shard", "drawn").withColumn("until", F.expr("before + drawn")))
    given = summed.select("shard", "rank", F.least("before", "slots").alias("first"), F.least("until", "slots").alias("end"))
    # What no draw has given makes further shards.
    ends = summed.groupBy("rank").agg(F.max("until").alias("until"))
    left = lain.join(ends, "rank", "left").withColumn("first", F.least(F.coalesce("until", F.lit(0)), "slots")).where("first < slots")
    left = left.withColumn("at", F.coalesce(F.sum(F.expr("slots - first")).over(sums), F.lit(0)))
    left = left.withColumn("k", F.explode(F.expr(f"sequence(at div {shard_slots}, (at + slots - first - 1) div {shard_slots})")))
    begin, end = F.greatest("at", F.col("k") * shard_slots), F.least(F.expr("at + slots - first"), (F.col("k") + 1) * shard_slots)
    left = left.select((F.col("k") + shards).alias("shard"), "rank", (F.col("first") + begin - F.col("at")).alias("first"), (F.col("first") + end - F.col("at")).alias("end"))
    return given.unionByName(left).where("first < end").select("shard", "rank", "first", F.expr("end - first").alias("n"))


def slots(plan: DataFrame, *, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, place, rank, slot, pass_no, block_no, words (taken from the block's start)."""
    counts = shard_counts(plan, shard_slots=shard_slots)
    tasks = 1 + plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0] // (RUNS_A_TASK * RUN)
    within = Window.partitionBy("shard")
    placed = counts.withColumn("before", F.sum("n").over(within.orderBy("rank")) - F.col("n")).withColumn("all_n", F.sum("n").over(within))
    known = placed.join(_shared(plan.select("rank", "blocks", "passes", "whole", "part")), "rank")
    runs = known.withColumn("run", F.explode(F.expr(f"sequence(first, first + n - 1, {RUN}L)")))
    # A stated number of partitions, as these small rows would be put together but make many.
    runs = runs.repartition(tasks, "rank", "run").withColumn("slot", F.explode(F.expr(f"sequence(run, least(run + {RUN}, first + n) - 1)")))
    out = runs.withColumn("pass_no", F.expr("slot div blocks")).withColumn("place_no", F.expr("slot % blocks"))
    out = out.withColumn("keys", _keys("rank", "pass_no")).withColumn("block_no", permuted("place_no", "keys", "blocks"))
    out = out.withColumn("words", F.expr(f"CASE WHEN pass_no = passes AND place_no = whole THEN part ELSE {block}L END"))
    out = out.withColumn("shard_keys", _keys("0", "shard")).withColumn("place", permuted("before + slot - first", "shard_keys", "all_n"))
    return out.select("shard", "place", "rank", "slot", "pass_no", "block_no", "words")


def _shared(sources: DataFrame) -> DataFrame:
    """The sources' table with the join that its counted size allows."""
    return F.broadcast(sources) if sources.count() <= FEW_SOURCES else sources.hint("merge")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *more)


def stretches(sizes: DataFrame, plan: DataFrame, *, parts: int = PARTS) -> DataFrame:
    """Where each document lies in its source's stream: rank, start, and the columns of ``sizes`` but source."""
    ranks = _shared(plan.select("rank", F.col("source").alias("of")))
    kept = [c for c in sizes.columns if c != "source"]
    named = sizes.where("size > 0").join(ranks, F.col("source").eqNullSafe(F.col("of")))
    # Neither ids that share a residue nor null ids fall on one part.
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 4), 16, 10).cast("long")
    named = named.select("rank", *kept, F.pmod(key, F.lit(parts)).alias("part"))
    sums = named.groupBy("rank", "part").agg(F.sum("size").alias("part_size"))
    offsets = _before(sums, "part", "part_size").select("rank", "part", F.col("before").alias("part_start"))
    within = Window.partitionBy("rank", "part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(offsets.hint("merge"), ["rank", "part"]).select("rank", *kept, (F.col("part_start") + F.col("inner")).alias("start"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, parts: int = PARTS, shard_slots: int = SHARD_SLOTS, **targets
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken words."""
    sizes = checkpoint(_sizes(docs, id_col, text_col, source_col))
    planned = checkpoint(plan(sizes, block=block, **targets))
    uses = slots(planned, block=block, shard_slots=shard_slots).groupBy("rank", "block_no").agg(
        F.sum((F.col("words") == block).cast("long")).alias("uses"), F.max(F.when(F.col("words") < block, F.col("words"))).alias("cut")
    )
    lain = stretches(sizes, planned, parts=parts)
    cells = lain.withColumn("block_no", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    begin, end = F.greatest("start", F.col("block_no") * block), F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)
    cut_end = F.least(end, F.col("block_no") * block + F.coalesce("cut", F.lit(0)))
    words = F.coalesce("uses", F.lit(0)) * (end - begin) + F.greatest(F.lit(0), cut_end - begin)
    # Stated, as sizes before an explode say nothing about those after it.
    joined = cells.join(uses.hint("merge"), ["rank", "block_no"], "left")
    taken = joined.groupBy("rank", "start", "doc_id", "size").agg(F.sum(words).cast("long").alias("taken"))
    facts = _shared(planned.select("rank", "source", "source_size", "target"))
    some = taken.join(facts, "rank").select("doc_id", "source", "size", "source_size", "target", "taken")
    of = _shared(planned.select("rank", F.col("source").alias("of"), "source_size", "target"))
    none = sizes.where("size = 0").join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of", "rank").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none)


def packed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, parts: int = PARTS, shard_slots: int = SHARD_SLOTS, **targets
) -> DataFrame:
    """The mix itself: shard, place, source, pass_no, block_no, n_words, doc_ids (in order) and the block's text."""
    planned = checkpoint(plan(_sizes(docs, id_col, text_col, source_col), block=block, **targets))
    lain = stretches(_sizes(docs, id_col, text_col, source_col, F.col(text_col).alias("text")), planned, parts=parts)
    # The outer lambda binds the words, so that they are split once a document and not once a block.
    pieces = F.expr(
        f"""transform(array(regexp_extract_all(text, r'{WORD}', 0)), w ->
              transform(sequence(start div {block}, (start + size - 1) div {block}), b -> named_struct(
                'block_no', b, 'at', greatest(start - b * {block}, 0L),
                'words', slice(w, CAST(greatest(b * {block} - start, 0L) + 1 AS INT), CAST(least(start + size, (b + 1) * {block}) - greatest(start, b * {block}) AS INT)))))[0]"""
    )
    cells = lain.select("rank", "doc_id", F.explode(pieces).alias("c")).select("rank", "c.block_no", F.struct("c.at", "doc_id", F.array_join("c.words", " ").alias("piece")).alias("p"))
    blocks = cells.groupBy("rank", "block_no").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    uses = slots(planned, block=block, shard_slots=shard_slots).groupBy("rank", "block_no").agg(F.collect_list(F.struct("shard", "place", "pass_no", "words")).alias("uses"))
    met = blocks.join(uses.hint("merge"), ["rank", "block_no"]).select("rank", "block_no", "pieces", F.explode("uses").alias("u")).select("rank", "block_no", "u.*", "pieces")
    met = met.withColumn("pieces", F.expr("filter(pieces, p -> p.at < words)"))
    words = F.slice(F.split(F.array_join("pieces.piece", " "), " "), 1, F.col("words").cast("int"))
    facts = _shared(planned.select("rank", "source"))
    out = met.join(facts, "rank").withColumn("text", words)
    return out.select("shard", "place", "source", "pass_no", "block_no", F.size("text").cast("long").alias("n_words"), F.col("pieces.doc_id").alias("doc_ids"), F.array_join("text", " ").alias("text"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def _duck_permuted(x: str, rank: str, epoch: str, n: str, *, inverse: bool = False) -> str:
    c = _round_key(rank, epoch, "r")
    order = f"generate_series({ROUNDS}, 1, -1)" if inverse else f"generate_series(1, {ROUNDS})"
    return f"list_reduce({order}, lambda x, r: {_swapped('x', _wide(c), c, n, '//')}, CAST({x} AS BIGINT))"


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM t),
w AS (SELECT *, [3, 1, 2][CAST((rank - 1) % 3 + 1 AS BIGINT)] AS weight FROM r),
v AS (
  SELECT *, source_size * 2 / weight AS stop,
         (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / CAST(sum(weight) OVER (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
g AS (
  SELECT rank, source, source_size, CASE WHEN stop <= level THEN CAST(2 * source_size AS DOUBLE)
           ELSE (SELECT level FROM v WHERE stop > level ORDER BY stop, rank LIMIT 1) * weight END AS target
  FROM v),
p1 AS (
  SELECT *, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks, CAST(floor(target + 0.5) AS BIGINT) AS words FROM g),
p2 AS (SELECT *, words // source_size AS passes, words % source_size AS need, blocks * {BLOCK} - source_size AS lack FROM p1 WHERE source_size > 0),
p3 AS (SELECT *, {_duck_permuted("blocks - 1", "rank", "passes", "blocks", inverse=True)} AS short_at FROM p2),
p4 AS (SELECT *, CASE WHEN short_at < need // {BLOCK} OR short_at = need // {BLOCK} AND need % {BLOCK} > {BLOCK} - lack THEN need + lack ELSE need END AS due FROM p3),
p5 AS (SELECT *, due // {BLOCK} AS whole, due % {BLOCK} AS part FROM p4),
k AS (SELECT *, unnest(generate_series(0, passes * blocks + whole + CAST(part > 0 AS BIGINT) - 1)) AS slot FROM p5),
s AS (
  SELECT rank, {_duck_permuted("slot % blocks", "rank", "(slot // blocks)", "blocks")} AS block_no,
         CASE WHEN slot // blocks = passes AND slot % blocks = whole THEN part ELSE {BLOCK} END AS words
  FROM k),
u AS (SELECT rank, block_no, count(*) FILTER (words = {BLOCK}) AS uses, coalesce(max(words) FILTER (words < {BLOCK}), 0) AS cut FROM s GROUP BY ALL),
n AS (
  SELECT d.doc_id, d.source, d.size, g.rank, g.source_size, g.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY g.rank ORDER BY CAST('0x' || substr(md5(concat_ws(':', d.doc_id, d.size)), 1, 4) AS BIGINT) % {PARTS}, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         row_number() OVER () AS id
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, unnest(generate_series(start // {BLOCK}, (start + size - 1) // {BLOCK})) AS block_no FROM n WHERE size > 0),
x AS (
  SELECT c.id, sum(coalesce(uses, 0) * (least(start + size, (c.block_no + 1) * {BLOCK}) - greatest(start, c.block_no * {BLOCK}))
               + greatest(0, least(start + size, (c.block_no + 1) * {BLOCK}, c.block_no * {BLOCK} + coalesce(cut, 0)) - greatest(start, c.block_no * {BLOCK}))) AS taken
  FROM c LEFT JOIN u USING (rank, block_no) GROUP BY c.id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source FROM n LEFT JOIN x USING (id)
"""
