"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end, as often as they may
repeat; the resulting token stream is cut into blocks of equal token count, and whole blocks
are joined to the slots of a schedule: what has no slot is not in the mix.  A schedule of ``2**k`` slots takes the
van der Corput points, maps them through the cumulative block counts of the sources, and
ranks the slots of each source; the slot of rank ``r`` takes the source's block ``r``.
With ``2**k`` points every interval of whole grid cells holds exactly as many points as
it has cells, so each source gets exactly the blocks its target needs, and every prefix
of the mix is close to the target weights.

Nothing here sorts or counts a source in one task: offsets come from prefix sums over a
hash tree of fan-out 256, slot ranks from a closed form of the van der Corput sequence,
and slots find their source by an equi-join on grid cells.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

BLOCK_WORDS = 2048
CYCLE = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
#: Rows under one leaf of the hash tree before it gets another level.
LEAF_ROWS = 100_000
GRID_CELLS = 4096


def source_targets(sizes: DataFrame, share: float = SHARE, cycle: tuple[float, ...] = CYCLE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source: its total ``source_size``, ``weight`` and ``target``.

    ``sizes`` has ``source`` and ``size``.  Sources are ranked by code point, null last, and
    the weights of ``cycle`` repeat along that rank.  The sources share ``share`` times all
    sizes by weight; a target stops at ``max_repeat`` times its source's size and the excess
    is shared by weight among the others until none is above.  The level where this settles
    is found in one pass: order sources by cap per weight; the sources before some point
    are capped, and what their caps leave is spread over the weights behind it.

    The windows here run over one row per source, never over documents.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = totals.withColumn("nr", F.row_number().over(by_code_point) - 1)
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("nr") % len(cycle) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nr")
    to_here = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("cap_before", F.sum("cap").over(to_here) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(whole) - F.sum("weight").over(to_here) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_from"))
    )
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("nr"), F.col("level").alias("level")))).over(whole)["level"]
    return level.withColumn("open", open_level).select("source", "nr", "source_size", "weight", F.coalesce(F.least("cap", F.col("open") * F.col("weight")), "cap").alias("target"))


def _levels(rows: int) -> int:
    n = 1
    while rows > LEAF_ROWS * 256**n:
        n += 1
    return n


def stream_offsets(rows: DataFrame, levels: int) -> DataFrame:
    """Add ``start``: the words of the same source that come earlier in its shuffled order, and
    ``seat``, which tells repeated rows without words apart.

    ``rows`` has ``nr``, ``h`` (hex hash), ``doc_id``, ``size``.  Documents are grouped by
    the first ``2 * levels`` hex digits of the hash; every tree node has at most 256
    children, so no window holds more than 256 nodes or one leaf of documents.
    """
    prefix = lambda depth: F.substring("h", 1, 2 * depth)
    order = ["h", F.col("doc_id").asc_nulls_first(), "size"]
    leaf = Window.partitionBy("nr", "leaf").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("leaf", prefix(levels)).withColumn("start", F.sum("size").over(leaf) - F.col("size")).withColumn("seat", F.row_number().over(leaf))
    nodes = rows.groupBy("nr", prefix(levels).alias("node")).agg(F.sum("size").alias("size"))
    base = None
    for depth in range(levels, 0, -1):
        up = Window.partitionBy("nr", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = nodes.withColumn("parent", F.substring("node", 1, 2 * (depth - 1))).withColumn("before", F.sum("size").over(up) - F.col("size"))
        step = here.select("nr", F.col("node").alias(f"node{depth}"), F.col("parent").alias(f"node{depth - 1}"), F.col("before").alias(f"before{depth}"))
        base = step if base is None else base.join(step, ["nr", f"node{depth}"])
        nodes = here.groupBy("nr", F.col("parent").alias("node")).agg(F.sum("size").alias("size"))
    base = base.select("nr", F.col(f"node{levels}").alias("leaf"), reduce(add, [F.col(f"before{d}") for d in range(1, levels + 1)]).alias("base"))
    return out.join(base, ["nr", "leaf"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "leaf")


def _points_below(slot: Column, mirrored: Column, bound: Column, bits: int) -> Column:
    """How many van der Corput points of the slots before ``slot`` lie below ``bound``.

    The slots before ``slot`` fall into one run of ``2**j`` for each set bit ``j``; the
    points of such a run are ``2**(bits-j)`` apart, so each run is counted by one division.
    """
    terms = []
    for j in range(bits):
        gap = bits - j
        offset = mirrored.bitwiseAND(F.lit((1 << (gap - 1)) - 1))
        run = F.when(bound > offset, F.least(F.lit(1 << j), F.shiftright(bound - offset - 1, gap) + 1)).otherwise(F.lit(0))
        terms.append(F.when(F.shiftright(slot, j).bitwiseAND(F.lit(1)) == 1, run.cast("long")).otherwise(F.lit(0).cast("long")))
    return reduce(add, terms, F.lit(0).cast("long"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: ``slot`` (its place), ``nr``, ``rank`` (the source's block) and
    ``words`` (how much of the block it takes: all but in the source's last slot).

    Slots of a source with target ``t`` number ``ceil(floor(t) / block_words)``.
    """
    spark = targets.sparkSession
    whole = F.floor("target").cast("long")
    need = targets.select("nr", whole.alias("goal"), F.ceil(whole / F.lit(float(block_words))).cast("long").alias("need")).where("need > 0")
    total = need.agg(F.sum("need")).first()[0] or 0
    bits = max(0, (total - 1).bit_length()) if total else 0
    if not total:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).alias("nr"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("words")).where("false")
    to_here = Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = need.withColumn("to", F.sum("need").over(to_here)).withColumn("from", F.col("to") - F.col("need")).drop("need")
    coarse = max(0, bits - (GRID_CELLS.bit_length() - 1))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.shiftright("from", coarse), F.shiftright(F.col("to") - 1, coarse))))
    slots = spark.range(1 << bits).withColumnRenamed("id", "slot")
    mirrored = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    slots = slots.withColumn("x", mirrored).withColumn("cell", F.shiftright("x", coarse))
    found = slots.join(cells, "cell").where((F.col("x") >= F.col("from")) & (F.col("x") < F.col("to")))
    rank = _points_below(F.col("slot"), F.col("x"), F.col("to"), bits) - _points_below(F.col("slot"), F.col("x"), F.col("from"), bits)
    words = F.least(F.lit(block_words).cast("long"), F.col("goal") - F.col("rank") * block_words)
    return found.select("slot", "nr", "goal", rank.alias("rank")).select("slot", "nr", "rank", words.alias("words"))


def mix(documents: DataFrame, seed: str = "mix", block_words: int = BLOCK_WORDS, share: float = SHARE, cycle: tuple[float, ...] = CYCLE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The mix as pieces in order: ``slot``, ``rank``, ``doc_id``, ``source``, ``from_word``,
    ``to_word`` plus the document's ``size`` and its source's ``source_size`` and ``target``.

    Beside its pieces every document has one row with null ``slot``, so that no row is lost
    where the mix does not reach it or its text is null or empty.  A null source is a source of its own, a null
    ``doc_id`` an ordinary row, repeated rows are separate documents.  Columns of
    ``documents`` other than doc_id, source, text are ignored.  Same input and ``seed``,
    same mix.  An empty table gives an empty mix.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    sizes = staged(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h")))
    targets = staged(source_targets(sizes, share, cycle, max_repeat))
    n_sources, rows = targets.count(), sizes.count()
    small = n_sources <= BROADCAST_SOURCES
    side = F.broadcast(targets) if small else targets
    keyed = sizes.join(side.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "weight")
    placed = stream_offsets(keyed, _levels(rows)).drop("h")
    turns = F.sequence(F.lit(0), F.lit(max(1, math.ceil(max_repeat)) - 1))
    passes = placed.withColumn("turn", F.explode(turns)).withColumn("lo", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("hi", F.col("lo") + F.col("size"))
    blocks = passes.where("size > 0").withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))))
    slots = schedule(targets, block_words)
    first, stop = F.col("rank") * block_words, F.col("rank") * block_words + F.col("words")
    pieces = blocks.join(slots, ["nr", "rank"]).withColumn("from_word", F.greatest("lo", first) - F.col("lo")).withColumn("to_word", F.least("hi", stop) - F.col("lo")).where("to_word > from_word")
    columns = ["slot", "rank", "doc_id", "source", "start", "seat", "size", "source_size", "target", "from_word", "to_word"]
    none = placed.select(*[F.col(c) if c in placed.columns else F.lit(None).cast("long").alias(c) for c in columns])
    return pieces.select(columns).unionByName(none)


def taken(mixed: DataFrame) -> DataFrame:
    """Words that a mix takes of each document: doc_id, source, size, source_size, target, taken;
    with its first slot (null: none) and the number of its pieces in slots."""
    words = F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("long")
    per = mixed.groupBy("doc_id", "source", "start", "seat", "size", "source_size", "target")
    return per.agg(words.alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots")).drop("start", "seat")


def taken_sql(documents: str = "documents", seed: str = "mix", block_words: int = BLOCK_WORDS) -> str:
    """DuckDB SQL for ``taken`` of the default mix over the table expression ``documents``."""
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS h
  FROM {documents}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nr FROM totals),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][nr % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
     - (sum(cap) OVER (ORDER BY cap / weight, nr ROWS UNBOUNDED PRECEDING) - cap))
     / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, nr ROWS UNBOUNDED PRECEDING) + weight) AS lvl
  FROM weighted),
targets AS (
  SELECT source, nr, source_size, coalesce(least(cap, weight *
    (SELECT arg_min(lvl, (cap / weight, nr)) FROM levels WHERE lvl * weight <= cap)), cap) AS target FROM levels),
spans AS (
  SELECT nr, CAST(floor(target) AS BIGINT) AS goal, CAST(ceil(floor(target) / {block_words}) AS BIGINT) AS need FROM targets),
ends AS (SELECT *, CAST(sum(need) OVER (ORDER BY nr) AS BIGINT) AS upto FROM spans WHERE need > 0),
bits AS (SELECT CAST(ceil(log2(coalesce(max(upto), 1))) AS INT) AS k FROM ends),
points AS (
  SELECT slot, k, coalesce(list_sum(list_transform(range(k), lambda j: ((slot >> j) & 1) << (k - 1 - j))), 0) AS x
  FROM (SELECT k, unnest(range(CAST(1 AS BIGINT) << k)) AS slot FROM bits)),
slots AS (
  SELECT slot, nr, goal, row_number() OVER (PARTITION BY nr ORDER BY slot) - 1 AS rank
  FROM points JOIN ends ON x >= upto - need AND x < upto),
placed AS MATERIALIZED (
  SELECT s.doc_id, s.source, s.size, t.nr, t.source_size, t.target, row_number() OVER () AS row,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
blocks AS (
  SELECT row, nr, start + turn * source_size AS lo, start + turn * source_size + size AS hi,
         unnest(range(CAST(start + turn * source_size AS BIGINT) // {block_words}, CAST(start + turn * source_size + size - 1 AS BIGINT) // {block_words} + 1)) AS rank
  FROM placed, (SELECT unnest([0, 1]) AS turn) WHERE size > 0),
pieces AS (
  SELECT row, slot, least(hi, rank * {block_words} + least({block_words}, goal - rank * {block_words})) - greatest(lo, rank * {block_words}) AS words
  FROM blocks JOIN slots USING (nr, rank)),
found AS (SELECT row, sum(words) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM pieces WHERE words > 0 GROUP BY row)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM placed LEFT JOIN found USING (row)"""
