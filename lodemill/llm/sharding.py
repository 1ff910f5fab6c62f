"""Balanced label propagation: linked documents move to their neighbours' shard while shard sizes stay even.

Documents are linked when their texts are equal. Shard counts follow the law ``rows``: they differ by one at most.

Equal texts are interchangeable, so propagation works on rows (text, shard, count) instead of on single links: the
neighbours of a document in shard s are the counts of its text over all shards. A text that alone fills whole shards
is given them first (there are at most ``n_shards`` such shards); its rest is a text like others. In each round

1. every text names the shard that holds most of its documents, and its documents elsewhere want to move there;
2. quotas for each pair of shards are the largest that keep every shard within its capacity when all admitted moves
   happen at once: a shard takes as many as it has room and loses (``n_shards`` squared numbers, summed by Spark);
3. moves are admitted in a fixed order up to their quota; part of a text's documents may be admitted.

Rounds end when none improves the cut. Texts that are still split then are stuck: their shards are full of each other.
They give up all their places, and are laid whole, one after the other, into the room that this makes, so that fewer
texts than shards are cut, at the shards' ends. Texts of one document have no links; they fill what room is left at the end,
which makes the counts exact. Numbering inside a shard or a text runs in two levels (block totals, then rank inside
a block, by the number that a row got when the table was written), so that a text with a third of all rows, one row that
is repeated, or a shard, is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, text_or_empty
from lodemill.llm.ranking import ranked

LAW = "rows"
#: Rows that one task numbers.
BLOCK_ROWS = 4_000
#: Texts of which one task adds up the counts.
BLOCK_TEXTS = 20_000


def _quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> list[list[int]]:
    """The most moves from shard to shard, of those wanted, that overfill no shard when all happen at once."""
    k = len(room)
    flow = [[wanted.get((s, t), 0) for t in range(k)] for s in range(k)]
    changed = True
    while changed:
        changed = False
        for t in range(k):
            excess = sum(flow[s][t] for s in range(k)) - sum(flow[t]) - room[t]
            while excess > 0:
                s = max(range(k), key=lambda s: flow[s][t])
                less = min(excess, flow[s][t])
                flow[s][t] -= less
                excess -= less
                changed = True
    return flow


def _laid(texts: DataFrame, room: list[int], blocks: int) -> DataFrame:
    """(text, shard, n): texts (text, n) one after the other into the rooms of the shards. A text's place on the line is
    the sum of those before it: of the blocks before its own, and inside its block."""
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"))
    earlier = Window.partitionBy("_").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("block").agg(F.sum("n").alias("n")).withColumn("_", F.lit(0))
    starts = sums.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "block").withColumn("a", F.col("start") + F.col("inner")).withColumn("b", F.col("a") + F.col("n"))
    ends = [sum(room[: s + 1]) for s in range(len(room))]
    rooms = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(e - r).cast("long").alias("lo"), F.lit(e).cast("long").alias("hi")) for s, (r, e) in enumerate(zip(room, ends, strict=True))])
    met = F.explode(F.filter(rooms, lambda r: (r.lo < F.col("b")) & (r.hi > F.col("a"))))
    return placed.select("text", "a", "b", met.alias("r")).select("text", F.col("r.shard").alias("shard"), (F.least("r.hi", "b") - F.greatest("r.lo", "a")).alias("n"))


def _unstuck(state: DataFrame, capacity: list[int], scratch: Scratch) -> DataFrame:
    """state with the texts that are in several shards laid anew."""
    split = scratch.written(state.groupBy("text").agg(F.count("*").alias("shards"), F.sum("n").cast("long").alias("n")).filter("shards > 1").select("text", "n"))
    n_split = split.count()
    if not n_split:
        return state
    whole = scratch.written(state.join(split.select("text"), "text", "left_anti"))
    loads = {r["shard"]: r["n"] for r in whole.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    room = [c - loads.get(s, 0) for s, c in enumerate(capacity)]
    return scratch.written(whole.select("text", "shard", "n").unionByName(_laid(split, room, max(1, n_split // BLOCK_TEXTS))))


def _propagate(counts: DataFrame, capacity: list[int], rounds: int, scratch: Scratch) -> DataFrame:
    """counts: (text, shard, n) of the texts with two or more documents. Returns the same, moved under the quotas."""
    state = scratch.written(counts)
    cut = None
    blocks_of_texts = max(64, state.count() // BLOCK_TEXTS)
    for _ in range(rounds):
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        # Ties go to a shard by hash, so that moves in both directions balance.
        most = F.max(F.struct("n", F.xxhash64("text", "shard"), "shard")).over(Window.partitionBy("text"))
        named = state.select("text", "shard", "n", most.shard.alias("to")).withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks_of_texts)).cast("int"))
        moving = named.filter("to <> shard")
        blocks = moving.groupBy("shard", "to", "block").agg(F.sum("n").alias("wanted"))
        wanted = {(r["shard"], r["to"]): r["n"] for r in blocks.groupBy("shard", "to").agg(F.sum("wanted").alias("n")).collect()}
        quotas = _quotas(wanted, [c - loads.get(s, 0) for s, c in enumerate(capacity)])
        quota = F.get(F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in quotas]), F.col("shard")), F.col("to"))
        earlier = Window.partitionBy("shard", "to").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("shard", "to", "block", F.coalesce(F.sum("wanted").over(earlier), F.lit(0)).alias("before_block"))
        inside = Window.partitionBy("shard", "to", "block").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
        moved = (
            moving.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(blocks, ["shard", "to", "block"])
            .withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), quota - F.col("before") - F.col("before_block"))))
        )
        parts = (
            moved.select("text", F.col("to").alias("shard"), F.col("take").alias("n"))
            .unionByName(moved.select("text", "shard", (F.col("n") - F.col("take")).alias("n")))
            .unionByName(named.filter("to = shard").select("text", "shard", "n"))
        )
        after = scratch.written(parts.filter("n > 0").groupBy("text", "shard").agg(F.sum("n").cast("long").alias("n")))
        now = after.count()
        scratch.drop(state)
        state = after
        if cut is not None and now >= cut:
            break
        cut = now
    return _unstuck(state, capacity, scratch)


def _whole_shards(groups: DataFrame, capacity: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """(shard -> text that fills it, text -> documents of it that are left). Small: a shard's worth of rows each."""
    least = max(2, min(capacity))
    big = sorted((-r["n"], r["text"]) for r in groups.filter(F.col("n") >= least).collect())  # at most one for each shard
    owner: dict[int, int] = {}
    left: dict[int, int] = {}
    free = list(range(len(capacity)))
    for n, text in big:
        n = -n
        while free and n >= capacity[free[0]] > 0:
            n -= capacity[free[0]]
            owner[free.pop(0)] = text
        left[text] = n
    return owner, left


def balanced_shards(docs: DataFrame, n_shards: int = 24, rounds: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs.

    Null and empty texts are equal texts of size 8. Null ids, ties and repeated rows are rows like others. Extra columns of
    docs are ignored. A long text is a hash after it was read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "shards")
    text = text_or_empty(F.col("text"))
    rows = scratch.written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("text"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    total = rows.count()
    task, inside = F.shiftright("nth", 33), F.col("nth").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("block", task * (1 << 24) + (inside / BLOCK_ROWS).cast("long"))
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    groups = scratch.written(rows.groupBy("text").agg(F.count("*").alias("n")).filter("n > 1"))
    owner, left = _whole_shards(groups, capacity)
    free = [s for s in range(n_shards) if s not in owner]
    # First labels: linked rows are dealt to the free shards in turn, larger ones first, so none starts overfull.
    linked = rows.join(groups.select("text"), "text", "left_semi").filter(~F.col("text").isin(list(left)))
    linked = linked.select("text", "nth", "block")
    for text, n in left.items():
        rest = spark.range(n).select(F.lit(text).alias("text"), F.col("id").alias("nth"), (-1 - F.col("id") / BLOCK_ROWS).cast("long").alias("block"))
        linked = linked.unionByName(rest)
    linked = ranked(linked.withColumn("all", F.lit(0)), ["all"], ["nth", "text"], "r")
    turn = F.get(F.array(*[F.lit(s) for s in free or [0]]), F.pmod("r", F.lit(max(1, len(free)))).cast("int"))
    linked = linked.groupBy("text", turn.alias("shard")).agg(F.count("*").alias("n"))
    inner = [0 if s in owner else c for s, c in enumerate(capacity)]
    placed = _propagate(linked, inner, rounds, scratch)
    if owner:
        whole = spark.createDataFrame([(text, s, capacity[s]) for s, text in owner.items()], "text long, shard int, n long")
        placed = placed.unionByName(whole).groupBy("text", "shard").agg(F.sum("n").alias("n"))
    loads = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    need = [capacity[s] - loads.get(s, 0) for s in range(n_shards)]
    ends = [sum(need[: s + 1]) for s in range(n_shards)]
    so_far = Window.partitionBy("text").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.withColumn("end", F.sum("n").over(so_far)).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ranges"))
    # A row's rank among the rows of its text, or among all single rows, picks its shard.
    keyed = rows.join(ranges, "text", "left").withColumn("group", F.when(F.col("ranges").isNotNull(), F.col("text")))
    keyed = keyed.withColumn("single", F.col("ranges").isNull()).withColumn("group", F.coalesce("group", F.lit(0)))
    numbered = ranked(keyed, ["single", "group"], ["nth"], "r")
    default = F.array(*[F.struct(F.lit(e).cast("long").alias("end"), F.lit(s).alias("shard")) for s, e in enumerate(ends)])
    numbered = numbered.withColumn("ranges", F.coalesce("ranges", default)).withColumn("shard", F.expr("filter(ranges, x -> r < x.end)[0].shard"))
    slotted = ranked(numbered.drop("ranges", "r"), ["shard"], ["nth"], "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
