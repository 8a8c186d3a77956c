"""Shards of equal row counts that cut few links: balanced label propagation.

Documents that share a key are linked; here the key is the text, so that copies are linked.
Each document starts in the shard that its hash names. In every round a group of copies that is not
whole yet wishes for the shard where most of it is, among those with room for all of it. All its
members see the same histogram and the same order of ties, so they move together and groups
don't chase each other. Capacity quotas limit what may enter a shard in a round: of those who
wish for it as many as there is room for, counted through by parts of their hash. A group that
finds the shard full wishes anew, for another one. Large groups move before small ones, by powers
of two, while there is room for them. Once a group is whole no move of it cuts fewer links, so
rounds end when none that may move is left.

Only a group that no shard has room for is cut, into the fewest shards, of which it fills all
but the last. All its parts are placed from one histogram. ``cut_links`` tells what was cut.

At the end the law ``rows`` holds exactly: shard sizes differ by one document at most.
Documents are numbered within their shard, linked ones first; the numbers beyond a shard's
size go to the shards with room. Only counts per shard reach the driver, and those groups that no
shard has room for, of which there are at most a few per shard. Built-in expressions only; texts are read once and not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.tables import written

SHARDS = 16
#: Labels of groups above this part of a shard are sent to the tasks, others are joined.
SINGLE = 64
#: Parts of a shard that are numbered independently.
PARTS = 256
#: The law of the result.
LAW = "rows"


def rows_of(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, _text (a digest; NULL for none), _hash and first shard."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    digest = F.unhex(F.md5(text))
    row_hash = F.xxhash64(F.col("doc_id"), digest)
    return documents.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("bigint").alias("text_crc32"),
        digest.alias("_text"),
        row_hash.alias("_hash"),
        F.pmod(F.xxhash64(row_hash, F.lit("start")), F.lit(shards)).cast("int").alias("shard"),
    )


def groups_of(rows: DataFrame, shards: int) -> DataFrame:
    """_text, _n (rows) and _held (rows by shard) of every text that is there repeatedly."""
    held = [F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]
    counts = rows.where(F.col("_text").isNotNull()).groupBy("_text")
    return counts.agg(F.count("*").alias("_n"), F.array(*held).alias("_held")).where("_n > 1")


def place(groups: list, used: list[int], total: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """For each group its parts (first number, shard); fills up ``used``, the largest first.

    A group goes where most of it is, if there is room. One that fits nowhere fills the
    shard with the most room, and so on until its rest fits.
    """
    shards = len(used)
    floor, left = divmod(total, shards)

    def room(s: int) -> int:
        larger = sum(n > floor for i, n in enumerate(used) if i != s)
        return floor + (larger < left) - used[s]

    plan = []
    for g in sorted(groups, key=lambda g: (-g["_n"], bytes(g["_text"]))):
        parts, begin = [], 0
        while begin < g["_n"]:
            rest, rooms = g["_n"] - begin, [room(s) for s in range(shards)]
            fits = [s for s in range(shards) if rooms[s] >= rest]
            if fits:
                s = max(fits, key=lambda s: (g["_held"][s], -rooms[s], -s))
            else:
                s = max(range(shards), key=lambda s: (rooms[s], g["_held"][s], -s))
                if rooms[s] <= 0:  # only after more was drawn than there was room
                    rooms[s] = rest
            parts.append((begin, s))
            used[s] += min(rest, rooms[s])
            begin += min(rest, rooms[s])
        plan.append((bytes(g["_text"]), parts))
    return plan


def wishes(groups: DataFrame, rooms: list[int]) -> DataFrame:
    """``groups`` with _wish: the shard that most of the group is in, of those with room."""
    options = F.array(
        *(
            F.when(
                F.col("_n") <= room,
                F.struct(
                    F.get("_held", F.lit(s)).alias("n"),
                    F.xxhash64("_text", F.lit(s)).alias("tie"),
                    F.lit(s).alias("shard"),
                ),
            )
            for s, room in enumerate(rooms)
        )
    )
    return groups.withColumn("_wish", F.array_max(options)["shard"])


def _by_shard(of: Column, values: list) -> Column:
    """The value of a shard, from a short literal list."""
    return F.get(F.array(*map(F.lit, values)), of)


def entering(asked: DataFrame, rooms: list[int]) -> DataFrame:
    """``asked`` with _enters: its group is among those that its wish has room for.

    Groups are counted through in the order of their hash's part and their hash; each shard's
    parts are summed on their own, so no task holds a whole shard's groups.
    """
    part = F.pmod(F.xxhash64("_text"), F.lit(PARTS)).cast("int")
    placed = asked.withColumn("_part", part)
    sums = placed.where("_wish IS NOT NULL").groupBy("_wish", "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_wish").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(
        F.col("_wish").alias("_of"),
        F.col("_part").alias("_place"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"),
    )
    own = Window.partitionBy("_wish", "_part").orderBy(F.xxhash64("_text"), "_text")
    # at most shards * PARTS rows
    same = (F.col("_wish") == F.col("_of")) & (F.col("_part") == F.col("_place"))
    joined = placed.join(F.broadcast(begins), same, "left").withColumn("_upto", F.sum("_n").over(own))
    enters = F.col("_begin") + F.col("_upto") <= _by_shard(F.col("_wish"), rooms)
    return joined.withColumn("_enters", F.coalesce(enters, F.lit(False))).select(
        *asked.columns, "_enters"
    )


def propagated(
    groups: DataFrame, total: int, shards: int
) -> tuple[list, DataFrame | None, int]:
    """The plan of large and cut groups, _text and _to of all others, and the number of rounds.

    Each round is written, so that a lost executor costs one. In each a group enters every
    shard that any wishes for, so that rounds end. Groups of a class that are left over fit into no
    shard, and all that is free is less than one of them per shard: there are only a few.
    """
    floor, used = total // shards, [0] * shards
    plan = place(groups.where(F.col("_n") > floor).collect(), used, total)
    small = groups.where(F.col("_n") <= floor).withColumn("_class", F.floor(F.log2("_n")).cast("int"))
    classes = sorted((r["_class"] for r in small.select("_class").distinct().collect()), reverse=True)
    entered, rounds = [], 0
    for size in classes:
        rest = small.where(F.col("_class") == size)
        while True:
            rooms = [max(0, floor - n) for n in used]
            asked = written(entering(wishes(rest, rooms), rooms), f"round-{rounds}")
            rounds += 1
            flows = asked.groupBy("_enters", "_wish").agg(F.sum("_n").alias("n")).collect()
            for r in flows:
                if r["_enters"]:
                    used[r["_wish"]] += r["n"]
            entered.append(asked.where("_enters").select("_text", F.col("_wish").alias("_to"), "_n"))
            rest = asked.where("NOT _enters").select("_text", "_n", "_held", "_class")
            if not any(r["_wish"] is not None and not r["_enters"] for r in flows):
                break
        if any(not r["_enters"] for r in flows):  # none has room
            plan += place(rest.collect(), used, total)
    if not entered:
        return plan, None, rounds
    others = entered[0]
    for more in entered[1:]:
        others = others.unionByName(more)
    large = F.col("_n") > floor // SINGLE
    # fewer than SINGLE + 1 per shard, as they all fit
    plan += [(bytes(r["_text"]), [(0, r["_to"])]) for r in others.where(large).collect()]
    return plan, others.where(~large).drop("_n"), rounds


def _at(rows: DataFrame, group: list[str], part: Column, order: list[str]) -> DataFrame:
    """``rows`` with _number: 0, 1, 2, ... in each group, part after part, and _part.

    A group is numbered in parts, and a part's numbers go on where the part before ended.
    """
    rows = rows.withColumn("_part", part.cast("int"))
    sizes = rows.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(
        *group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin")
    )
    own = Window.partitionBy(*group, "_part").orderBy(*order)
    placed = rows.withColumn("_row", F.row_number().over(own) - 1)
    return placed.join(begins, [*group, "_part"]).withColumn(
        "_number", F.col("_begin") + F.col("_row")
    )


def moved(rows: DataFrame, plan: list, others: DataFrame | None) -> DataFrame:
    """``rows`` in their groups' shards, with _order: 0 and 1 for linked rows, 2 for others.

    The plan has at most ``SINGLE`` and a few groups per shard, so it may be broadcast; only small
    groups go through the other join, and no rows without text.
    """
    spark, columns = rows.sparkSession, rows.columns
    kind = "_text binary, _parts array<struct<begin: bigint, to: int>>"
    parts = F.broadcast(written(spark.createDataFrame(plan, kind), "plan"))
    cut, number = F.size("_parts") > 1, F.pmod("_hash", F.lit(PARTS))
    joined = rows.join(parts, "_text", "left")
    whole = joined.where(F.col("_parts").isNull() | ~cut)
    to, order = F.get("_parts", F.lit(0))["to"], F.when(F.col("_parts").isNotNull(), 0)
    if others is not None:
        alone = whole.where(F.col("_text").isNull()).withColumn("_to", F.lit(None).cast("int"))
        texts = whole.where(F.col("_text").isNotNull())
        whole = texts.join(others, "_text", "left").unionByName(alone)
        to = F.coalesce(to, "_to")
        order = order.when(F.col("_to").isNotNull(), 1)
    others_columns = [c for c in columns if c != "shard"]
    out = whole.select(
        *others_columns,
        F.coalesce(to, "shard").alias("shard"),
        order.otherwise(2).alias("_order"),
    )
    if all(len(p) == 1 for _, p in plan):
        return out
    pieces = _at(joined.where(cut), ["_text"], number, ["doc_id", "_hash", "size"])
    reached = F.filter("_parts", lambda p: p["begin"] <= F.col("_number"))
    to = F.element_at(reached, -1)["to"]
    return out.unionByName(
        pieces.select(*others_columns, to.alias("shard"), F.lit(0).alias("_order"))
    )


def numbered(labels: DataFrame) -> DataFrame:
    """``labels`` with _number: 0, 1, 2, ... within a shard, linked documents first.

    Small groups stay together in the order, so that what is beyond a shard cuts few.
    """
    by = F.when(F.col("_order") == 1, F.xxhash64("_text")).otherwise(F.col("_hash"))
    part = F.pmod(by, F.lit(PARTS)) + F.col("_order") * PARTS
    return _at(labels, ["shard"], part, ["_text", "doc_id", "_hash", "size"])


def balanced(labels: DataFrame, total: int, shards: int) -> DataFrame:
    """``labels`` with their final shard and slot: sizes differ by one at most."""
    linked = F.count(F.when(F.col("_order") < 2, 1))
    loads = labels.groupBy("shard").agg(F.count("*").alias("n"), linked.alias("linked")).collect()
    found = {r["shard"]: (r["linked"], r["n"]) for r in loads}
    counts = [found.get(s, (0, 0))[1] for s in range(shards)]
    # The shards with the most linked rows get the rows that are left over.
    by_load = sorted(range(shards), key=lambda s: (*(-n for n in found.get(s, (0, 0))), s))
    larger = by_load[: total % shards]
    sizes = [total // shards + (s in larger) for s in range(shards)]
    over, room = [0], [0]
    for n, size in zip(counts, sizes, strict=True):
        over.append(over[-1] + max(0, n - size))
        room.append(room[-1] + max(0, size - n))
    shard, number = F.col("shard"), F.col("_number")
    stays = number < _by_shard(shard, sizes)
    # Those beyond a shard's size are numbered through, and so is the room of the others.
    beyond = _by_shard(shard, over[:-1]) + number - _by_shard(shard, sizes)
    target = sum(((beyond >= end).cast("int") for end in room[1:]), F.lit(0))
    kept = [min(n, size) for n, size in zip(counts, sizes, strict=True)]
    placed = numbered(labels).withColumn("_target", F.when(stays, shard).otherwise(target))
    slot = F.when(stays, number).otherwise(
        _by_shard(F.col("_target"), kept) + beyond - _by_shard(F.col("_target"), room[:-1])
    )
    return placed.withColumn("slot", slot.cast("bigint")).withColumn(
        "shard", F.col("_target").cast("int")
    )


def assigned(documents: DataFrame, shards: int) -> DataFrame:
    """``rows_of`` the documents with their final shard and slot."""
    rows = written(rows_of(documents, shards), "rows")
    total = rows.count()
    plan, others, _ = propagated(written(groups_of(rows, shards), "groups"), total, shards)
    labels = written(moved(rows, plan, others), "labels")
    return balanced(labels, total, shards)


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (NULL) of every row.

    ``size`` is the text's UTF-8 bytes plus 1. A NULL text has size 1 and crc 0, and is
    linked to nothing; an empty one is a copy of other empty ones. Repeated rows are copies
    and each get a slot. Slots of a shard run from 0 without gaps. An empty table gives no
    rows. Other columns don't matter.
    """
    return assigned(documents, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For each text that lies in several shards: its md5, rows, shards and cut links.

    A link is a pair of copies; it is cut if they are in different shards.
    """
    parts = assigned(documents, shards).where(F.col("_text").isNotNull())
    parts = parts.groupBy("_text", "shard").agg(F.count("*").alias("_n"))
    n, pairs = F.sum("_n"), F.sum(F.col("_n") * (F.col("_n") - 1))
    return (
        parts.groupBy("_text")
        .agg(
            n.alias("n_rows"),
            F.count("*").alias("n_shards"),
            ((n * (n - 1) - pairs) / 2).cast("bigint").alias("n_cut"),
        )
        .where("n_shards > 1")
        .select(F.lower(F.hex("_text")).alias("text_md5"), "n_rows", "n_shards", "n_cut")
    )
