"""Operator 11: the trie of conversation prefixes, by van Emde Boas recursion over its height.

Sequences are cut at half their greatest depth, the prefixes at the cut are named, and the upper trie and the forests
below the cut are built alike, all subproblems of one height in the same Spark job. The recursion ends at a height of
`LEAF` turns, where a sequence is one row. So a trie of height n takes log(n / LEAF) rounds down, in which a prefix gets
its name from the name at the upper end of its subproblem and the digest of the half between (digests of halves are made
from those of quarters), and as many rounds up, in which the totals of each lower tree are grafted: its root hands them
to its ancestors in the upper trie, along the path of the root's smallest member.

Names are SHA-256 digests of a prefix's turns, so equal names are equal prefixes, and a node is one group of equal names:
counted before the shuffle, however many conversations share it. No task holds a whole conversation or the members of a
node: long conversations are numbered and cut over many tasks, and ids that end at a node are joined in runs by many
tasks; only the digest of a node's joined ids, which is sequential, is one task's, which reads it run by run.

Rows without a conv_id belong to no conversation and are left out. Null role and text count as empty. Turns are ordered by
turn (null first), then role, then text; repeated rows are turns of their own. A conversation that has no turn left is a
member of the root. Without any conversation there is no node. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.shared import give_back, keep

#: Turns of a subtrie that ends the recursion, a row for each sequence.
LEAF = 8
#: Ids in one run of a node's ids; characters of a text that deal rows into ranges.
RUN, RANGE_CHARS = 256, 64
#: Name of the prefix without turns, as SQL.
ROOT = "X''"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def number_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, runs): turns have conv_id, key (binary, of role and text), chars, with `texts` also role and text, and the
    place in the range of rows that holds them; runs have, for each range and conversation, what turns a place into the
    turn's number (`number`), and the conversation's size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    # Turns alike in all but their text are dealt by its beginning, which agrees with the order by whole texts.
    ranges = rows.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS))
    ordered = ranges.sortWithinPartitions("conv_id", "turn", "role", "text")
    key = _digest(F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    columns = ["conv_id", key.alias("key"), F.length("text").cast("long").alias("chars"), F.spark_partition_id().alias("part"), place.alias("place")]
    turns = keep(ordered.select(*columns, *(["role", "text"] if texts else [])), "turns")
    counted = keep(turns.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.min("place").alias("first")), "turn-runs")
    # A conversation has a row for each range that it reaches into.
    before = Window.partitionBy("conv_id").orderBy("part")
    runs = counted.select("part", "conv_id", "first", (F.sum("n").over(before) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("size"))
    return turns, runs


def number() -> Column:
    """Number of a turn, from 1."""
    return F.col("before") + F.col("place") - F.col("first") + 1


def rebuild(turns: DataFrame, runs: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns by conv_id and pos, all conv_ids) of conversations whose first turns are those of their group's first.

    Conversation c takes the first h = crc32(c) % `most` turns of c - c % `group` (all if it has fewer, none if it is
    absent) in place of its own first h.
    """
    runs = keep(runs, "runs")
    sizes = runs.groupBy("conv_id").agg(F.max("size").alias("size"))
    heads = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    heads = keep(heads.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0)))).drop("base_size"), "heads")
    placed = runs.join(heads, "conv_id").select("part", "conv_id", "first", "before", "h", "taken")
    numbered = turns.join(placed, ["part", "conv_id"]).withColumn("number", number())
    extra = [c for c in turns.columns if c in ("role", "text")]
    own = numbered.where(F.col("number") > F.col("h")).select("conv_id", (F.col("number") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars", *extra)
    # The first turns of a group's first conversation go to the conversations of the group, fewer than `group` times each.
    starts = numbered.where((F.col("conv_id") % group == 0) & (F.col("number") < most)).select(F.col("conv_id").alias("base"), "number", "key", "chars", *extra)
    lent = heads.join(starts, "base").where(F.col("number") <= F.col("h")).select("conv_id", F.col("number").alias("pos"), "key", "chars", *extra)
    return own.unionByName(lent), heads.select("conv_id")


def _halves(blocks: DataFrame, height: int) -> list[tuple[int, DataFrame]]:
    """For heights 1, 2, 4, ... in blocks: the digest of every whole run of as many blocks that begins at its multiple."""
    level = keep(blocks.where(F.size("keys") == LEAF).select("conv_id", F.col("block").alias("at"), F.unhex(F.sha2(F.array_join(F.transform("keys", F.hex), ""), 256)).alias("digest")), "halves")
    out, size = [(1, level)], 1
    while 2 * size < height:
        even = F.col("at") % (2 * size) == 0
        sides = [F.max(F.when(side, F.col("digest"))).alias(name) for name, side in (("left", even), ("right", ~even))]
        joined = level.groupBy("conv_id", (F.col("at") - F.col("at") % (2 * size)).alias("at")).agg(*sides)
        size *= 2
        level = keep(joined.where(F.col("left").isNotNull() & F.col("right").isNotNull()).select("conv_id", "at", _digest(F.col("left"), F.col("right")).alias("digest")), "halves")
        out.append((size, level))
    return out


def _named(blocks: DataFrame, height: int) -> DataFrame:
    """Blocks with the names of all prefixes that end in them, after the name of the prefix before them (`names`)."""
    cuts = blocks.where((F.col("block") == 0) & (F.size("keys") == LEAF)).select("conv_id", F.col("block").alias("at"), F.expr(ROOT).alias("name"))
    for size, digests in reversed(_halves(blocks, height)):
        # Every subproblem of this height is cut in its middle.
        cut = cuts.where(F.col("at") % (2 * size) == 0).join(digests, ["conv_id", "at"])
        cuts = keep(cuts.unionByName(cut.select("conv_id", (F.col("at") + size).alias("at"), _digest(F.col("name"), F.col("digest")).alias("name"))), "cuts")
    # A whole block ends at a cut, which names its last prefix; all blocks but the first begin at one.
    begins = cuts.where(F.col("at") > 0).select("conv_id", F.col("at").alias("block"), F.col("name").alias("begin"))
    ends = cuts.where(F.col("at") > 0).select("conv_id", (F.col("at") - 1).alias("block"), F.col("name").alias("end"))
    short = blocks.where((F.col("block") == 0) & (F.size("keys") < LEAF)).withColumn("begin", F.expr(ROOT)).withColumn("end", F.expr(ROOT))
    long = blocks.where((F.col("block") > 0) | (F.size("keys") == LEAF)).join(begins, ["conv_id", "block"], "left").join(ends, ["conv_id", "block"], "left")
    inside = F.aggregate(F.slice("keys", 1, LEAF - 1), F.array(F.coalesce("begin", F.expr(ROOT))), lambda names, key: F.concat(names, F.array(_digest(F.element_at(names, -1), key))))
    names = F.when(F.size("keys") == LEAF, F.concat(inside, F.array("end"))).otherwise(inside)
    return short.unionByName(long).select("conv_id", "block", "chars", names.alias("names"))


def _positions(paths: DataFrame, *columns: str) -> DataFrame:
    """A row for each node on a path: depth, name, parent (its name), chars, and the columns."""
    steps = F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda i: F.struct(
        (F.col("block") * LEAF + i).alias("depth"), F.element_at("names", i + 1).alias("name"), F.element_at("names", i).alias("parent"), F.element_at("chars", i).alias("chars")
    ))
    return paths.select("conv_id", *columns, F.explode(steps).alias("step")).select("conv_id", *columns, "step.*")


def _totals(nodes: DataFrame, paths: DataFrame, height: int) -> list[DataFrame]:
    """Parts of every node's totals over its subtree (leaves, saved): within the lowest subtries, then what each grafting
    round adds. The parts of a node sum up to its totals."""
    own = nodes.select("conv_id", F.floor((F.col("depth") - 1) / LEAF).alias("block"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    # A node's values stand on the path of its smallest member, at most LEAF nodes for a row.
    carried = own.groupBy("conv_id", "block").agg(F.collect_list(F.struct("depth", "leaves", "saved")).alias("own"))
    below = lambda field: F.aggregate(F.filter("own", lambda x: x["depth"] >= F.col("depth")), F.lit(0).cast("long"), lambda sum, x: sum + x[field]).alias(field)
    # Values may come from a node in the row's lower half only, so all positions above them count.
    stands = _positions(paths.join(carried, ["conv_id", "block"]), "own").select("depth", "name", below("leaves"), below("saved"))
    add = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parts = [keep(stands.groupBy("depth", "name").agg(*add), "totals")]
    size = 1
    while size < height:
        roots = (F.col("depth") - 1) % (2 * size * LEAF) == size * LEAF
        so_far = parts[0].where(roots)
        for part in parts[1:]:
            so_far = so_far.unionByName(part.where(roots))
        lower = nodes.where(roots).select("depth", "name", "conv_id").join(so_far.groupBy("depth", "name").agg(*add), ["depth", "name"])
        lower = lower.select("conv_id", (F.floor((F.col("depth") - 1) / LEAF) - size).alias("top"), "leaves", "saved")
        upper = paths.where(F.col("block") % (2 * size) < size).withColumn("top", F.col("block") - F.col("block") % (2 * size))
        grafted = _positions(upper.join(lower, ["conv_id", "top"]), "leaves", "saved")
        parts.append(keep(grafted.groupBy("depth", "name").agg(*add), "totals"))
        size *= 2
    return parts


def _joined_ids(ends: DataFrame) -> DataFrame:
    """name and ends_sha256: the digest of the ids (numerically ascending, joined by commas) of the rows of each name."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, done = None, [], []

        def ended() -> None:
            if ids:
                done.append((name, ids[0], ",".join(map(str, ids))))
            ids.clear()

        for batch in batches:
            for own, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != name or len(ids) == RUN:
                    ended()
                    name = own
                ids.append(number)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), x)) for x in done], schema=run_schema)
                done.clear()
        ended()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), x)) for x in done], schema=run_schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and own == name:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends_sha256"])
        give_back()

    run_schema = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    ordered = ends.select("name", "conv_id").repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    runs_of = ordered.mapInArrow(runs, "name binary, first long, ids string")
    return runs_of.repartition(parts, "name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends_sha256 string")


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of the sequences of turns (conv_id, pos from 1, key, chars); `conversations` has every conv_id.

    depth 0 is the root. conv_id is a node's smallest member, parent_conv_id its parent's; n_convs, n_children; over the
    subtree, its top included, n_leaves and saved_tokens, the sum of (n_convs - 1) * chars of the last turn; ends_sha256
    of the members that end here.
    """
    rows = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / LEAF).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("own"))
    blocks = keep(rows.select("conv_id", "block", F.col("own.key").alias("keys"), F.col("own.chars").alias("chars")), "blocks")
    conversations = keep(conversations, "conversations")
    whole = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).collect()[0]
    if not whole["n"]:
        return blocks.sparkSession.createDataFrame([], NODE)
    last = blocks.agg(F.max("block")).collect()[0][0]
    height = 1
    while last is not None and height < last + 2:
        height *= 2
    paths = keep(_named(blocks, height), "paths")
    made = keep(_positions(paths).groupBy("depth", "name", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "nodes")
    children = made.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = keep(made.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    totals = _totals(nodes, paths, height)
    top = nodes.agg(F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.count(F.when(F.col("depth") == 1, 1)).alias("children")).collect()[0]

    ends = paths.groupBy("conv_id").agg(F.max(F.struct("block", F.element_at("names", -1).alias("name"))).alias("end")).select("conv_id", "end.name")
    ends = conversations.join(ends, "conv_id", "left").select("conv_id", F.coalesce("name", F.expr(ROOT)).alias("name"))
    hashes = keep(_joined_ids(ends), "ends")

    summed = totals[0]
    for part in totals[1:]:
        summed = summed.unionByName(part)
    summed = summed.groupBy("depth", "name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = nodes.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("depth"), F.expr(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(whole["first"]).cast("long").alias("conv_id"), F.lit(whole["n"]).cast("long").alias("n_convs"),
        F.lit(top["children"]).cast("long").alias("n_children"), F.lit(max(1, top["leaves"])).cast("long").alias("n_leaves"), F.lit(top["saved"] or 0).cast("long").alias("saved_tokens"),
    )
    full = root.unionByName(nodes.join(summed, ["depth", "name"]).select("depth", "name", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    full = keep(full.join(hashes, "name", "left"), "trie")
    # The root is the parent of all nodes of depth 1, so those need no join.
    parents = full.where(F.col("depth") > 0).select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    near = full.where(F.col("depth") <= 1).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(whole["first"])).cast("long"))
    deep = full.where(F.col("depth") > 1).join(parents, ["depth", "parent"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return near.unionByName(deep).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of the trie of the conversations as they are."""
    turns, runs = number_turns(df, conv_id, turn, role, text)
    runs = keep(runs, "runs")
    numbered = turns.join(runs, ["part", "conv_id"]).select("conv_id", number().alias("pos"), "key", "chars")
    return build(numbered, runs.select("conv_id").distinct())


def with_last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes with role and text of their last turn; `turns` has conv_id, pos, role and text. The root has none."""
    return nodes.join(turns.select("conv_id", F.col("pos").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
