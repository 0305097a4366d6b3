"""Operator 12: the prefix trie of conversations by prefix doubling.

Every different turn gets a dense name; then, in rounds, every aligned pair of named blocks of 2^j turns is a block of 2^(j+1)
turns and is named by its pair of names. A prefix of d turns is made of the aligned blocks that the binary digits of d
name, so prefixes are named in as many rounds as d has digits set, each by its shorter prefix and its last block; a prefix's name
is the smallest conversation that starts with it. Nodes are groups of equal names.

Sums over subtrees need no walk: a conversation owns the nodes whose smallest member it is, which are the last ones of
its path; what it owns counts for every node of its path.

Joins on names split off hot names (those of over 1/256 of the rows, so 256 at most, which are broadcast); sorting and sums
along a conversation go in two levels, so neither a very common turn nor a very long conversation is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

HOT = 256  # a key with over 1/HOT of the rows is hot
SPAN = 4096  # turns of a conversation whose sums one group makes
EMPTY = hashlib.sha256(b"").hexdigest()


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with table (keys unique, n: the number of rows that have them, more columns); rows without a match go.

    Keys of over total / HOT rows, HOT at most, are broadcast; the others cannot make a partition much larger than its share.
    """
    hot = F.col("n") > total / HOT
    often = table.where(hot).withColumn("is_hot", F.lit(True))
    own = [c for c in table.columns if c not in keys]
    marked = rows.join(F.broadcast(often), keys, "left")
    first = marked.where("is_hot").drop("is_hot")
    rest = marked.where("is_hot IS NULL").drop("is_hot", *own).join(table.where(~hot), keys)
    return first.unionByName(rest)


def dense_names(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """rows with a dense number from 0 for each different value of keys instead of keys; and the number of rows.

    Different values are grouped, numbered within their partitions, and shifted by the sizes of the partitions before,
    which are all that reaches the driver.
    """
    table = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33).cast("int")
    sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("size"), F.sum("n").alias("n")).orderBy("part").collect()
    starts, before = [F.lit(-1), F.lit(0)], 0
    for r in sizes:
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["size"]
    number = F.element_at(F.create_map(*starts), part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    total = sum(r["n"] for r in sizes)
    return lookup(rows, table.withColumn(name, number.cast("long")).drop("at"), keys, total).drop("n", *keys), total


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with their number `i` from 0 within key, by order; sorted in ranges, so a key may have any number of rows."""
    ranges = stored(rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("part", F.shiftrightunsigned("at", 33))
    runs = ranges.groupBy(key, "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(key, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ranges.join(runs, [key, "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def sums_from(rows: DataFrame, key: str, i: str, value: str) -> DataFrame:
    """(key, i, value, from_here: the sum of value from i on within key), in spans of SPAN numbers."""
    spans = rows.withColumn("span", F.expr(f"{i} div {SPAN}"))
    totals = spans.groupBy(key, "span").agg(F.sum(value).alias("t"))
    after = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    totals = totals.select(key, "span", (F.sum("t").over(after(key).orderBy("span")) - F.col("t")).alias("later"))
    within = spans.withColumn("within", F.sum(value).over(after(key, "span").orderBy(i)))
    return within.join(totals, [key, "span"]).withColumn("from_here", F.col("within") + F.col("later")).drop("span", "within", "later")


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, i, turn: a digest of role and text that tells them apart, chars): turns in order, null first.

    Turns that share a number go by their digests, and repeated rows are turns each. Null roles and texts are empty; rows without
    a conversation go. Turns are told apart by SHA-256, so whole texts are read once and never shuffled; an empty table gives an
    empty one. Other columns, whatever their names, have no influence.
    """
    c = lambda x: F.col(f"`{x}`")
    role, text = F.coalesce(c(role_col), F.lit("")), F.coalesce(c(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(c(id_col).cast("long").alias("conv"), c(turn_col).cast("long").alias("no"), digest.alias("turn"), F.char_length(text).cast("long").alias("chars"))
    return stored(numbered(rows.where("conv IS NOT NULL"), "conv", [F.col("no").asc_nulls_first(), F.col("turn")]).drop("no"))


def rebuilt(rows: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv, i, turn, chars) and (conv, len) of conversations that share heads: the first h turns of the group's first one, then a conversation's own after its first h.

    h is the CRC-32 of the decimal id modulo most; the group's first conversation is the id less its remainder by group.
    """
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n_own"))
    h = F.crc32(F.col("conv").cast("string")) % most
    head = F.col("conv") - F.col("conv") % group
    convs = sizes.select("conv", h.alias("h"), head.alias("head"), "n_own")
    heads = sizes.select(F.col("conv").alias("head"), F.col("n_own").alias("n_head"))
    convs = convs.join(heads, "head", "left").withColumn("k", F.least("h", F.coalesce("n_head", F.lit(0))))
    convs = stored(convs.select("conv", "h", "head", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("len")))
    first = rows.where(F.col("i") < most - 1).select(F.col("conv").alias("head"), "i", "turn", "chars")
    borrowed = convs.join(first, "head").where("i < k").select("conv", "i", "turn", "chars")
    # h and k of a conversation and its head are the same for all of its rows, so its own rows need one lookup of k less h
    by_conv = convs.select("conv", (F.col("k") - F.col("h")).alias("shift"), F.col("h").alias("from"), F.greatest(F.col("len"), F.lit(1)).alias("n"))
    own = lookup(rows, by_conv, ["conv"], rows.count()).where("i >= `from`")
    return stored(borrowed.unionByName(own.select("conv", (F.col("i") + F.col("shift")).alias("i"), "turn", "chars"))), convs.select("conv", "len")


def _prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """(conv, d, owner, members) of each prefix of d > 0 turns of (conv, i, turn): owner is the smallest conversation that starts with it."""
    blocks, _ = dense_names(rows.select("conv", "i", "turn"), ["turn"], "name")
    level, parts = 0, []
    while True:
        blocks = stored(blocks)
        # the last block of a prefix is an even one of its level
        parts.append(blocks.where("i % 2 = 0").select("conv", F.expr(f"shiftleft(i + 1, {level})").alias("d"), F.expr(f"shiftleft(i, {level})").alias("rest"), F.lit(level).alias("level"), "name"))
        if 2 << level > longest:
            break
        left = blocks.where("i % 2 = 0").select("conv", F.expr("i div 2").alias("i"), F.col("name").alias("a"))
        right = blocks.where("i % 2 = 1").select("conv", F.expr("i div 2").alias("i"), F.col("name").alias("b"))
        blocks, _ = dense_names(stored(left.join(right, ["conv", "i"])), ["a", "b"], "name")
        level += 1
    last = parts[0]
    for p in parts[1:]:
        last = last.unionByName(p)
    last = stored(last.withColumn("ones", F.bit_count("d")))
    done = None
    for ones in range(1, longest.bit_length() + 1):
        now = last.where(F.col("ones") == ones)
        if done is None:
            pairs = now.select("conv", "d", F.lit(-1).cast("long").alias("before"), "name")
        else:
            shorter = done.where(F.bit_count("d") == ones - 1).select("conv", F.col("d").alias("rest"), F.col("owner").alias("before"))
            pairs = now.join(shorter, ["conv", "rest"]).select("conv", "d", "before", "name")
        pairs = stored(pairs)
        groups = stored(pairs.groupBy("d", "before", "name").agg(F.count("*").alias("n"), F.min("conv").alias("owner")))
        total = pairs.count()
        if not total:
            break
        found = lookup(pairs, groups, ["d", "before", "name"], total).select("conv", "d", "owner", F.col("n").alias("members"))
        found = stored(found)
        done = found if done is None else done.unionByName(found)
    return done


def _digests(ends: DataFrame) -> DataFrame:
    """(owner, d, ends_sha256) of (owner, d, conv): SHA-256 of the conversations' decimal ids in order, comma-joined.

    Ids are sorted by ranges and joined within a batch; then a task reads a node's pieces in order and keeps but the state of its hash, so a node may have any number of ends.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            yield pdf.groupby(["owner", "d"], sort=False).agg(first=("conv", "min"), text=("conv", lambda x: ",".join(map(str, x)))).reset_index()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            out = []
            for owner, d, text in zip(pdf["owner"], pdf["d"], pdf["text"], strict=True):
                if (owner, d) == at:
                    state.update(b"," + text.encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (owner, d), hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=["owner", "d", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["owner", "d", "ends_sha256"])

    keys = ["owner", "d"]
    pieces = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInPandas(join, "owner bigint, d bigint, first bigint, text string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInPandas(digest, "owner bigint, d bigint, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv, i, turn, chars) with lengths (conv, len), those without turns included.

    One row per node: conv_id (its smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. No conversations: no nodes, not even a root.
    """
    n_convs, root, longest, n_turns = lengths.agg(F.count("*"), F.min("conv"), F.max("len"), F.sum("len")).first()
    columns = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    spark = rows.sparkSession
    if not n_convs:
        return spark.createDataFrame([], columns)
    ends = lengths.where("len = 0").select(F.lit(root).alias("owner"), F.lit(0).cast("long").alias("d"), "conv")
    if not longest:
        top = _digests(ends).select(F.lit(n_convs).alias("n"), "ends_sha256")
        return top.select(F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n", *[F.lit(x).cast("long") for x in (0, 1, 0)], "ends_sha256").toDF(*[c.split()[0] for c in columns.split(", ")])
    paths = _prefixes(rows, longest)
    nodes = paths.where("owner = conv").select("conv", "d", "members")
    chars = rows.select("conv", (F.col("i") + 1).alias("d"), "chars")
    nodes = nodes.join(chars, ["conv", "d"]).withColumn("saves", (F.col("members") - 1) * F.col("chars"))
    above = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("owner").alias("parent"))
    nodes = nodes.join(above, ["conv", "d"], "left").withColumn("parent", F.coalesce("parent", F.lit(root)))
    nodes = stored(nodes.select("conv", "d", "members", "saves", "parent"))
    children = nodes.groupBy(F.col("parent").alias("conv"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["conv", "d"], "left").na.fill(0, ["n_children"]))
    # a leaf is owned by a conversation that ends there
    facts = nodes.groupBy("conv").agg(F.sum("saves").alias("t"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    facts = stored(facts.join(lengths.select("conv", F.col("len").alias("n")), "conv"))
    passing = lookup(paths.where("owner != conv").select("conv", "d", "owner"), facts, ["conv"], n_turns)
    passing = passing.groupBy(F.col("owner").alias("conv"), "d").agg(F.sum("t").alias("others"), F.sum("leaf").alias("other_leaves"))
    own = sums_from(nodes, "conv", "d", "saves").join(passing, ["conv", "d"], "left").na.fill(0, ["others", "other_leaves"])
    own = lookup(own, facts.select("conv", "leaf", "n"), ["conv"], n_turns)
    out = own.select("conv", "d", "parent", "members", "n_children", (F.col("leaf") + F.col("other_leaves")).alias("n_leaves"), (F.col("from_here") + F.col("others")).alias("saved"))
    total, leaves = facts.agg(F.sum("t"), F.sum("leaf")).first()
    top_children = nodes.where("d = 1").count()
    top = spark.createDataFrame([(root, 0, None, n_convs, top_children, leaves, total)], "conv long, d long, parent long, members long, n_children long, n_leaves long, saved long")
    last = paths.join(lengths.select("conv", F.col("len").alias("d")), ["conv", "d"]).select("owner", "d", "conv")
    digests = _digests(last.unionByName(ends)).withColumnRenamed("owner", "conv")
    out = out.unionByName(top).join(digests, ["conv", "d"], "left")
    return out.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
