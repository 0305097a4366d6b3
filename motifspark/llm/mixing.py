"""Operator 9: mixing sources to target weights, in DataFrame functions only.

Each source's words form one stream, its documents in a fixed pseudorandom order, cut into blocks of `block` words. A source
needs so many slots: all blocks for each whole epoch of its target, and for the last epoch as many as give the words missing.
Output shards draw the source of each of their slots independently, with the sources' shares of all slots as chances, so the
counts of a shard are a multinomial draw. A source takes its slots in order of shards; what is drawn beyond its slots is void,
and what it has left goes to a few more shards at the end, so totals are exact to a word. The i-th slot of a source takes the
block that a pseudorandom index permutation of that source and epoch maps i to; the last slot takes only the words still
missing. Blocks and the documents' pieces in them are joined by index.

Permutations are swap-or-not networks (Hoang, Morris, Rogaway 2012): right for any length, and invertible.
Running sums have two levels, so that neither a source's documents nor its shards meet in one task. Only the table of
sources, one short row each, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256  # words of a block
SHARD = 1024  # slots of an output shard
ROUNDS = 24  # of the permutations
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # of all words, that the mix holds
CAP = 2.0  # times its own size, that a source may give
SPAN = 1 << 12  # shards whose counts are summed up together
SEED = 20


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """x's place under the pseudorandom permutation of 0 ... n-1 that key names."""
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), key, r, F.greatest(at, partner)), F.lit(2)) == 1, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), x, swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size).

    Sources by code point, null last, take the weights in turn. Their targets add up to share of all words; a source
    stops at cap times its size and the excess goes to the others by weight. With sources in order of cap / weight,
    the capped ones are a prefix, so the level of the others is one running sum; one row per source is all it sees.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    out = out.withColumn("place", F.row_number().over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / rest)
    capped = F.col("level") * F.col("weight") >= F.col("most")
    # the first source that isn't capped sets the level of all that follow
    out = out.withColumn("level", F.min(F.when(~capped, F.struct("place", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most")))
    return out.select("source", "source_size", "weight", target.alias("target"))


def _layout(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (id, source, size, text) with start, the words before each in its source's stream."""
    tie = [F.col("id").asc_nulls_first(), "size", "mark"]
    rows = docs.withColumn("mark", F.xxhash64("text")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), F.lit(buckets)))
    rows = rows.drop("text")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(running), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    return rows.join(sums, same).select("id", "source", "size", "mark", (F.col("offset") + F.col("inner")).alias("start"))


class Mix:
    """The tables of a mix: documents (id, source, size, mark, start), sources, counts, slots and pieces."""

    def __init__(self, documents: DataFrame, sources: DataFrame, counts: DataFrame, slots: DataFrame, pieces: DataFrame):
        self.documents, self.sources, self.counts, self.slots, self.pieces = documents, sources, counts, slots, pieces


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> Mix:
    """Mix all docs.

    documents: id, source, size (words; 0 for null text), mark (hash of the text) and start in the source's stream.
    sources: source, source_size, weight, target, wanted (the target in whole words), n_blocks and n_slots, with no, its place.
    counts: no, shard, drawn (slots of the shard that drew the source), n (those it has slots left for) and first (its slots
    before); shards beyond those that draw hold what is left, drawn 0.
    slots: source, block, epoch, shard, slot (a number of its own in the whole mix), take (words from the block's start).
    pieces: what each slot takes of each document: source, start (of the document), shard, slot, epoch, first (word of
    the document), words.
    A null source is a source, last in order; rows that repeat an id are documents of their own; an empty table gives
    empty tables.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.col(text_col).alias("text"))
    buckets = power_of_two(docs.count() / 2000, 64, 1 << 17)
    documents = stored(_layout(rows, buckets))
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, cap).withColumn("wanted", F.floor(F.col("target") + 1e-6))
    sources = stored(_needs(sources.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}")), block))
    counts = stored(_counts(sources))
    slots = stored(_slots(sources, counts, block))
    return Mix(documents, sources, counts, slots, _pieces(documents, slots, block))


def _epoch_key(epoch: Column) -> Column:
    return F.xxhash64(F.lit("blocks"), F.coalesce("source", F.lit("\x00null")), epoch)


def _needs(sources: DataFrame, block: int) -> DataFrame:
    """sources with their slots: whole (epochs that take every block), words (of the last epoch), tail (words of the last
    block), short (the last epoch's slot of that block), n_slots, before (slots of the sources before), no."""
    n, some = F.col("n_blocks"), F.col("wanted") > 0
    out = sources.withColumn("whole", F.when(some, F.expr("(wanted - 1) div source_size")).otherwise(0))
    out = out.withColumns({"words": F.col("wanted") - F.col("whole") * F.col("source_size"), "tail": F.expr(f"source_size - (n_blocks - 1) * {block}")})
    out = out.withColumn("short", F.when(some, permuted(n - 1, F.greatest(n, F.lit(1)), _epoch_key(F.col("whole")), inverse=True)))
    # the last epoch has one slot more if the short block is among its slots and they don't suffice
    full = F.expr(f"(words + {block - 1}) div {block}")
    more = (F.col("short") < full) & (full < n) & (full * block - block + F.col("tail") < F.col("words"))
    slots = F.col("whole") * n + F.least(n, full + more.cast("long"))
    out = out.withColumn("n_slots", F.when(some, slots).otherwise(0).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("n_slots").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumns({"before": before.cast("long"), "no": F.row_number().over(order).cast("long")})


def _counts(sources: DataFrame) -> DataFrame:
    """(no, shard, drawn, n, first), see mix."""
    spark = sources.sparkSession
    total, n_sources = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # each slot draws a number below the total; the source whose range holds it is found by a bucket of numbers
    width = total // (4 * n_sources + 64) + 1
    draws = spark.range(0, total, 1, parts).select(F.expr(f"id div {SHARD}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 3), "id"), F.lit(max(1, total))).alias("at"))
    ranges = sources.where("n_slots > 0").select("no", "n_slots", "before", F.explode(F.expr(f"sequence(before div {width}, (before + n_slots - 1) div {width})")).alias("bucket"))
    met = draws.withColumn("bucket", F.expr(f"at div {width}")).join(ranges, "bucket").where("at >= before AND at < before + n_slots")
    drawn = stored(met.groupBy("no", "n_slots", "shard").agg(F.count("*").alias("drawn")).withColumn("span", F.expr(f"shard div {SPAN}")))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    spans = drawn.groupBy("no", "span").agg(F.sum("drawn").alias("sum"))
    spans = spans.select("no", "span", F.coalesce(F.sum("sum").over(earlier("no").orderBy("span")), F.lit(0)).alias("spans_before"))
    within = F.coalesce(F.sum("drawn").over(earlier("no", "span").orderBy("shard")), F.lit(0))
    placed = drawn.withColumn("within", within).join(spans, ["no", "span"]).withColumn("first", F.col("spans_before") + F.col("within"))
    n = F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("n_slots") - F.col("first")))
    placed = placed.select("no", "shard", "drawn", n.cast("long").alias("n"), "first")
    # slots that no shard drew: in order of the sources, in shards of their own
    got = drawn.groupBy(F.col("no").alias("d_no")).agg(F.sum("drawn").alias("d_sum"))
    left = sources.join(got, F.col("no") == F.col("d_no"), "left").select("no", "n_slots", F.coalesce("d_sum", F.lit(0)).alias("first")).where("n_slots > first")
    at = F.coalesce(F.sum(F.col("n_slots") - F.col("first")).over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.withColumn("at", at).withColumn("k", F.explode(F.expr(f"sequence(at div {SHARD}, (at + n_slots - first - 1) div {SHARD})")))
    start = F.greatest(F.col("at"), F.col("k") * SHARD)
    end = F.least(F.col("at") + F.col("n_slots") - F.col("first"), (F.col("k") + 1) * SHARD)
    left = left.select("no", (F.col("k") + -(-total // SHARD)).alias("shard"), F.lit(0).cast("long").alias("drawn"), (end - start).alias("n"), (F.col("first") + start - F.col("at")).alias("first"))
    return placed.unionByName(left)


def _slots(sources: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    n, i = F.col("n_blocks"), F.col("i")
    used = counts.where("n > 0")
    shard = Window.partitionBy("shard")
    before = F.coalesce(F.sum("n").over(shard.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = used.withColumns({"in_shard": before, "shard_size": F.sum("n").over(shard)})
    facts = sources.select("no", "source", "source_size", "n_blocks", "whole", "words", "tail", "short")
    # with a number Spark does not put the rows together again: all the work comes after them
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = used.join(facts, "no").repartition(parts, "no", "shard").withColumn("j", F.explode(F.expr("sequence(0L, n - 1)")))
    slots = slots.withColumn("i", F.col("first") + F.col("j")).withColumn("epoch", F.expr("i div n_blocks"))
    slots = slots.withColumn("i", i - F.col("epoch") * n).withColumn("block", permuted(i, n, _epoch_key(F.col("epoch"))))
    slots = slots.withColumn("slot", F.col("shard") * SHARD + permuted(F.col("in_shard") + F.col("j"), F.col("shard_size"), F.xxhash64(F.lit("slots"), "shard")))
    size = F.when(F.col("block") == n - 1, F.col("tail")).otherwise(block)
    done = i * block - F.when(F.col("short") < i, block - F.col("tail")).otherwise(0)
    take = F.when(F.col("epoch") < F.col("whole"), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("words") - done)))
    return slots.select("source", "block", "epoch", "shard", "slot", take.alias("take")).where("take > 0")


def _pieces(documents: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    parts = documents.where("size > 0").select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    taken = slots.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), "block", "epoch", "shard", "slot", "take")
    first = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    out = parts.join(taken, ["name", "no_name", "block"]).withColumns({"first": first - F.col("start"), "words": end - first}).where("words > 0")
    return out.select(F.when(~F.col("no_name"), F.col("name")).alias("source"), "start", "shard", "slot", "epoch", "first", "words")


def taken(m: Mix) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, repeats counted), mark, start."""
    sums = m.pieces.groupBy(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), "start").agg(F.sum("words").alias("taken"))
    docs = m.documents.withColumns({"name": F.coalesce("source", F.lit("")), "no_name": F.col("source").isNull()})
    # documents without words share their start with the next one
    some = docs.where("size > 0").join(sums, ["name", "no_name", "start"], "left")
    rows = some.select("id", "source", "size", "mark", "start", F.coalesce("taken", F.lit(0)).alias("taken"))
    rows = rows.unionByName(docs.where("size = 0").select("id", "source", "size", "mark", "start", F.lit(0).cast("long").alias("taken")))
    facts = m.sources.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mixed_texts(docs: DataFrame, m: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix: all columns of docs, one row for each epoch that takes words of a document.

    A text that is taken whole stays as it is; of others the taken runs of words stay, each with the white space that follows it.
    Null texts and texts without a word are never taken; null ids and sources are like any other; rows that repeat id, text and
    source are taken each for itself, in the order of their hashes; columns may have any name; an empty table gives an empty one.
    """
    runs = m.pieces.groupBy(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), "start", "epoch")
    runs = runs.agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("first", F.col("words").alias("n")))).alias("runs"))
    ids = m.documents.where("size > 0").withColumns({"name": F.coalesce("source", F.lit("")), "no_name": F.col("source").isNull()})
    wanted = runs.join(ids.select("name", "no_name", "start", "id", "size", "mark"), ["name", "no_name", "start"])
    wanted = wanted.select(F.col("id").alias("m_id"), F.col("mark").alias("m_mark"), "name", "no_name", F.col("words").alias("m_words"), F.col("size").alias("m_size"), F.col("runs").alias("m_runs"), F.col("start").alias("m_start"), F.col("epoch").alias("m_epoch"))
    # rows that repeat id, source and text have places of their own in the stream: the n-th row takes the n-th place
    place = Window.partitionBy("m_id", "m_mark", "name", "no_name").orderBy("m_start")
    wanted = wanted.withColumn("m_no", F.dense_rank().over(place))
    # the row is one column here, so that no name of docs can clash with those used in between
    row = lambda c: F.col(f"row.`{c}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"d_id": row(id_col), "d_mark": F.xxhash64(row(text_col)), "d_name": F.coalesce(row(source_col), F.lit("")), "d_no_name": row(source_col).isNull()})
    rows = rows.withColumn("d_no", F.row_number().over(Window.partitionBy("d_id", "d_mark", "d_name", "d_no_name").orderBy(F.xxhash64("row"))))
    same = F.col("m_id").eqNullSafe(F.col("d_id")) & (F.col("m_mark") == F.col("d_mark")) & (F.col("name") == F.col("d_name")) & (F.col("no_name") == F.col("d_no_name")) & (F.col("m_no") == F.col("d_no"))
    tokens = F.regexp_extract_all(row(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    some = F.array_join(F.flatten(F.transform("m_runs", lambda r: F.slice(tokens, (r["first"] + 1).cast("int"), r["n"].cast("int")))), "")
    text = F.when(F.col("m_words") == F.col("m_size"), row(text_col)).otherwise(some)
    return rows.join(wanted, same).select(*[(text if c == text_col else row(c)).alias(c) for c in docs.columns])
