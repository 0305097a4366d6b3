"""Window generators: tiles, the seven windows of a region of enrichment, positions, flanks and their genomic map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BUCKET = 1024  # places
MOST_PARAMETERS = 100_000  # rows of a table that is broadcast


def parameters(table: DataFrame) -> DataFrame:
    """A table of parameters (windows, matrices), to be broadcast; an error if it is none by its size."""
    if table.limit(MOST_PARAMETERS + 1).count() > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} rows of parameters")
    return F.broadcast(table)


def tiles(spark: SparkSession, up: int, down: int, width: int) -> DataFrame:
    """(win_no, left, right) from -up on, inclusive at both ends, so that neighbours share a start; a remainder is dropped."""
    if width <= 0 or up + down < 0:
        raise ValueError("tiles need a positive width and a range")
    k = F.col("id")
    return spark.range(1, (up + down) // width + 1).select(k.alias("win_no"), (-up + (k - 1) * width).alias("left"), (-up + k * width).alias("right"))


def roe_windows(roe: DataFrame) -> DataFrame:
    """Seven windows of each row of (row_idx, pwm_id, strand, max_peak_loc, half_width); rows without numbers have none.

    Five cover the peak in steps of a sixth of its width; the outer two reach to its full width if it is narrow. The matrix
    is bound by row_idx, as pwm_idx. Columns: row_idx, pwm_idx, pwm_id, strand, win_no, feature_id, left, right.
    """
    rows = roe.where(F.col("max_peak_loc").isNotNull() & F.col("half_width").isNotNull() & ~F.isnan("max_peak_loc") & ~F.isnan("half_width"))
    cent, full = F.col("max_peak_loc").cast("int"), 2 * F.col("half_width")
    step = F.greatest(F.lit(1), (full / 6).cast("int"))
    v, narrow = F.col("v"), F.col("half_width") < 100
    out = rows.withColumn("v", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    outer = narrow & (F.abs(v) == 3)
    reach = full.cast("int")
    mid = F.when(outer & (v < 0), cent - reach).when(outer, cent + reach).otherwise(cent + v * step)
    half = F.when(outer, reach - 3 * step).otherwise(step)
    out = out.withColumns({"mid": mid, "half": half, "win_no": v + 4})
    name = F.concat_ws("_", "pwm_id", "strand", F.col("win_no").cast("string"))
    return out.select("row_idx", F.col("row_idx").cast("int").alias("pwm_idx"), "pwm_id", "strand", "win_no", name.alias("feature_id"), (F.col("mid") - F.col("half")).alias("left"), (F.col("mid") + F.col("half")).alias("right"))


def fixed_positions(seqs: DataFrame, positions: list[int]) -> DataFrame:
    """seqs once for each position, in column pos."""
    return seqs.withColumn("pos", F.explode(F.array(*[F.lit(int(x)) for x in positions])))


def range_positions(seqs: DataFrame, step: int, left: int, right: int, compat: bool = False) -> DataFrame:
    """seqs at left, left + step, ... right. compat: (right-left+1)/step slots of which every step-th is set, the rest 0."""
    if compat:
        slots = (right - left + 1) // step
        return fixed_positions(seqs, [left + i if i % step == 0 else 0 for i in range(slots)])
    return seqs.withColumn("pos", F.explode(F.sequence(F.lit(left), F.lit(right), F.lit(step))))


def random_positions(seqs: DataFrame, count: int, left: int, right: int, seed: int = 0) -> DataFrame:
    """seqs at count different positions of left ... right each, those of the smallest MD5 of `seed_index_position`: reruns agree."""
    if count > right - left + 1:
        raise ValueError(f"{count} different positions do not fit into {left} ... {right}")
    text = lambda x: F.concat_ws("_", F.lit(str(seed)), F.col("seq_idx").cast("string"), x.cast("string"))
    drawn = F.transform(F.sequence(F.lit(left), F.lit(right)), lambda x: F.struct(F.md5(text(x)).alias("h"), x.alias("x")))
    return seqs.withColumn("pos", F.explode(F.transform(F.slice(F.array_sort(drawn), 1, count), lambda s: s["x"])))


ROUNDS = 24  # of the permutation


def permuted_positions(seqs: DataFrame, count: int, left: int, right: int, seed: int = 0) -> DataFrame:
    """seqs at count different positions of left ... right each: the first ones of a keyed permutation of the range, so count draws
    cost count, whatever the range. Reruns agree.

    The permutation is swap-or-not: in each round a place changes with its mirror image around a round's key if the pair's bit says so. Keys and
    bits are the first 32 bits of MD5 of `seed_index_round` and of it and the pair's larger place.
    """
    size = right - left + 1
    if count > size:
        raise ValueError(f"{count} different positions do not fit into {left} ... {right}")
    name = F.concat_ws("_", F.lit(str(seed)), F.col("seq_idx").cast("string"))
    draw = lambda *x: F.conv(F.substring(F.md5(F.concat_ws("_", name, *[c.cast("string") for c in x])), 1, 8), 16, 10).cast("long")

    def turn(x: Column, r: Column) -> Column:
        mirror = lambda y: F.pmod(F.element_at("keys", r + 1) - y, F.lit(size))
        return F.when(draw(r, F.greatest(x, mirror(x))) % 2 == 1, mirror(x)).otherwise(x)

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    rows = seqs.withColumn("keys", F.transform(rounds, lambda r: draw(r)))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))) if count else F.explode(F.array().cast("array<bigint>")))
    return rows.withColumn("pos", (F.aggregate(rounds, F.col("pos"), turn) + left).cast("int")).drop("keys")


def replicate_positions(seqs: DataFrame, draws: DataFrame) -> DataFrame:
    """seqs at the positions that draws (label, pos) has for them."""
    return seqs.join(draws.select(F.col("label").alias("seq_id"), "pos"), "seq_id")


def flanks(windows: DataFrame, length: int, number: int) -> DataFrame:
    """Every window shifted by k * (length / number), k from -number to number, in column flank."""
    if number <= 0 or length % number:
        raise ValueError("the flanks' length must be a multiple of their number, which is positive")
    shift = F.col("flank") * (length // number)
    out = windows.withColumn("flank", F.explode(F.sequence(F.lit(-number), F.lit(number))))
    return out.withColumns({"left": F.col("left") + shift, "right": F.col("right") + shift})


def anchors(seqs: DataFrame, legacy: bool = False) -> DataFrame:
    """seqs with ref_seq, ref_start and ref_strand from labels `id_reference_start[_strand]`; strand + if there is none.

    legacy takes the last two parts of the label, whatever comes before, and knows no minus strand.
    """
    parts = F.split("seq_id", "_")
    if legacy:
        return seqs.withColumns({"ref_seq": F.try_element_at(parts, F.lit(-2)), "ref_start": F.expr("try_cast(try_element_at(split(seq_id, '_'), -1) AS BIGINT)"), "ref_strand": F.lit("+")})
    return seqs.withColumns({"ref_seq": F.try_element_at(parts, F.lit(2)), "ref_start": F.expr("try_cast(try_element_at(split(seq_id, '_'), 3) AS BIGINT)"), "ref_strand": F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("+"))})


def genomic_map(anchored: DataFrame, windows: DataFrame, widths: DataFrame, nucs_after_tss: int | None = None) -> DataFrame:
    """Where each window lies in its sequence and genome, ten columns.

    anchored: sequences with anchors and pos; windows: pwm_idx, feature_id, left, right; widths: pwm_idx, w. Windows are
    a parameter-sized table, so they are joined by broadcast; starts are clipped to 0 and ends to the last site.
    """
    n = F.length("seq").cast("long")
    after = F.floor(n / 2) if nucs_after_tss is None else F.lit(nucs_after_tss)
    rows = anchored.select("seq_idx", "seq_id", "pos", "ref_seq", "ref_start", "ref_strand", n.alias("n"), after.alias("after"))
    out = rows.join(parameters(windows.join(widths, "pwm_idx").select("feature_id", "left", "right", "w")), F.lit(True))
    minus = F.col("ref_strand") == "-"
    tss = F.when(minus, F.col("after") + 1).otherwise(F.col("n") - F.col("after"))
    lo = F.when(minus, -F.col("right")).otherwise(F.col("left")) + F.col("pos") + F.col("tss")
    hi = F.when(minus, -F.col("left")).otherwise(F.col("right")) + F.col("pos") + F.col("tss")
    out = out.withColumn("tss", tss).withColumns({"lo": F.greatest(F.lit(0), lo), "hi": F.least(F.col("n") - F.col("w"), hi)})
    return out.select(F.concat_ws("_", "seq_id", F.col("pos").cast("string")).alias("seq_id"), "feature_id", (F.col("left") + F.col("pos")).alias("relative_start"), (F.col("right") + F.col("pos")).alias("relative_end"), F.col("tss").alias("tss_start"), F.col("lo").alias("absolute_start"), F.col("hi").alias("absolute_end"), "ref_seq", (F.col("ref_start") + F.col("lo")).alias("genomic_start"), (F.col("ref_start") + F.col("hi")).alias("genomic_end"))


def collapsed(windows: DataFrame) -> DataFrame:
    """One window per matrix and strand, from window 1's left to window 7's right, named after the last."""
    return windows.groupBy("row_idx", "pwm_idx", "pwm_id", "strand").agg(F.max_by("win_no", "win_no").alias("win_no"), F.max_by("feature_id", "win_no").alias("feature_id"), F.min_by("left", "win_no").alias("left"), F.max_by("right", "win_no").alias("right"))


def clipped_to_open(windows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Tiles cut to open-chromatin intervals (seq_id, tissue, start, end): one row per overlap, so overlaps count twice.

    Both are listed in the buckets of places that they touch and joined on those; an overlap counts in the bucket of its start.
    """
    listed = lambda df, a, b: df.withColumn("bucket", F.explode(F.expr(f"sequence(cast(floor(`{a}` / {BUCKET}) as bigint), cast(floor(`{b}` / {BUCKET}) as bigint))")))
    both = listed(intervals.where("start <= `end`"), "start", "end").join(listed(windows.where("left <= right"), "left", "right"), "bucket")
    first = F.greatest("left", "start")
    both = both.where((F.col("start") <= F.col("right")) & (F.col("end") >= F.col("left")) & (F.col("bucket") == F.floor(first / BUCKET)))
    return both.select("seq_id", "tissue", "win_no", first.alias("left"), F.least("right", "end").alias("right"))


def with_order(windows: DataFrame, *order: str) -> DataFrame:
    """windows with feat_ord, their place in the wide output; a parameter-sized table."""
    return windows.withColumn("feat_ord", F.row_number().over(Window.orderBy(*order)) - 1)
