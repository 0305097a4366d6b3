"""The commands as functions of DataFrames: what each combines, with its defaults.

Sequences are (seq_idx, seq_id, seq). nucs_after_tss None is half of each sequence. Matrices are given with their pseudo counts
added (sources.readers.read_pwms); the defaults are 0.25 for scans, curves and regions, 0.01 for features, 0.001 for open ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.operators import features, peaks, scan, stats, windows
from motifspark.operators.background import global_background
from motifspark.operators.intervals import Tiles, interval_sums
from motifspark.operators.kernel import STRANDS, Background, Pwm, Scorer
from motifspark.sources import readers, sinks, split_fasta
from motifspark.sources.scratch import stored

BG_WINDOW = 250
PSEUDO = {"scan": 0.25, "curve": 0.25, "features": 0.01, "by_place": 0.0, "open": 0.001}


def strands_of(strand: str) -> tuple[str, ...]:
    if strand not in ("BOTH", *STRANDS):
        raise ValueError("strand is BOTH, FWD or REV")
    return STRANDS if strand == "BOTH" else (strand,)


def local(window: int = BG_WINDOW) -> Background:
    """Local background of both orders; window 0 is the neutral one."""
    return Background("local", window=window) if window else Background("equal")


def named(seqs: DataFrame, seq_name: str | None) -> DataFrame:
    return seqs if seq_name is None else seqs.where(F.col("seq_id") == seq_name)


def scan_hits(seqs: DataFrame, pwms: list[Pwm], m0: list[float] | None = None, m1: list[list[float]] | None = None, use_m1: bool = False, strand: str = "BOTH", cutoffs: list[float] | None = None, nucs_after_tss: int | None = 0) -> DataFrame:
    """Hits under a global background, counted from the sequences unless given; first order if use_m1 or m1 is given."""
    return scan.score_sites(seqs, scan_scorer(seqs, pwms, m0, m1, use_m1, strand, cutoffs), nucs_after_tss)


def scan_scorer(seqs: DataFrame, pwms: list[Pwm], m0: list[float] | None = None, m1: list[list[float]] | None = None, use_m1: bool = False, strand: str = "BOTH", cutoffs: list[float] | None = None) -> Scorer:
    bg = Background("global", m0, m1) if m0 else global_background(seqs, use_m1 and m1 is None)
    if m1 is not None:
        bg.m1 = m1
    return Scorer(pwms, bg, strands_of(strand), cutoffs)


def stored_scan(seqs: DataFrame, pwms: list[Pwm], strand: str = "BOTH", cutoffs: list[float] | None = None) -> tuple[DataFrame, Scorer]:
    """Pieces (scan.pieces), written once, and scan_scorer by a background of order 0 that is counted from the starts they answer for."""
    cut_up = stored(scan.pieces(seqs, *scan.reach(Scorer(pwms))))
    own = F.substr("piece", (F.col("skip") + 1).cast("int"), F.col("own").cast("int"))
    return cut_up, scan_scorer(cut_up.select("seq_idx", "seq_id", own.alias("seq")), pwms, strand=strand, cutoffs=cutoffs)


def scan_totals(seqs: DataFrame, pwms: list[Pwm], nucs_after_tss: int | None = 0, **options) -> DataFrame:
    """What scan_hits finds, added up by strand and matrix (scan.totals); no hit leaves the tasks."""
    scorer = scan_scorer(seqs, pwms, **options)
    return scan.totals(scan.pieces(seqs, *scan.reach(scorer)), scorer, nucs_after_tss)


def scan_split_fasta(spark: SparkSession, path: str, pwms: list[Pwm], m0: list[float] | None = None, strand: str = "BOTH", cutoffs: list[float] | None = None, nucs_after_tss: int | None = 0) -> DataFrame:
    """scan_hits of a sequence file whose records may be of any length: no task holds a whole one. The background has order 0."""
    return scan.score_pieces(*_split_scan(spark, path, pwms, m0, strand, cutoffs), nucs_after_tss)


def split_fasta_totals(spark: SparkSession, path: str, pwms: list[Pwm], m0: list[float] | None = None, strand: str = "BOTH", cutoffs: list[float] | None = None, nucs_after_tss: int | None = 0) -> DataFrame:
    """scan_totals of such a file."""
    return scan.totals(*_split_scan(spark, path, pwms, m0, strand, cutoffs), nucs_after_tss)


def _split_scan(spark: SparkSession, path: str, pwms: list[Pwm], m0: list[float] | None, strand: str, cutoffs: list[float] | None) -> tuple[DataFrame, Scorer]:
    segments = split_fasta.read_split_fasta(spark, path)
    bg = Background("global", m0) if m0 else global_background(segments.select(F.col("bases").alias("seq")))
    scorer = Scorer(pwms, bg, strands_of(strand), cutoffs)
    return split_fasta.segment_pieces(segments, *scan.reach(scorer)), scorer


def curves(seqs: DataFrame, pwms: list[Pwm], bg_window: int = BG_WINDOW, strand: str = "BOTH", cutoffs: list[float] | None = None, nucs_after_tss: int | None = None, seq_name: str | None = None, min_flank: int = 1000) -> DataFrame:
    """(strand, pwm_id, loc, cumscore) under local backgrounds, of sequences with min_flank places on either side of the TSS."""
    n = F.length("seq")
    after = F.floor(n / 2) if nucs_after_tss is None else F.lit(nucs_after_tss)
    kept = named(seqs, seq_name).where((after >= min_flank) & (n - after - 1 >= min_flank))
    scorer = Scorer(pwms, local(bg_window), strands_of(strand), cutoffs)
    found = scan.curve(scan.pieces(kept, *scan.reach(scorer)), scorer, nucs_after_tss)
    return found.groupBy("strand", "pwm_id", "loc").agg(F.sum("cumscore").alias("cumscore"))


def regions(seqs: DataFrame, pwms: list[Pwm], pwm_rows: DataFrame, length: int, nucs_after_tss: int, flank: int = 1000, **options) -> DataFrame:
    """Regions of enrichment of sequences of one length, a row for each matrix and strand."""
    up, down = peaks.search_range(length, nucs_after_tss, flank)
    found = peaks.peaks(curves(seqs, pwms, nucs_after_tss=nucs_after_tss, min_flank=flank, **options), up, down)
    return peaks.roe_table(found, pwm_rows)


def tile_specs(pwms: list[Pwm], up: int, down: int, width: int, max_scores: list[float] | None = None) -> list[features.WindowSpec]:
    """Tiles by strand, matrix and number; with max_scores values are shares of width times maximum, times ten."""
    scale = lambda p: width * max_scores[p.pwm_idx] / 10 if max_scores else 1.0
    return [features.WindowSpec(f"{p.pwm_id}_{s}_{k}_tile{width}", p.pwm_idx, s, -up + (k - 1) * width, -up + k * width, scale(p)) for s in STRANDS for p in pwms for k in range(1, (up + down) // width + 1)]


def tiled_features(seqs: DataFrame, pwms: list[Pwm], up: int, down: int, width: int, bg_window: int = BG_WINDOW, cutoffs: list[float] | None = None, nucs_after_tss: int | None = None, max_scores: list[float] | None = None) -> tuple[DataFrame, list[features.WindowSpec]]:
    """window_features of the tiles, and the tiles. The variant with max_scores also has contents: features.content_features."""
    specs = tile_specs(pwms, up, down, width, max_scores)
    return features.window_features(seqs, Scorer(pwms, local(bg_window), cutoffs=cutoffs), specs, nucs_after_tss), specs


def roe_specs(roe: DataFrame, max_scores: list[float] | None = None, flank: tuple[int, int] | None = None) -> list[features.WindowSpec]:
    """Specs of the seven windows of each region (a parameter-sized table), shifted over flanks (length, number) if given.

    With max_scores values are shares of the window's width before clipping times the matrix's maximum, times ten.
    """
    table = windows.roe_windows(roe)
    if flank:
        table = windows.flanks(table, *flank)
        table = table.withColumn("feature_id", F.concat_ws("_flank", "feature_id", F.col("flank").cast("string")))
    else:
        table = table.withColumn("flank", F.lit(0))
    rows = table.orderBy("strand", "row_idx", "win_no", "flank").collect()
    scale = lambda r: abs(r.left - r.right) * (max_scores[r.pwm_idx] if max_scores else 0.0) / 10
    return [features.WindowSpec(r.feature_id, r.pwm_idx, r.strand, r.left, r.right, scale(r) if max_scores is not None else 1.0) for r in rows]


def region_features(seqs: DataFrame, pwms: list[Pwm], roe: DataFrame, bg_window: int = BG_WINDOW, cutoffs: list[float] | None = None, nucs_after_tss: int | None = None, max_scores: list[float] | None = None, flank: tuple[int, int] | None = None, by_place: bool = False, seq_name: str | None = None) -> tuple[DataFrame, list[features.WindowSpec]]:
    """window_features (or scores_by_place, without flanks) of the regions' windows, at the sequences' positions, and the windows."""
    specs = roe_specs(roe, max_scores, None if by_place else flank)
    scorer = Scorer(pwms, local(bg_window), cutoffs=cutoffs)
    make = features.scores_by_place if by_place else features.window_features
    return make(named(seqs, seq_name), scorer, specs, nucs_after_tss), specs


def collapsed_region_features(seqs: DataFrame, pwms: list[Pwm], roe: DataFrame, bg_window: int = BG_WINDOW, cutoffs: list[float] | None = None, nucs_after_tss: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(long features of the seven windows of each region, the map of the collapsed windows): features keep all seven, the map one of each region."""
    table, specs = region_features(seqs, pwms, roe, bg_window, cutoffs, nucs_after_tss)
    return features.long_features(table, specs), windows.collapsed(windows.roe_windows(roe))


def open_tiles(seqs: DataFrame, pwms: list[Pwm], intervals: DataFrame, up: int, down: int, width: int, bg_window: int = BG_WINDOW, cutoffs: list[float] | None = None, nucs_after_tss: int | None = None) -> DataFrame:
    """(seq_id, pwm_id, strand, tissue, win_no, value) over the open parts of tiles; win_no null is the overall sum. Closed ones have no row."""
    given = intervals.select("seq_id", "tissue", F.lit(None).cast("string").alias("feature_id"), F.lit(None).cast("int").alias("which"), F.col("start").alias("left"), F.col("end").alias("right"))
    sums = interval_sums(seqs, Scorer(pwms, local(bg_window), cutoffs=cutoffs), given, nucs_after_tss, Tiles(up, down, width))
    keys = ["seq_id", "pwm_id", "strand", "tissue"]
    return sums.groupingSets([[*keys, "win_no"], keys], *keys, "win_no").agg(F.sum("value").alias("value"))


def open_regions(seqs: DataFrame, pwms: list[Pwm], roe: DataFrame, intervals: DataFrame, bg_window: int = BG_WINDOW, cutoffs: list[float] | None = None, nucs_after_tss: int | None = None) -> DataFrame:
    """(seq_id, feature_id, tissue, value) over the open intervals of the regions' windows, as they are given.

    Intervals without a column feature_id are those of every window: they are summed once for each matrix and strand, and named at the end.
    """
    scorer = Scorer(pwms, local(bg_window), cutoffs=cutoffs)
    places = [(p.pwm_idx, s, k) for k, (s, p) in enumerate((s, p) for s in scorer.strands for p in pwms)]
    which = seqs.sparkSession.createDataFrame(places, "pwm_idx int, strand string, which int")
    own = windows.roe_windows(roe).join(which, ["pwm_idx", "strand"]).select("feature_id", "which", "pwm_idx", "strand")
    if "feature_id" not in intervals.columns:
        given = intervals.select("seq_id", "tissue", F.lit(None).cast("string").alias("feature_id"), F.lit(None).cast("int").alias("which"), F.col("start").alias("left"), F.col("end").alias("right"))
        sums = interval_sums(seqs, scorer, given, nucs_after_tss).drop("feature_id")
        return sums.join(windows.parameters(own.drop("which")), ["pwm_idx", "strand"]).select("seq_id", "feature_id", "tissue", "value")
    met = intervals.join(own, "feature_id").select("seq_id", "tissue", "feature_id", "which", F.col("start").alias("left"), F.col("end").alias("right"))
    return interval_sums(seqs, scorer, met, nucs_after_tss).select("seq_id", "feature_id", "tissue", "value")


def site_report(spark: SparkSession, sites: str, matrices: str, histograms: str, out: str | None = None, compat: bool = False) -> DataFrame:
    """The statistics of a file of sites, by a matrix file (as written, without pseudo counts) and a folder of `.hbin` files; out: also as text.

    Columns: site_id, line, motif_rc, flank_rc, fp, fn, score.
    """
    library = readers.pwm_table(spark, readers.read_raw_pwms(spark, matrices))
    report = stats.site_report(readers.read_sites(spark, sites), library, readers.read_histograms(spark, histograms), compat)
    if out:
        sinks.write_site_report(report, readers.read_header(spark, sites), out)
    return report
