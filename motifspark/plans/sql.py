"""The library from SQL: files as temporary views, and scans as a table function.

    open_views(spark, {"promoters": ("fasta", "promoters.fa"), "roe": ("regions", "roe.FWD.table", "FWD")})
    open_scan(spark, seqs, pwms, Background("global", m0))
    spark.sql("SELECT s.seq_id, h.* FROM sites_pieces AS s, LATERAL sites(s.n, s.offset, s.skip, s.own, s.piece) AS h WHERE h.pwm_id = 'TATA'")
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from motifspark.operators import background, scan, windows
from motifspark.operators.kernel import Background, Pwm, Scorer
from motifspark.sources import binary_matrix, readers, split_fasta

READERS = {
    "fasta": readers.read_fasta,
    "fasta_segments": split_fasta.read_split_fasta,
    "matrices": lambda spark, path, pseudo=0.0: readers.pwm_table(spark, readers.read_pwms(spark, path, pseudo)),
    "site_groups": readers.read_site_groups,
    "column": readers.read_double_column,
    "table": readers.read_double_matrix,
    "regions": readers.read_roe,
    "label_lists": readers.read_label_lists,
    "islands": readers.read_islands,
    "draws": readers.read_draws,
    "open_tiles": readers.read_open_tiles,
    "open_windows": readers.read_open_windows,
    "histograms": readers.read_histograms,
    "sites": readers.read_sites,
    "curves": readers.read_curves,
    "feature_matrix": binary_matrix.read_binary,
}


def open_views(spark: SparkSession, files: dict[str, tuple]) -> None:
    """A temporary view for each name, of a kind of READERS and its reader's arguments."""
    for name, (kind, *args) in files.items():
        if kind not in READERS:
            raise ValueError(f"kinds are {', '.join(READERS)}")
        READERS[kind](spark, *args).createOrReplaceTempView(name)


def open_tiles_view(spark: SparkSession, name: str, up: int, down: int, width: int) -> None:
    windows.tiles(spark, up, down, width).createOrReplaceTempView(name)


def open_backgrounds(seqs: DataFrame, name: str) -> None:
    """Views name_m0 (base, freq) and name_m1 (prev, base, freq) of all sequences."""
    background.base_frequencies(seqs).createOrReplaceTempView(f"{name}_m0")
    background.pair_frequencies(seqs).createOrReplaceTempView(f"{name}_m1")


def open_scan(spark: SparkSession, seqs: DataFrame, pwms: list[Pwm], bg: Background | None = None, cutoffs: list[float] | None = None, nucs_after_tss: int | None = 0, name: str = "sites") -> None:
    """The table function `name` (n, offset, skip, own, piece) -> (strand, pwm_idx, pwm_id, loc, score), hits above the cutoffs, the table
    function name_totals of the same -> (strand, pwm_idx, pwm_id, n_hits, total, first_loc, last_loc), which adds up a piece's, and the views name_pieces of seqs (seq_idx, seq_id, seq), cut and dealt to the tasks, and name_matrices."""
    scorer = Scorer(pwms, bg or Background(), cutoffs=cutoffs)
    scan.pieces(seqs, *scan.reach(scorer)).createOrReplaceTempView(f"{name}_pieces")
    readers.pwm_table(spark, pwms).createOrReplaceTempView(f"{name}_matrices")

    class Sites:
        def eval(self, n: int, offset: int, skip: int, own: int, piece: str) -> Iterator[tuple]:
            shift = offset - (n - (n // 2 if nucs_after_tss is None else nucs_after_tss))
            for p, strand, at, score in scorer.hits([(piece, n)]):
                mine = (at >= skip) & (at < skip + own)
                for loc, value in zip((at[mine] + shift).tolist(), np.asarray(score)[mine].tolist(), strict=True):
                    yield strand, p.pwm_idx, p.pwm_id, loc, value

    spark.udtf.register(name, udtf(Sites, returnType="strand string, pwm_idx int, pwm_id string, loc bigint, score double"))

    class Totals:
        def eval(self, n: int, offset: int, skip: int, own: int, piece: str) -> Iterator[tuple]:
            met = np.zeros((1, len(kinds)), bool)
            for k, hits, _, total, first, last in scan.hit_totals([(None, None, n, offset, skip, own, piece)], scorer, nucs_after_tss, met):
                yield *kinds[k], hits, total, first, last

    kinds = [(s, p.pwm_idx, p.pwm_id) for s in scorer.strands for p in scorer.pwms]
    spark.udtf.register(f"{name}_totals", udtf(Totals, returnType="strand string, pwm_idx int, pwm_id string, n_hits bigint, total double, first_loc bigint, last_loc bigint"))
