"""Readers of the text formats: sequences, matrices, columns, regions, intervals and histograms.

Sequence and table files of any size are read by Spark's text readers; matrix libraries, vectors and threshold files are
parameter-sized, are read by Spark too and only then gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifspark.functions.alphabet import reverse_complement
from motifspark.operators.kernel import Pwm


def read_fasta(spark: SparkSession, path: str, limit: list[str] | None = None, preamble: bool = False) -> DataFrame:
    """(seq_idx, seq_id, header, seq, n); records start at lines with >, spaces around lines go; limit keeps the named ones.

    A record is one line of a text reader whose lines end before a >, so files are split over tasks; seq_idx follows the
    order of files and places. preamble: drop text before a file's first header, at the price of another pass.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq_idx"))
    if preamble:
        first = raw.groupBy("file").agg(F.min("seq_idx").alias("first"))
        raw = raw.join(first, "file").where((F.col("seq_idx") > F.col("first")) | F.ltrim("value").startswith(">"))
    body = F.regexp_replace("value", r"^\s*>", "")
    rows = raw.select("seq_idx", F.split(body, "\n", 2).alias("p"))
    header = F.trim(F.regexp_replace(F.col("p")[0], "[\r\n]", ""))
    seq = F.regexp_replace(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), r"\s", "")
    out = rows.select("seq_idx", F.split(header, r"\s+")[0].alias("seq_id"), header.alias("header"), seq.alias("seq")).where(F.col("seq_id") != "")
    out = out.withColumn("n", F.length("seq"))
    return out if limit is None else out.where(F.col("seq_id").isin(limit))


def read_fasta_reverse_complement(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path).withColumn("seq", reverse_complement(F.col("seq")))


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a parameter-sized file, in order."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return [x.strip("\r") for x in text.split("\n")]


def _matrices(lines: list[str], label: type(lambda x: x)) -> list[tuple[str, str, list[list[float]]]]:
    """(label, header, rows) of records that start with > and end at a blank line or the end of the file."""
    found: list[tuple[str, str, list[list[float]]]] = []
    open_record = False
    for line in lines:
        if line.startswith(">"):
            found.append((label(line), line, []))
            open_record = True
        elif line.startswith("=") and open_record:
            found[-1][2].append([float(x) for x in line.split()[1:5]])
        else:
            open_record = False
    return found


def normalise(mat: list[list[float]], pseudo: float) -> list[list[float]]:
    """Adds pseudo to every cell and divides by the row's sum."""
    return [[(x + pseudo) / (sum(row) + 4 * pseudo) if sum(row) + 4 * pseudo else float("nan") for x in row] for row in mat]


def read_pwms(spark: SparkSession, path: str, pseudo: float = 0.0, included: list[str] | None = None, transfac: bool = False) -> list[Pwm]:
    """A library of matrices `> label`, rows `=` and A, C, G, T. transfac: labels are the six characters after AC=.

    Labels must be unique; the last record needs no blank line.
    """
    label = (lambda x: x.split("AC=", 1)[1][:6]) if transfac else (lambda x: x[1:].strip())
    rows = [(k, m) for k, _, m in _matrices(_lines(spark, path), label) if m and (included is None or k in included)]
    if len({k for k, _ in rows}) < len(rows):
        raise ValueError(f"{path} has a label twice")
    return [Pwm(i, k, normalise(m, pseudo)) for i, (k, m) in enumerate(rows)]


def read_raw_pwms(spark: SparkSession, path: str) -> list[Pwm]:
    """All matrices as written: no pseudo counts, rows not normalised."""
    return [Pwm(i, k, m) for i, (k, _, m) in enumerate(x for x in _matrices(_lines(spark, path), lambda x: x[1:].strip()) if x[2])]


def read_header(spark: SparkSession, path: str) -> str:
    """The first line of a table's first file."""
    first = spark.read.text(path).select(F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("at"), "value").alias("x")).agg(F.min("x").alias("x")).first()
    return first["x"]["value"].rstrip("\r") if first["x"] else ""


def read_pwm(spark: SparkSession, path: str, name: str) -> list[list[float]] | None:
    """One matrix as written, by its label in any case."""
    return next((m for k, _, m in _matrices(_lines(spark, path), lambda x: x[1:].strip()) if k.lower() == name.lower()), None)


def pwm_table(spark: SparkSession, pwms: list[Pwm]) -> DataFrame:
    """(pwm_idx, pwm_id, w, mat) of a library."""
    return spark.createDataFrame([(p.pwm_idx, p.pwm_id, len(p.mat), p.mat) for p in pwms], "pwm_idx int, pwm_id string, w int, mat array<array<double>>")


def read_site_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_idx, pwm_id, sites): `>id`, one sequence per line, until a blank line."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("group_idx"), F.split(F.regexp_replace("value", "^>", ""), "\r?\n").alias("l"))
    sites = F.filter(F.slice("l", F.lit(2), F.size("l")), lambda x: F.trim(x) != "")
    return rows.select("group_idx", F.trim(F.col("l")[0]).alias("pwm_id"), F.transform(sites, lambda x: F.trim(x)).alias("sites"))


def count_matrices(groups: DataFrame) -> DataFrame:
    """(pwm_id, pos, a, c, g, t) base counts of each place of groups; unknown characters and places past the first site's width count nowhere."""
    rows = groups.select("pwm_id", F.length(F.col("sites")[0]).alias("w"), F.explode("sites").alias("site"))
    places = rows.select("pwm_id", "w", F.posexplode(F.split(F.upper("site"), "")).alias("pos", "base")).where("pos < w AND base <> ''")
    return places.groupBy("pwm_id", "pos").agg(*[F.count(F.when(F.col("base") == b, 1)).alias(b.lower()) for b in "ACGT"])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, value) of a table's lines that aren't blank, numbered in order of files (by path) and places.

    Lines are numbered within the splits of the files, by as many tasks, and shifted by the sizes of the splits before, which
    are all that reaches the driver.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where("value <> ''")
    sizes = lines.groupBy("file", "split").agg(F.count("*").alias("n")).orderBy("file", "split").collect()
    before = [0]
    for r in sizes:
        before.append(before[-1] + r.n)
    starts = spark.createDataFrame([(r.file, r.split, b) for r, b in zip(sizes, before, strict=False)], "file string, split bigint, before bigint")
    within = F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    return lines.withColumn("within", within).join(starts, ["file", "split"]).select((F.col("before") + F.col("within")).cast("int").alias("row_idx"), "value")


def read_double_column(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """(row_idx, label, value) of lines `label value`; bound to matrices by row_idx."""
    rows = _numbered(spark, path).select("row_idx", F.split("value", r"\s+").alias("p"))
    out = rows.select("row_idx", F.col("p")[0].alias("label"), F.expr("try_cast(try_element_at(p, 2) AS DOUBLE)").alias("value"))
    return out if allowed is None else out.where(F.col("label").isin(allowed))


def read_double_matrix(spark: SparkSession, path: str, header: bool = True, included: list[str] | None = None) -> DataFrame:
    """(row_idx, label, values, flag): flag marks rows with a text that is no number."""
    rows = _numbered(spark, path)
    if header:
        rows = rows.where("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1)
    rows = rows.select("row_idx", F.split("value", r"\s+").alias("p"))
    values = F.expr("transform(slice(p, 2, size(p)), x -> try_cast(x AS DOUBLE))")
    out = rows.select("row_idx", F.col("p")[0].alias("label"), values.alias("values")).withColumn("flag", F.exists("values", lambda x: x.isNull()))
    return out if included is None else out.where(F.col("label").isin(included))


def read_roe(spark: SparkSession, path: str, strand: str) -> DataFrame:
    """(row_idx, pwm_id, strand, max_peak_loc, half_width, left, right); rows of NA are null."""
    v = lambda i: F.when(~F.col("flag"), F.col("values")[i])
    return read_double_matrix(spark, path).select("row_idx", F.col("label").alias("pwm_id"), F.lit(strand).alias("strand"), v(0).alias("max_peak_loc"), v(1).alias("half_width"), v(2).alias("left"), v(3).alias("right"))


def read_label_lists(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(row_idx, label, items) of lines `label<tab>` and items, with at most one delimiter before and after them."""
    one = "^" + _quoted(delimiter) + "|" + _quoted(delimiter) + "$"
    rows = _numbered(spark, path).select("row_idx", F.split("value", "\t", 2).alias("p"))
    return rows.select("row_idx", F.col("p")[0].alias("label"), F.split(F.regexp_replace(F.col("p")[1], one, ""), _quoted(delimiter)).alias("items"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_islands(spark: SparkSession, path: str) -> DataFrame:
    """(name, islands) of lines `name x,y x,y ...` after a header; of a name that comes twice the last line holds."""
    rows = _numbered(spark, path).where("row_idx > 0").select("row_idx", F.split("value", r"\s+").alias("p"))
    pair = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: F.struct(F.split(x, ",")[0].cast("int").alias("x"), F.split(x, ",")[1].cast("int").alias("y")))
    return rows.select("row_idx", F.col("p")[0].alias("name"), pair.alias("islands")).groupBy("name").agg(F.max_by("islands", "row_idx").alias("islands"))


def _bodies(lines: DataFrame) -> DataFrame:
    """lines (value, file, at) without the first of each file."""
    heads = lines.groupBy("file").agg(F.min("at").alias("head"))
    return lines.join(heads, "file").where("at > head").drop("head")


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """(label, pos) of a wide table's first fields `label_position`, cut at the last underscore; each file's header is skipped."""
    rows = _bodies(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")))
    rows = rows.select(F.split("value", r"\s+")[0].alias("f")).where(F.col("f").contains("_"))
    return rows.select(F.regexp_extract("f", "^(.*)_[^_]*$", 1).alias("label"), F.regexp_extract("f", "_([^_]*)$", 1).cast("int").alias("pos"))


def read_vector(spark: SparkSession, path: str) -> list[float]:
    return [float(x) for x in _lines(spark, path) if x.strip()]


def read_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    return [[float(x) for x in line.split()] for line in _lines(spark, path) if line.strip()]


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    return lines.select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c"), "file", "at")


def _at(i: int) -> Column:
    return F.try_element_at("c", F.lit(i + 1))


def read_open_tiles(spark: SparkSession, leaf: str, root: str) -> DataFrame:
    """(seq_id, tissue, chrom, start, end) of two interval tables without header: columns 0, 2, 5 and 6."""
    one = lambda path, tissue: _fields(spark, path).select(_at(0).alias("seq_id"), F.lit(tissue).alias("tissue"), _at(2).alias("chrom"), _at(5).try_cast("int").alias("start"), _at(6).try_cast("int").alias("end"))
    return one(leaf, "LEAF").unionByName(one(root, "ROOT")).where("start IS NOT NULL AND end IS NOT NULL")


def read_open_windows(spark: SparkSession, leaf: str, root: str) -> DataFrame:
    """(seq_id, feature_id, tissue, chrom, start, end) of folders of files `<seq>_0.overlap`; sequences without a file are closed."""
    def one(path: str, tissue: str) -> DataFrame:
        rows = _fields(spark, f"{path}/*.overlap")
        return rows.select(F.regexp_replace("file", r"_0\.overlap$", "").alias("seq_id"), F.try_element_at(F.split(_at(0), "%"), F.lit(2)).alias("feature_id"), F.lit(tissue).alias("tissue"), _at(2).alias("chrom"), _at(5).try_cast("int").alias("start"), _at(6).try_cast("int").alias("end"))

    return one(leaf, "LEAF").unionByName(one(root, "ROOT")).where("start IS NOT NULL AND end IS NOT NULL")


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    """(pwm_id, kind, bin_idx, lb, ub, height) of files `<pwm>.hbin`: BG, a blank line, FG; lines `x,lb,ub<tab>height`."""
    files = spark.read.text(f"{path}/*.hbin", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.hbin$", "").alias("pwm_id"), F.split(F.regexp_replace("value", r"\r|^\s+|\s+$", ""), r"\n\s*\n").alias("blocks"))
    blocks = files.select("pwm_id", F.posexplode("blocks").alias("k", "block")).where("k < 2")
    lines = blocks.select("pwm_id", F.when(F.col("k") == 0, "BG").otherwise("FG").alias("kind"), F.posexplode(F.split("block", "\n")).alias("bin_idx", "line"))
    p = F.split("line", "\t")
    bounds = F.split(p[0], ",")
    return lines.select("pwm_id", "kind", "bin_idx", F.try_element_at(bounds, F.lit(2)).try_cast("double").alias("lb"), F.try_element_at(bounds, F.lit(3)).try_cast("double").alias("ub"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("height"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, line, pwm_id, strand, motif, flank) of tables with a header each: columns 16, 17, 26 and 27."""
    rows = _bodies(_fields(spark, path))
    return rows.select(F.col("at").alias("site_id"), F.array_join("c", "\t").alias("line"), _at(16).alias("pwm_id"), _at(17).alias("strand"), _at(26).alias("motif"), _at(27).alias("flank")).where("flank IS NOT NULL")


def read_curves(spark: SparkSession, locs: str, scores: str, strand: str) -> DataFrame:
    """(strand, pwm_id, loc, cumscore) of a pair of curve files, line by line `pwm<tab>v<tab>v...`."""
    one = lambda path: spark.read.text(path).select(F.split("value", "\t").alias("p")).select(F.col("p")[0].alias("pwm_id"), F.slice("p", F.lit(2), F.size("p")).alias("v"))
    both = one(locs).withColumnRenamed("v", "l").join(one(scores), "pwm_id")
    rows = both.select("pwm_id", F.explode(F.arrays_zip("l", "v")).alias("x"))
    return rows.select(F.lit(strand).alias("strand"), "pwm_id", F.col("x.l").cast("long").alias("loc"), F.col("x.v").cast("double").alias("cumscore"))
