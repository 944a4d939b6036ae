"""Readers of genotype files into bundles of calls, loci and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import AlignmentError, AlleleEncodingError, PopulationMapError
from ..functions import iupac
from ..genotypes import GenotypeFrame
from ..shared import write_shared

__all__ = ["attach_populations", "load_frame", "natural_key", "numbered_lines", "read_genepop", "read_phylip", "read_popmap", "read_qmatrix", "read_site_rates", "read_structure", "read_vcf", "subset_populations", "vcf_format_fields", "vcf_header"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file in its order: numbers within ranges of a file plus the lines before each range."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    sizes = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("f", "b", "first", "base")
    return lines.join(F.broadcast(sizes), ["f", "b"]).select((F.col("base") + F.col("m") - F.col("first")).alias("line_no"), "value")


def natural_key(text: Column) -> Column:
    """Sort key in which numbers compare as numbers: chr2 before chr10."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(F.lower(x)))


def _empty_alt() -> Column:
    return F.array().cast("array<string>")


def _rest(fields: Column, first: int) -> Column:
    """Elements of an array from the ``first``-th on (from 1)."""
    return F.slice(fields, F.lit(first), F.greatest(F.size(fields) - (first - 1), F.lit(0)))


def _cells_of(rows: DataFrame) -> DataFrame:
    """``rows`` exploded from arrays, which Spark takes for no larger than the rows with the arrays: their join merges, so that
    they are not the side that is broadcast."""
    return rows.hint("merge")


def _ranked(lines: DataFrame) -> tuple[DataFrame, Column]:
    """``lines(line_no, ..)`` with what numbers them from 0: their own numbers where none is left out, else slots."""
    from ..operators.resampling import dense_index

    facts = lines.agg(F.count("*").alias("n"), F.min("line_no").alias("low"), F.max("line_no").alias("high")).first()
    if not facts["n"] or facts["high"] - facts["low"] + 1 == facts["n"]:
        return lines, F.col("line_no") - F.lit(facts["low"] or 0)
    return dense_index(lines, "line_no"), F.col("slot")


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """The ``##`` lines of a VCF file, or of the first file of a folder: definitions that ``write_vcf`` takes."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at")).filter(F.col("value").startswith("##"))
    first = lines.agg(F.min("f")).first()[0]
    return [r["value"] for r in lines.filter(F.col("f") == first).orderBy("at").collect()]  # a file's header


def _sample_names(lines: DataFrame) -> tuple[list[str], DataFrame | None]:
    """Sample names in the order of the first file, and where files differ in theirs, each file's own (file, names)."""
    heads = lines.filter(F.col("value").startswith("#CHROM")).select("file", _rest(F.split("value", "\t"), 10).alias("names"))
    found = heads.groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect()  # a row an order of names
    if not found:
        raise AlignmentError("no #CHROM line")
    names = list(found[0]["names"])
    if len(set(names)) != len(names):
        raise AlignmentError("sample names repeat")
    if any(sorted(r["names"]) != sorted(names) for r in found):
        raise AlignmentError("files hold different samples")
    return names, heads if len(found) > 1 else None


def read_vcf(spark: SparkSession, path: str, popmap: DataFrame | None = None, force: bool = False, allele_depth: bool = True, keep_format: bool = False) -> GenotypeFrame:
    """A VCF file or folder. Loci keep the fixed fields and INFO as a map and are numbered in natural order of chromosome
    and position; a call is the code of its two bases, null if an allele is missing, half missing or no single base.

    The files of a folder hold the same samples, in any order of their columns. ``keep_format`` keeps the other FORMAT
    values of each cell, as text in the order of the locus' ``format``, for ``write_vcf``.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    names, by_file = _sample_names(lines)
    records = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"), "file")
    fields = _rest(F.col("f"), 10)
    if by_file is not None:
        # A file's columns in the order of the first one's names.
        place = F.transform(F.array(*map(F.lit, names)), lambda name: F.array_position("names", name).cast("int") - 1)
        records = records.join(F.broadcast(by_file), "file")  # a row a file
        fields = F.transform(place, lambda k: F.get(_rest(F.col("f"), 10), k))
    f = lambda k: F.get("f", k)
    keys = F.array_distinct(F.transform(F.split(f(7), ";"), lambda x: F.split_part(x, F.lit("="), F.lit(1))))
    value = lambda k: F.coalesce(F.nullif(_info_value(f(7), k), F.lit("")), F.lit("."))
    info = F.when(f(7).isin(".", ""), F.create_map().cast("map<string,string>")).otherwise(F.map_from_arrays(keys, F.transform(keys, value)))
    loci = records.select(
        f(0).alias("chrom"), f(1).cast("long").alias("pos"), f(2).alias("id"), F.upper(f(3)).alias("ref"),
        F.filter(F.split(F.upper(f(4)), ","), lambda a: a != ".").alias("alt"), F.coalesce(f(5), F.lit(".")).alias("qual"), f(6).alias("filter"), info.alias("info"), f(8).alias("format"), fields.alias("fields"),
    )
    from ..operators.resampling import dense_index

    loci = dense_index(loci.withColumn("__key", natural_key(F.col("chrom"))), "__key", "pos", "ref").drop("__key").withColumnRenamed("slot", "locus_idx")
    loci = loci.withColumn("marker_name", F.concat_ws(":", "chrom", "pos"))
    cells = loci.select("locus_idx", "ref", "alt", "format", F.posexplode("fields").alias("sample_idx", "field"))
    token = F.get(F.split("field", ":"), F.array_position(F.split("format", ":"), F.lit("GT")).cast("int") - 1)
    more = [_depth().alias("depth")] if allele_depth else []
    if keep_format:
        kinds, values = F.split("format", ":"), F.split("field", ":")
        others = F.filter(F.sequence(F.lit(0), F.size(kinds) - 1), lambda k: F.get(kinds, k) != "GT")
        more.append(F.array_join(F.transform(others, lambda k: F.coalesce(F.get(values, k), F.lit("."))), ":").alias("extra"))
    calls = cells.select("locus_idx", F.col("sample_idx").cast("long").alias("sample_idx"), _vcf_call(token).alias("gt"), *more)
    samples = spark.createDataFrame([(k, n, None) for k, n in enumerate(names)], "sample_idx long, sample_id string, population string")
    return attach_populations(GenotypeFrame(_cells_of(calls), loci.drop("fields"), samples), popmap, force)


def _info_value(text: Column, key: Column) -> Column:
    """Value of ``key=``; empty for a flag."""
    own = F.filter(F.split(text, ";"), lambda x: F.split_part(x, F.lit("="), F.lit(1)) == key)
    return F.substring(F.get(own, 0), F.length(key) + 2, F.length(text))


def _vcf_call(token: Column) -> Column:
    alleles = F.concat(F.array("ref"), F.col("alt"))
    parts = F.split(token, "[/|]")
    pick = lambda p: F.when(p.rlike("^[0-9]+$"), F.get(alleles, p.try_cast("int")))
    first, second = pick(F.get(parts, 0)), pick(F.coalesce(F.get(parts, 1), F.get(parts, 0)))
    return iupac.from_pair(first, second)


def _depth() -> Column:
    ad = F.get(F.split("field", ":"), F.array_position(F.split("format", ":"), F.lit("AD")).cast("int") - 1)
    return F.aggregate(F.transform(F.split(ad, ","), lambda x: F.coalesce(x.try_cast("long"), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)


def vcf_format_fields(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, sample_idx, fields): FORMAT values of each cell but the genotype, as a map of strings."""
    records = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    cells = records.select(F.get("f", 0).alias("chrom"), F.get("f", 1).cast("long").alias("pos"), F.split(F.get("f", 8), ":").alias("k"), F.posexplode(_rest(F.col("f"), 10)).alias("sample_idx", "v"))
    values = F.split("v", ":")
    padded = F.concat(values, F.array_repeat(F.lit("."), F.greatest(F.size("k") - F.size(values), F.lit(0))))
    return cells.select("chrom", "pos", F.col("sample_idx").cast("long").alias("sample_idx"), F.map_filter(F.map_from_arrays("k", F.slice(padded, F.lit(1), F.size("k"))), lambda k, _: k != "GT").alias("fields"))


def _matrix(spark: SparkSession, rows: DataFrame, popmap: DataFrame | None, force: bool, marker: DataFrame | None = None) -> GenotypeFrame:
    """A bundle from (sample_idx, sample_id, population, codes array), which is written to the shared folder: calls, loci, alleles
    and samples read it there instead of the text."""
    rows = write_shared(rows, "matrix")
    repeated = rows.groupBy("sample_id").count().filter("count > 1").limit(1).count()
    if repeated:
        raise AlignmentError("sample names repeat")
    calls = rows.select("sample_idx", F.posexplode("codes").alias("locus_idx", "raw")).select(F.col("locus_idx").cast("long").alias("locus_idx"), "sample_idx", iupac.normalise(F.col("raw")).alias("gt"))
    loci = calls.select("locus_idx").distinct()
    if marker is not None:
        loci = loci.join(marker, "locus_idx", "left")
    else:
        loci = loci.withColumn("marker_name", F.lit(None).cast("string"))
    loci = loci.withColumn("marker_name", F.coalesce("marker_name", F.concat(F.lit("locus_"), F.col("locus_idx") + 1)))
    frame = GenotypeFrame(_cells_of(calls), loci.withColumn("chrom", F.lit("1")).withColumn("pos", F.col("locus_idx") + 1).withColumn("ref", F.lit(None).cast("string")).withColumn("alt", _empty_alt()), rows.select("sample_idx", "sample_id", "population"))
    return attach_populations(_with_alleles(frame), popmap, force)


def _with_alleles(frame: GenotypeFrame) -> GenotypeFrame:
    """ref and alt of loci from the calls."""
    from ..operators.encodings import reference_alleles

    found = reference_alleles(frame)
    loci = frame.loci.drop("ref", "alt").join(found, "locus_idx", "left").withColumn("alt", F.coalesce("alt", _empty_alt()))
    return GenotypeFrame(frame.calls, loci, frame.samples)


def read_phylip(spark: SparkSession, path: str, popmap: DataFrame | None = None, force: bool = False) -> GenotypeFrame:
    """A header of two counts, then a name and a sequence a line; both counts must hold."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    head = lines.orderBy("line_no").first()
    parts = head["value"].split() if head else []
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise AlignmentError("the header must be two counts")
    n_samples, n_loci = map(int, parts)
    tokens = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("line_no") > head["line_no"]).select("line_no", tokens.alias("t"))
    bad = rows.filter((F.size("t") != 2) | (F.length(F.get("t", 1)) != n_loci)).limit(1).count()
    if bad or rows.count() != n_samples:
        raise AlignmentError("sequences do not fit the header")
    rows, rank = _ranked(rows)
    return _matrix(spark, rows.select(rank.cast("long").alias("sample_idx"), F.get("t", 0).alias("sample_id"), F.lit(None).cast("string").alias("population"), F.split(F.get("t", 1), "").alias("codes")), popmap, force)


def read_structure(spark: SparkSession, path: str, has_popids: bool = False, has_marker_names: bool = False, alleles: dict | None = None, popmap: DataFrame | None = None, force: bool = False) -> GenotypeFrame:
    """One row or two rows a sample, told apart by the first names of the first two rows; ``alleles`` maps numbers to bases."""
    table = {str(k): v.upper() for k, v in (alleles or {1: "A", 2: "C", 3: "G", 4: "T", -9: "N"}).items()}
    if wrong := [v for v in table.values() if v not in "ACGTN"]:
        raise AlleleEncodingError(f"alleles must be bases or N: {wrong}")
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    first = lines.orderBy("line_no").limit(3).collect()
    start = first[1 if has_marker_names else 0]["line_no"]
    names = [r["value"].split()[0] for r in first[1 if has_marker_names else 0 :][:2]]
    two = len(names) > 1 and names[0] == names[1]
    skip = 2 if has_popids else 1
    rows, rank = _ranked(lines.filter(F.col("line_no") >= start))
    rows = rows.select(rank.alias("r"), F.split(F.trim("value"), r"\s+").alias("t"))
    rows = rows.select("r", F.get("t", 0).alias("sample_id"), (F.get("t", 1) if has_popids else F.lit(None).cast("string")).alias("population"), F.slice("t", F.lit(skip + 1), F.size("t")).alias("a"))
    strange = F.get(F.filter("a", lambda x: ~x.isin(*table)), 0)
    facts = rows.agg(F.min(strange).alias("unknown"), F.count_if(F.size("a") % 2 == 1).alias("odd")).first()
    if facts["unknown"] is not None:
        raise AlleleEncodingError(f"unknown allele: {facts['unknown']}")
    if two:
        pairs = rows.groupBy(F.floor(F.col("r") / 2).alias("sample_idx")).agg(F.min_by("sample_id", "r").alias("sample_id"), F.min_by("population", "r").alias("population"), F.min_by("a", "r").alias("a1"), F.max_by("a", "r").alias("a2"))
    else:
        if facts["odd"]:
            raise AlleleEncodingError("an odd number of alleles")
        # The array stands outside the functions of its elements: inside, Spark would split the line anew for each of them.
        every = lambda k: F.filter("a", lambda _, i: i % 2 == k)
        pairs = rows.select(F.col("r").alias("sample_idx"), "sample_id", "population", every(0).alias("a1"), every(1).alias("a2"))
    places = {k: iupac.BASES.index(v) for k, v in table.items() if v in tuple(iupac.BASES)}
    known = {f"{x} {y}": iupac.CODES[(1 << i | 1 << j) - 1] for x, i in places.items() for y, j in places.items()} or {"": "N"}
    codes = F.zip_with("a1", "a2", lambda x, y: F.coalesce(iupac.map_lookup(F.concat_ws(" ", x, y), known), F.lit("N")))
    marker = None
    if has_marker_names:
        marker = spark.createDataFrame([(k, n) for k, n in enumerate(first[0]["value"].split())], "locus_idx long, marker_name string")
    return _matrix(spark, pairs.select(F.col("sample_idx").cast("long").alias("sample_idx"), "sample_id", "population", codes.alias("codes")), popmap, force, marker)


def read_genepop(spark: SparkSession, path: str, alleles: dict | None = None, popmap: DataFrame | None = None, force: bool = False) -> GenotypeFrame:
    """Title, markers, then a section of individuals after each ``POP`` line; allele codes of two or three digits each,
    haploid ones doubled; ``alleles`` maps their numbers to bases. A population is named after its section."""
    table = {str(k): v for k, v in (alleles or {1: "A", 2: "C", 3: "G", 4: "T"}).items()}
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    is_pop = F.upper(F.trim("value")) == "POP"
    pops = [r["line_no"] for r in lines.filter(is_pop).select("line_no").orderBy("line_no").collect()]  # a row a population
    if not pops:
        raise AlignmentError("no POP line")
    first = pops[0]
    head = [r["value"] for r in lines.filter(F.col("line_no") < first).orderBy("line_no").collect()][1:]
    names = [x.strip() for line in head for x in line.split(",") if x.strip()]
    section = F.size(F.filter(F.array(*map(F.lit, pops)), lambda p: p <= F.col("line_no")))
    rows, rank = _ranked(lines.filter(F.col("line_no") >= first))
    # The lines of sections before a sample are not samples.
    rows = rows.withColumn("section", section).withColumn("order", rank - F.col("section")).filter(~is_pop)
    split = rows.select(F.col("order").cast("long").alias("sample_idx"), F.concat(F.lit("Pop"), "section").alias("population"), F.trim(F.substring_index("value", ",", 1)).alias("sample_id"), F.split(F.trim(F.substring("value", F.instr("value", ",") + 1, F.length("value"))), r"\s+").alias("t"))
    if split.filter(F.size("t") != len(names)).limit(1).count():
        raise AlignmentError("individuals do not have one genotype a marker")

    def code(x: Column) -> Column:
        size = F.length(x)
        half = F.when(size >= 4, (size / 2).cast("int")).otherwise(size)
        number = lambda y: F.regexp_replace(y, "^0+", "")
        a1, a2 = number(F.substring(x, F.lit(1), half)), number(F.when(size >= 4, F.substring(x, half + 1, half)).otherwise(x))
        return F.coalesce(iupac.from_pair(iupac.map_lookup(a1, table), iupac.map_lookup(a2, table)), F.lit("N"))

    marker = spark.createDataFrame(list(enumerate(names)), "locus_idx long, marker_name string")
    return _matrix(spark, split.select("sample_idx", "sample_id", "population", F.transform("t", code).alias("codes")), popmap, force, marker)


# Names that the columns of a population map have where there is a header.
_SAMPLE_NAMES, _POPULATION_NAMES = ("sampleid", "sampleids"), ("populationid", "populationids", "popid", "popids")


def read_popmap(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, population) of a file with two columns; a sample's last line wins. Commas part them if the first line has one, else white space.

    A first line that names one column of samples and one of populations is a header, in any order and with others.
    """
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    head = lines.orderBy("line_no").first()
    if head is None:
        raise PopulationMapError("the population map is empty")
    tokens = F.filter(F.split(F.trim("value"), r"\s*,\s*" if "," in head["value"] else r"\s+"), lambda x: x != "")
    rows = lines.select("line_no", tokens.alias("t"))
    first = rows.orderBy("line_no").first()
    names = [x.lower() for x in first["t"]]
    samples, populations = ([k for k, x in enumerate(names) if x in known] for known in (_SAMPLE_NAMES, _POPULATION_NAMES))
    columns = 2
    if len(samples) == len(populations) == 1:
        columns = len(names)
        rows = rows.filter(F.col("line_no") > first["line_no"])
    else:
        samples, populations = [0], [1]
    if rows.filter(F.size("t") != columns).limit(1).count():
        raise PopulationMapError(f"a line of the population map does not have {columns} columns")
    return rows.groupBy(F.get("t", samples[0]).alias("sample_id")).agg(F.max_by(F.get("t", populations[0]), "line_no").alias("population"))


def attach_populations(frame: GenotypeFrame, popmap: DataFrame | None, force: bool = False) -> GenotypeFrame:
    """Populations of a map; samples without an entry raise unless ``force``, which leaves them out. Without a map and
    populations of the file's own, all are ``NA``."""
    if popmap is None:
        return GenotypeFrame(frame.calls, frame.loci, frame.samples.withColumn("population", F.coalesce("population", F.lit("NA"))))
    if not force:
        lacking = frame.samples.join(popmap, "sample_id", "left_anti").limit(5).collect()
        if lacking:
            raise PopulationMapError(f"samples without a population: {[r['sample_id'] for r in lacking]}")
    samples = frame.samples.drop("population").join(popmap, "sample_id").select("sample_idx", "sample_id", "population")
    if samples.isEmpty():
        raise PopulationMapError("no sample is in the population map")
    return GenotypeFrame(_cells_of(frame.calls.join(samples.select("sample_idx"), "sample_idx", "left_semi")), frame.loci, samples)


def load_frame(spark: SparkSession, path: str) -> GenotypeFrame:
    """A bundle of ``save_frame``."""
    return GenotypeFrame(*(spark.read.parquet(f"{path}/{name}") for name in ("calls", "loci", "samples")))


def subset_populations(frame: GenotypeFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> GenotypeFrame:
    """Include first, then exclude; a population in both, or nothing left, raises."""
    if set(include or []) & set(exclude or []):
        raise PopulationMapError("a population is both included and excluded")
    samples = frame.samples
    if include:
        samples = samples.filter(F.col("population").isin(include))
    if exclude:
        samples = samples.filter(~F.col("population").isin(exclude))
    if samples.isEmpty():
        raise PopulationMapError("no population is left")
    return GenotypeFrame(frame.calls.join(samples.select("sample_idx"), "sample_idx", "left_semi"), frame.loci, samples)


def read_qmatrix(spark: SparkSession, path: str) -> DataFrame:
    """(base, A, C, G, T): a plain 4 x 4 table with ``ACGT`` axes, or the rate matrix of a model report."""
    lines = [r["value"] for r in numbered_lines(spark, path).orderBy("line_no").collect()]  # some lines
    marks = [k for k, line in enumerate(lines) if "rate matrix q" in line.lower()]
    rows = []
    for line in lines[marks[0] + 1 :] if marks else lines:
        parts = line.replace(",", " ").split()
        if len(parts) == 5 and parts[0].upper() in "ACGT":
            rows.append((parts[0].upper(), *map(float, parts[1:])))
        if len(rows) == 4:
            break
    if [r[0] for r in rows] != list("ACGT"):
        raise AlignmentError("a rate matrix has rows A, C, G and T in order")
    return spark.createDataFrame(rows, "base string, A double, C double, G double, T double")


def read_site_rates(spark: SparkSession, path: str, n_loci: int | None = None) -> DataFrame:
    """(locus_idx, rate): one number a line, or the column ``Rate`` of a table with ``#`` comments."""
    lines = numbered_lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    head = lines.orderBy("line_no").first()
    names = head["value"].split("\t") if head else []
    column = names.index("Rate") if "Rate" in names else 0
    if "Rate" in names:
        lines = lines.filter(F.col("line_no") > head["line_no"])
    lines, rank = _ranked(lines)
    rates = lines.select(rank.cast("long").alias("locus_idx"), F.get(F.split("value", "\t"), column).cast("double").alias("rate"))
    if n_loci is not None and rates.count() != n_loci:
        raise AlignmentError("there must be one rate a locus")
    return rates
