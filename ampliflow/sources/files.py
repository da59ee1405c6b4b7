"""Readers and writers of reads, sequences and tables in text form, over any path that Spark opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import dequoted, read_abundance, read_prefix, sample_name
from ..operators.denoise import kept

FASTQ_SUFFIXES = (".fastq", ".fastq.gz", ".fq", ".fq.gz")
#: How the two files of a pair are told apart.
PAIR_SUFFIXES = (("_R1_001", "_R2_001"), ("_R1", "_R2"), ("_1", "_2"))
STAT_FIELDS = ("Raw FASTQ", "Flash", "Cutadapt", "Threshold pool", "Threshold", "Control", "Max non-spike", "Max spike-in", "Singletons")


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...], ignore_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Paths of files below ``path`` with one of the suffixes whose names do not begin with an ignored prefix."""
    pattern = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path").distinct()
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    for p in ignore_prefixes:
        files = files.where(~name.startswith(p))
    return files


def paired_files(files: DataFrame) -> DataFrame:
    """sample, pool, forward, reverse of FASTQ files; index reads (I1, I2) are skipped, an unpaired file fails the query."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.(fastq|fq)(\.gz)?$", "")
    rows = files.select("path", F.regexp_replace("path", r"/[^/]+$", "").alias("pool"), name.alias("name")).where(~F.col("name").rlike(r"_I[12](_001)?$"))
    stem, mate = F.regexp_replace("name", r"_R?[12](_001)?$", ""), F.regexp_extract("name", r"_R?([12])(?:_001)?$", 1)
    per = rows.select("path", "pool", stem.alias("sample"), mate.alias("mate")).groupBy("pool", "sample").agg(F.max(F.when(F.col("mate") == "1", F.col("path"))).alias("forward"), F.max(F.when(F.col("mate") == "2", F.col("path"))).alias("reverse"), F.count(F.lit(1)).alias("n"))
    good = (F.col("n") == 2) & F.col("forward").isNotNull() & F.col("reverse").isNotNull()
    return per.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not a pair of FASTQ files: "), F.col("sample"))).cast("boolean"))).drop("n")


def read_fastq(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, ordinal, read_id, seq, qual of all reads; files are streamed line by line, one task per file."""
    def records(batches):
        import gzip
        import io

        import pandas as pd

        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                stream = io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)) if name.endswith(".gz") else io.BytesIO(content))
                rows, at = [], 0
                for title in stream:
                    if not title.strip():
                        continue
                    seq, plus, qual = next(stream, ""), next(stream, ""), next(stream, "")
                    if not title.startswith("@") or not plus.startswith("+") or len(seq.strip()) != len(qual.strip()):
                        raise ValueError(f"not a FASTQ record: {title!r} in {name}")
                    rows.append((name, at, title[1:].rstrip(), seq.strip().upper(), qual.strip()))
                    at += 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "ordinal", "read_id", "seq", "qual"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "ordinal", "read_id", "seq", "qual"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*{" + ",".join(FASTQ_SUFFIXES) + "}").load(path)
    return files.select("path", "content").mapInPandas(records, "path string, ordinal long, read_id string, seq string, qual string")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """sample, pool, f_seq, f_qual, r_seq, r_qual by order in the two files."""
    files = paired_files(discover(spark, path, FASTQ_SUFFIXES))
    reads = read_fastq(spark, path)
    side = lambda c, p: files.select("sample", "pool", F.col(c).alias("path")).join(reads, "path").select("sample", "pool", "ordinal", F.col("seq").alias(p + "_seq"), F.col("qual").alias(p + "_qual"))
    return side("forward", "f").join(side("reverse", "r"), ["sample", "pool", "ordinal"]).drop("ordinal")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, title, seq; lines before the first title are left out, sequence lines are joined."""
    # records end where a line begins with '>', so titles may hold that letter; the first record of a file keeps its own
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("path"), "value")
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = raw.select("path", F.regexp_extract(body, r"^([^\n]*)", 1).alias("title"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*", ""), r"\s", "").alias("seq"))
    return rows.where((F.col("seq") != "") & ~F.col("title").startswith("#"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, fields: the '#key:value' lines before a file's first title, as a map."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").where(F.col("value").rlike("^#[^:]+:"))
    entry = F.struct(F.regexp_extract("value", r"^#([^:]+):", 1).alias("k"), F.regexp_replace("value", r"^#[^:]+:", "").alias("v"))
    return lines.groupBy("path").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))


def read_nr_fasta(spark: SparkSession, path: str) -> DataFrame:
    """sample, md5, seq, abundance of 'MD5_abundance' titles; tags before the number may be anything."""
    rows = read_fasta(spark, path)
    name = F.regexp_extract("title", r"^(\S+)", 1)
    return rows.select(sample_name(F.col("path")).alias("sample"), read_prefix(name).alias("tag"), F.md5(F.upper("seq")).alias("md5"), F.upper("seq").alias("seq"), read_abundance(name).alias("abundance"))


def fasta_stats(nr: DataFrame) -> DataFrame:
    """Unique sequences, reads and the largest count per sample."""
    return nr.groupBy("sample").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("abundance").alias("total"), F.max("abundance").alias("max_abundance"))


def nr_fasta_lines(nr: DataFrame, headers: dict[str, object] | None = None, minimum: int = 0) -> DataFrame:
    """part, value: the lines of an NR FASTA file in order: headers, then records from the most abundant."""
    spark = nr.sparkSession
    head = spark.createDataFrame([(i, f"#{k}:{v}") for i, (k, v) in enumerate((headers or {}).items())] or [(0, None)], "ordinal int, value string").where("value is not null")
    rows = nr.where(F.col("abundance") >= minimum).select((-F.col("abundance")).alias("o"), "seq", F.concat(F.lit(">"), F.md5(F.upper("seq")), F.lit("_"), F.col("abundance"), F.lit("\n"), F.col("seq")).alias("value"))
    return head.select(F.lit(0).alias("part"), F.col("ordinal").cast("long").alias("o"), F.lit("").alias("seq"), "value").unionByName(rows.select(F.lit(1).alias("part"), "o", "seq", "value")).orderBy("part", "o", "seq").select("part", "value")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file in the rows' order, for reports of bounded size."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)


def read_tally(spark: SparkSession, path: str, min_abundance: int = 0) -> tuple[DataFrame, DataFrame]:
    """(tally, stats) of a wide tally table: (marker, md5, seq, sample, abundance, fields) and (sample, field, value).

    Only the two header lines that name columns are looked at on the driver. ``fields`` maps further columns, such as
    classifications, to their text.
    """
    lines = spark.read.text(path)
    found = lines.where(F.col("value").rlike(r"^#(Marker/)?MD5_abundance\t")).first()
    if found is None:
        raise ValueError(f"no line of column names (#Marker/MD5_abundance) in {path}")
    header = found[0].split("\t")
    at = header.index("Sequence")
    samples, further = header[1:at], header[at + 1 :]
    f = F.split("value", "\t")
    names = F.array(*[F.lit(s) for s in samples])
    body = lines.where(~F.col("value").startswith("#")).select(f.alias("f"))
    idn = F.get("f", F.lit(0))
    marker = F.when(idn.contains("/"), F.substring_index(idn, "/", 1)).otherwise("")
    md5 = F.substring_index(F.regexp_replace(idn, "^[^/]*/", ""), "_", 1)
    cells = F.arrays_zip(names.alias("sample"), F.transform(F.slice("f", 2, len(samples)), lambda x: x.cast("long")).alias("abundance"))
    fields = F.map_from_arrays(F.array(*[F.lit(x) for x in further]), F.slice("f", at + 2, len(further))) if further else F.create_map().cast("map<string,string>")
    rows = body.select(marker.alias("marker"), md5.alias("md5"), F.upper(F.get("f", F.lit(at))).alias("seq"), F.explode(cells).alias("c"), fields.alias("fields"))
    tally = rows.select("marker", "md5", "seq", "c.*", "fields").where(F.col("abundance") >= max(1, min_abundance))
    stats = lines.where(F.col("value").startswith("#") & ~F.col("value").rlike(r"^#(Marker/)?MD5_abundance\t")).select(f.alias("f"))
    stats = stats.select(F.substring(F.get("f", F.lit(0)), 2, 100).alias("field"), F.explode(F.arrays_zip(names.alias("sample"), F.slice("f", 2, len(samples)).alias("value"))).alias("c")).select("c.sample", "field", "c.value")
    return tally, stats


def tally_lines(tally: DataFrame, samples: list[str], stats: DataFrame | None = None, further: list[str] = ()) -> DataFrame:
    """part, value: a wide tally table's lines in order: sample headers, column names, rows by marker, total and sequence."""
    spark = tally.sparkSession
    joined = lambda cols: F.concat_ws("\t", *cols)
    wide = tally.groupBy("marker", "md5", "seq", *further).pivot("sample", list(samples)).agg(F.sum("abundance")).na.fill(0, list(samples))
    total = sum((F.col(f"`{s}`") for s in samples), F.lit(0))
    rows = wide.select(F.lit(2).alias("part"), "marker", (-total).alias("o"), "seq", joined([F.concat("marker", F.lit("/"), F.col("md5"), F.lit("_"), total.cast("string")), *[F.col(f"`{s}`").cast("string") for s in samples], F.col("seq"), *[F.col(x) for x in further]]).alias("value"))
    head = spark.createDataFrame([(1, "", 0, "", "\t".join(["#Marker/MD5_abundance", *samples, "Sequence", *further]))], "part int, marker string, o long, seq string, value string")
    out = rows.unionByName(head)
    if stats is not None:
        order = F.array_position(F.array(*[F.lit(s) for s in STAT_FIELDS]), F.col("field"))
        per = stats.groupBy("field").pivot("sample", list(samples)).agg(F.first("value"))
        out = out.unionByName(per.select(F.lit(0).alias("part"), F.lit("").alias("marker"), order.cast("long").alias("o"), F.col("field").alias("seq"), joined([F.concat(F.lit("#"), F.col("field")), *[F.coalesce(F.col(f"`{s}`"), F.lit("-")) for s in samples], F.lit("")]).alias("value")))
    return out.orderBy("part", "marker", "o", "seq").select("part", "value")


def read_species(spark: SparkSession, path: str, species_only: bool = False, wildcard: bool = True) -> DataFrame:
    """name, taxids, names of a known or predicted table (name, taxid, genus-species, note); '*' stands for a whole sample."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.input_file_name().alias("path"), F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).alias("taxids"), F.coalesce(F.get(f, F.lit(2)), F.lit("")).alias("names"))
    if not wildcard:
        rows = rows.where(F.when(F.col("name") == "*", F.raise_error(F.lit("a wildcard is not allowed here")).cast("boolean")).otherwise(True))
    if species_only:
        rows = rows.withColumn("names", F.array_join(F.filter(F.split("names", ";"), lambda x: x.contains(" ")), ";"))
    return rows.withColumn("sample", sample_name(F.col("path"))).drop("path")


def read_metadata(spark: SparkSession, path: str, columns: list[int], index: int, sep: str = ";", name_row: int = 1, encoding: str = "UTF-8") -> DataFrame:
    """sample and the chosen columns (numbered from 1), one row per sample of the index column's list.

    Blank and '#' lines are skipped, quotes taken off, samples stripped of folders and FASTQ suffixes. A sample listed
    twice fails the query. Rows without samples have a null one.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    first = lines.where(F.trim("value") != "").limit(name_row).collect()
    titles = [x.strip('"') for x in first[name_row - 1][0].lstrip("#").split("\t")] if name_row else None
    f = F.transform(F.split("value", "\t"), dequoted)
    body = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    if name_row:
        body = body.where(~F.col("value").isin(*[r[0] for r in first]))
    rows = body.select(f.alias("f"))
    names = [titles[c - 1] if titles else f"c{c}" for c in columns]
    listed = F.filter(F.transform(F.split(F.coalesce(F.get("f", F.lit(index - 1)), F.lit("")), sep), F.trim), lambda s: s != "")
    clean = F.transform(listed, lambda s: F.regexp_replace(F.regexp_replace(s, r"^.*/", ""), r"(_R?[12](_001)?)?\.(fastq|fq)(\.gz)?$", ""))
    out = rows.select(*[F.trim(F.get("f", F.lit(c - 1))).alias(n) for c, n in zip(columns, names, strict=True)], F.explode_outer(clean).alias("sample"))
    return unique_samples(out)


def unique_samples(rows: DataFrame) -> DataFrame:
    """rows as they are; fails where a sample is listed more than once."""
    n = F.when(F.col("sample").isNotNull(), F.count("sample").over(W.partitionBy("sample")))
    return rows.withColumn("_n", n).where(F.when(F.coalesce("_n", F.lit(1)) == 1, True).otherwise(F.raise_error(F.concat(F.lit("sample listed twice: "), F.col("sample"))).cast("boolean"))).drop("_n")


def read_dmp(spark: SparkSession, path: str, columns: dict[str, int], types: dict[str, str] | None = None) -> DataFrame:
    """Chosen fields of a taxonomy dump file, whose fields end in tab-bar-tab."""
    f = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.get(f, F.lit(i)).cast((types or {}).get(name, "string")).alias(name) for name, i in columns.items()])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return read_dmp(spark, path, {"taxid": 0, "parent": 1, "rank": 2}, {"taxid": "int", "parent": "int"})


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return read_dmp(spark, path, {"taxid": 0, "name": 1, "class": 3}, {"taxid": "int"})


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return read_dmp(spark, path, {"old": 0, "new": 1}, {"old": "int", "new": "int"})


def read_zip_member(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, line_no, value: the lines of each archive's one member with a suffix."""
    def members(frames):
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [m for m in z.namelist() if m.endswith(suffix)]
                    if len(found) != 1:
                        raise ValueError(f"{name} has {len(found)} members that end in {suffix}")
                    lines = z.read(found[0]).decode().splitlines()
                yield pd.DataFrame({"path": name, "line_no": range(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, line_no long, value string")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their places from 0 in an order, without one task for all: places within range partitions plus offsets."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = kept(spark, dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row per partition
    starts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return dealt.withColumn("_part", part).join(F.broadcast(starts.drop("_n")), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start", "_at")


def sparse_matrix(tally: DataFrame) -> DataFrame:
    """row, col, value coordinates of the tally matrix, numbered by marker/sequence and by sample."""
    rows = numbered(tally.select("marker", "md5").distinct(), ["marker", "md5"], "row")
    cols = numbered(tally.select("sample").distinct(), ["sample"], "col")
    return tally.join(rows, ["marker", "md5"]).join(cols, "sample").select("row", "col", F.col("abundance").alias("value"))


def table_lines(rows: DataFrame, columns: dict[str, str], order: list) -> DataFrame:
    """line, value: a tab-separated table with '#' before its titles; ``columns`` maps titles to columns, nulls are empty."""
    spark = rows.sparkSession
    cells = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns.values()])
    body = numbered(rows, order, "_line").select((F.col("_line") + 1).alias("line"), cells.alias("value"))
    return spark.range(1).select("id", F.lit("#" + "\t".join(columns)).alias("value")).toDF("line", "value").unionByName(body)


def dump_lines(refs: DataFrame) -> DataFrame:
    """The reference table by marker, sequence and accession."""
    columns = {"Marker": "marker", "Identifier": "accession", "Genus": "genus", "Species": "species", "TaxID": "taxid", "MD5": "md5", "Sequence": "seq"}
    return table_lines(refs, columns, ["marker", "seq", "accession", "genus", "species", "taxid"])


def mapping_lines(confusion: DataFrame) -> DataFrame:
    """How many samples have each expected and predicted list (assess.confusion_tally), sorted by the two."""
    joined = confusion.select("n_samples", F.array_join("expected", ";").alias("expected"), F.array_join("predicted", ";").alias("predicted"))
    return table_lines(joined, {"sample-count": "n_samples", "Expected": "expected", "Predicted": "predicted"}, ["expected", "predicted"])


def conflict_lines(found: DataFrame) -> DataFrame:
    """Conflicts (refdb.conflicts): first those of markers, then of genera, then of species, each by sequence."""
    return table_lines(found, {"MD5": "md5", "Level": "level", "Conflicts": "conflicts"}, ["level_order", "md5"])
