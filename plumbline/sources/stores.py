"""Sources, sinks and deduplication (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
SITES = ("Green Field", "Brown Field", "Repair")
EXTRACTION = (
    "source_pdf string, page_number int, profile string, model string, image_hash string, "
    "title_block struct<drawing_no:string,revision:string,project_name:string,date:string,date_raw:string,prepared_by:string,confidence:string>, "
    "pedestals array<struct<tag:string,length_mm:double,width_mm:double,quantity:int,height_mm:double,raw_text:string,regex_validated:boolean,seen_in_regions:array<string>,source_rect:array<double>,grid_ref:string,confidence:string,notes:string>>, "
    "grade_slabs array<struct<tag:string,length_mm:double,width_mm:double,thickness_mm:double,toc_level:string,raw_text:string,confidence:string,notes:string>>, "
    "position_marks map<string,int>, used_text_layer boolean, confidence_notes array<string>, total_elapsed_s double, "
    "responses array<struct<region:string,stage:string,px_width:int,px_height:int,ink_ratio:double,skipped:boolean,elapsed_s:double,raw_response:string,error:string>>, "
    "transcribed_lines array<string>, transcript_blocks array<struct<region:string,rect_norm:array<double>,grid_ref:string,lines:array<string>>>, "
    "text_blocks_found int, montages_sent int, findings string, discovery string"  # the last two are JSON text
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_drawings(spark: SparkSession, folders: list[str]) -> DataFrame:
    """A1: (path, name, folder_no, sha, length) of each *.pdf once, the first folder winning; dot-files are skipped.

    A file counts as the same where its content is; contents are hashed where they are read and dropped.
    """
    out = None
    for i, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
        files = files.select("path", file_name(c("path")).alias("name"), F.lit(i).alias("folder_no"), F.sha2("content", 256).alias("sha"), "length")
        out = files if out is None else out.unionByName(files)
    return distinct_drawings(out)


def distinct_drawings(files: DataFrame) -> DataFrame:
    """A1: of files (path, name, folder_no, sha, ...) each content once, from the first folder; names that begin with a dot are skipped."""
    return first_by(files.where(~c("name").startswith(".")), ["sha"], ["folder_no", "path"])


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_k", k).where("_k = 1").drop("_k")


def display_labels(files: DataFrame) -> DataFrame:
    """A2: (path, label): the name, with its folder where the name occurs more than once."""
    name, folder = file_name(c("path")), F.element_at(F.split("path", "/"), -2)
    n = F.count("*").over(Window.partitionBy("name"))
    return files.select("path", name.alias("name"), folder.alias("folder")).withColumn("label", F.when(n > 1, F.concat(c("name"), F.lit(" ("), "folder", F.lit(")"))).otherwise(c("name"))).select("path", "label")


def fingerprint(content: Column, profile: Column, page: Column) -> Column:
    """A3: 32 hex digits of sha256 over profile, page mark (page 0 has none) and content."""
    mark = F.when(page != 0, F.concat(F.lit("#page="), page.cast("string"))).otherwise("")
    return F.substring(F.sha2(F.concat(profile.cast("binary"), mark.cast("binary"), content.cast("binary")), 256), 1, 32)


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4: readings from *_extraction.json below a folder, and the files that can't be read with their path."""
    files = spark.read.option("pathGlobFilter", "*_extraction.json").text(path, wholetext=True)
    parsed = F.from_json("value", f"{EXTRACTION}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = files.select(F.col("_metadata.file_path").alias("file"), parsed.alias("r")).select("file", "r.*")
    return raw.where("_corrupt_record is null").drop("_corrupt_record"), raw.where("_corrupt_record is not null").select("file", "_corrupt_record")


def reading_lines(readings: DataFrame) -> DataFrame:
    """A4: (drawing_id, block_id, line_no, text, region, grid_ref) of the transcripts in read_extractions' readings, a reading's file as its id.

    Lines come from the blocks in order; a reading without blocks gives its plain lines as block 0. Null lines are left out.
    """
    block = "struct<region:string,rect_norm:array<double>,grid_ref:string,lines:array<string>>"
    plain = F.array(F.struct(F.lit("").alias("region"), F.array().cast("array<double>").alias("rect_norm"), F.lit("").alias("grid_ref"), c("transcribed_lines").alias("lines")).cast(block))
    blocks = F.when(F.size("transcript_blocks") > 0, c("transcript_blocks")).otherwise(plain)
    rows = readings.select(c("file").alias("drawing_id"), F.posexplode(blocks).alias("block_id", "b"))
    rows = rows.select("drawing_id", c("block_id").cast("bigint").alias("block_id"), "b.region", "b.grid_ref", F.posexplode("b.lines").alias("line_no", "text"))
    return rows.where("text is not null").select("drawing_id", "block_id", "line_no", "text", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("grid_ref", F.lit("")).alias("grid_ref"))


def reading_calls(readings: DataFrame) -> DataFrame:
    """A4: (drawing_id, call_no, region, stage, skipped, elapsed_s, error) of every model call in the readings, for extraction_summary and audit_log."""
    rows = readings.select(c("file").alias("drawing_id"), F.posexplode("responses").alias("call_no", "r"))
    return rows.select("drawing_id", "call_no", "r.region", "r.stage", F.coalesce("r.skipped", F.lit(False)).alias("skipped"), F.coalesce("r.elapsed_s", F.lit(0.0)).alias("elapsed_s"), F.coalesce("r.error", F.lit("")).alias("error"))


def upsert_extractions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A5: the store with new rows; of a fingerprint's rows the new one, and of these the latest ``saved_at``, stays."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, ["fingerprint"], [F.desc("_new"), F.desc("saved_at")]).drop("_new")


def backfill_index(saved: DataFrame, files: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New index rows (fingerprint, path) for saved readings (stem) whose file is found and not indexed, and the counts."""
    stems = first_by(files.withColumn("stem", F.regexp_replace(file_name(c("path")), r"\.pdf$", "")), ["stem"], ["folder_no", "path"])
    found = saved.join(stems.select("stem", "path", "fingerprint"), "stem", "left")
    fresh = found.where("fingerprint is not null").join(index.select("fingerprint"), "fingerprint", "left_anti")
    linked = fresh.select("stem").distinct().withColumn("linked", F.lit(1))
    counts = found.join(linked, "stem", "left").agg(F.count("*").alias("seen"), F.count("linked").alias("linked"), (F.count("*") - F.count("linked")).alias("skipped"))
    return fresh.select("fingerprint", "path"), counts


def cache_stats(store: DataFrame) -> DataFrame:
    """Entries and bytes."""
    return store.agg(F.count("*").alias("entries"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Verified examples from JSON files; those without a verified extraction are left out."""
    raw = spark.read.schema("drawing_no string, revision string, image_hash string, verified_extraction map<string,string>, verified_by string, verified_at string").option("multiLine", True).json(path)
    return verified_examples(raw)


def verified_examples(raw: DataFrame) -> DataFrame:
    """The examples that have something verified."""
    return raw.where(c("verified_extraction").isNotNull() & (F.size("verified_extraction") > 0))


def example_stats(examples: DataFrame, target: int = 10) -> DataFrame:
    """Files, different drawing numbers, pedestals, and whether the target number of examples is met."""
    return examples.agg(F.count("*").alias("files"), F.countDistinct(F.nullif("drawing_no", F.lit(""))).alias("drawings"), F.coalesce(F.sum("n_pedestals"), F.lit(0)).alias("pedestals"), (F.count("*") >= target).alias("enough"))


def read_reviews(rows: DataFrame) -> DataFrame:
    """A10: marked-up verification rows (cells array, header): those whose first cell is an integer, by position."""
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    out = rows.withColumn("row_no", F.expr("try_cast(get(cells, 0) as int)")).where("row_no is not null")
    names = ("item", "tag", "extracted", "corrected", "verified_by", "verified_at", "confidence", "notes")
    return out.select("source", F.regexp_extract("header", r"Drawing:\s*(\S+)", 1).alias("drawing_no"), "row_no", *[cell(i + 1).alias(n) for i, n in enumerate(names)])


def upsert_rates(rates: DataFrame) -> DataFrame:
    """(category, unit, rate): the last write (largest seq) of each pair."""
    return rates.groupBy("category", "unit").agg(F.max_by("rate", "seq").alias("rate"))


def rates_lookup(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """Each wanted (category, unit) with its rate, 0 where there is none."""
    return pairs.join(rates, ["category", "unit"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def classify_drawings(drawings: DataFrame, classes: DataFrame) -> DataFrame:
    """(drawing_id, path, classification) by file name; old keys with folders count as their name, the last (largest seq) wins; unknown or absent is Green Field."""
    by = classes.groupBy(file_name(c("file_name")).alias("name")).agg(F.max_by("classification", "seq").alias("cls"))
    out = drawings.withColumn("name", file_name(c("path"))).join(by, "name", "left")
    return out.select("drawing_id", "path", F.when(c("cls").isin(*SITES), c("cls")).otherwise(SITES[0]).alias("classification"))


def write_table(df: DataFrame, path: str, by: str | None = None, kind: str = "parquet") -> None:
    """A view as files; ``by`` names a column of few values (a class, a project) to have a folder for each of them."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).format(kind).save(path)
