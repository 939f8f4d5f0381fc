"""Specifications as pages, drawings' manifests, questions, and the catalog of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of drawings by the beginning of their names, and how they are titled.
PREFIXES = {"plan": ("building", "Floor plan"), "brk": ("mechanical", "Bracket"), "db": ("electrical", "Distribution board"), "ckt": ("electrical", "Circuit")}
#: Names that may be asked for: letters, digits, dots, dashes and underscores, and one of the known kinds.
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*\.(dxf|pdf|json)$"

#: What manifests of all kinds have in common, and the parts that one kind alone has.
MANIFEST = (
    "id string, kind string, spec string, file string, units string, width int, depth int, height int, corridor_width int, total_wall_length double, layers array<string>, "
    "rooms array<struct<name:string,x0:int,y0:int,x1:int,y1:int,width:int,depth:int,area_m2:double,door_width:int,windows:array<int>>>, "
    "holes array<struct<x:double,y:double,d:double>>, plate_area_mm2 double, net_area_mm2 double, "
    "main_rating_a int, total_cable_length_m double, total_load_w double, "
    "circuits array<struct<tag:string,type:string,rcd:struct<tag:string,sens_ma:int>,rating_a:int,cable_size:double,cable_tag:string,cable_length_m:int,load_w:int,"
    "loads:array<struct<tag:string,type:string,load_w:int>>>>, "
    "components array<struct<tag:string,type:string,attrs:map<string,string>>>, nets map<string,array<string>>, neighbours map<string,array<string>>, counts map<string,int>"
)
QUESTION = "id string, kind string, domain string, template string, variant string, drawing string, spec string, question string, expected string, answer_type string, expected_route string"


class ScannedDocument(ValueError):
    """A document without any text."""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """source, page (from 1) and text of all ``*.json`` files below ``path`` that hold a line per page.

    Text is taken out of PDF files by other programs; what they write is read here.
    Blank pages are dropped.
    """
    schema = "source string, page int, text string"
    pages = spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    return pages.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "")


def page_facts(pages: DataFrame) -> DataFrame:
    """source, pages, chars and scanned: true where no page of (source, page, text) has any text."""
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " ")) == ""
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"), F.bool_and(blank).alias("scanned"))


def with_text(pages: DataFrame, recognise=None) -> DataFrame:
    """Pages with blank ones read by ``recognise``, a function from the page's columns to a text Column, and dropped if still blank.

    Raises ``ScannedDocument`` where a source then has no text at all.
    """
    blank = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", " ")) == ""
    text = F.col("text") if recognise is None else F.when(blank(F.col("text")), recognise(pages)).otherwise(F.col("text"))
    read = pages.withColumn("text", text)
    empty = page_facts(read).where("scanned").select("source").limit(5).collect()
    if empty:
        raise ScannedDocument(f"no text in {', '.join(str(r['source']) for r in empty)}")
    return read.where(~blank(F.col("text")))


def section_pages(sections: DataFrame, per_page: int = 2) -> DataFrame:
    """source, page, text of (source, n from 0, title, clauses array of struct(id, text)): some sections to a page."""
    body = F.concat_ws("\n", F.array("title"), F.transform("clauses", lambda c: F.concat(c["id"], F.lit(" "), c["text"])))
    paged = sections.select("source", (F.floor(F.col("n") / per_page) + 1).cast("int").alias("page"), "n", body.alias("body"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n")
    return paged.groupBy("source", "page").agg(lines.alias("text"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of all kinds below ``path``, one row per ``*.json`` file; a file that is none has nulls only but for its drawing_id."""
    files = spark.read.schema(MANIFEST).option("multiLine", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    return files.withColumn("drawing_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def specs_of(manifests: DataFrame) -> DataFrame:
    """drawing_id and spec of the drawings whose manifest names a specification."""
    return manifests.where("spec IS NOT NULL").select("drawing_id", "spec")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions, one JSON object per line; blank lines are skipped."""
    return spark.read.schema(QUESTION).json(path).where("id IS NOT NULL")


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON, one per line, in as many files as they have partitions."""
    rows.write.mode("overwrite").json(path)


def catalog(names: DataFrame) -> DataFrame:
    """file, drawing_id, category and title of (file) for names of a known beginning; the title numbers the drawing."""
    stem = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    prefix, number = F.regexp_extract(stem, r"^([a-z]+)", 1), F.regexp_extract(stem, r"(\d+)$", 1)
    category, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (kind, says) in PREFIXES.items():
        category = F.when(prefix == name, kind).otherwise(category)
        title = F.when(prefix == name, F.concat(F.lit(says + " "), number.cast("int").cast("string"))).otherwise(title)
    return names.select("file", stem.alias("drawing_id"), category.alias("category"), title.alias("title")).where("category IS NOT NULL")


def resolve(asked: DataFrame, samples: DataFrame, uploads: DataFrame) -> DataFrame:
    """name and path of (name): a sample of that name, else an upload, else null; unsafe names are never looked up."""
    safe = F.coalesce(F.col("name").rlike(SAFE_NAME), F.lit(False))
    first = samples.select(F.col("name").alias("_n"), F.col("path").alias("_sample"))
    second = uploads.select(F.col("name").alias("_m"), F.col("path").alias("_upload"))
    found = asked.join(first, safe & (F.col("name") == F.col("_n")), "left").join(second, safe & (F.col("name") == F.col("_m")), "left")
    return found.select("name", F.coalesce("_sample", "_upload").alias("path"))


def category_of(column: Column) -> Column:
    """The category of a drawing's id by its beginning, null if unknown."""
    out = F.lit(None).cast("string")
    for name, (kind, _) in PREFIXES.items():
        out = F.when(F.regexp_extract(column, r"^([a-z]+)", 1) == name, kind).otherwise(out)
    return out
