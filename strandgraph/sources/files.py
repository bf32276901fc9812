"""Readers and writers of the files that the workflow exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.functions.text import after_prefix
from strandgraph.functions.vectors import normalized
from strandgraph.sources import rejects, schemas


def _id_from_name(suffix: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{suffix}\.json$", 1)


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    """Files {id}.concepts.json."""
    rows = spark.read.schema(schemas.EXTRACTION).json(f"{folder}/*.concepts.json", multiLine=True)
    return rows.withColumn("paper_id", _id_from_name("concepts"))


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """Files {id}.relations.json."""
    rows = spark.read.schema(schemas.RELATIONS).json(f"{folder}/*.relations.json", multiLine=True)
    return rows.withColumn("paper_id", _id_from_name("relations"))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.PARSED).json(f"{folder}/*.parsed.json", multiLine=True)


def extraction_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Extractions as JSON lines with their paper_id: one file for many papers. Lines that aren't JSON
    have their text in _corrupt_record."""
    return spark.read.schema(f"paper_id string, {schemas.EXTRACTION}, _corrupt_record string").json(folder)


def relation_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"paper_id string, {schemas.RELATIONS}, _corrupt_record string").json(folder)


def parsed_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.PARSED).json(folder)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of stored Atom feeds: (id, title, summary, published, file)."""
    rows = spark.read.option("rowTag", "entry").schema("id string, title string, summary string, published string").xml(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def feed_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of stored feeds as a stream: each file once, whatever restarts there are, files in parallel."""
    return spark.readStream.format("xml").option("rowTag", "entry").schema(schema).load(path)


def pdf_files(spark: SparkSession, folder: str, least: int = 10_000) -> DataFrame:
    """(paper_id, path, length) of stored PDF files that are long enough to be papers."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return rows.where(F.col("length") >= least).select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("paper_id"), "path", "length")


def with_relations(concepts: DataFrame, builds: DataFrame) -> DataFrame:
    """Extractions with their references; papers without a relations file have none."""
    both = concepts.join(builds.select("paper_id", "builds_on"), "paper_id", "left")
    return both.withColumn("builds_on", F.coalesce("builds_on", F.array().cast("array<string>")))


def mentions(both: DataFrame) -> DataFrame:
    """(paper_id, phase, idx, name, definition) in the order in which names are met."""
    d = both.select("paper_id", F.lit(0).alias("phase"), F.posexplode("defines").alias("idx", "d")).select("paper_id", "phase", "idx", "d.name", F.coalesce("d.definition", F.lit("")).alias("definition"))
    b = both.select("paper_id", F.lit(1).alias("phase"), F.posexplode("builds_on").alias("idx", "name")).withColumn("definition", F.lit(""))
    return d.unionByName(b).where("name is not null")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(ord, label, aliases, status, definition, source, first_seen) of a lexicon's JSON map."""
    rows = spark.read.schema(schemas.LEXICON).json(path, multiLine=True)
    entries = rows.select(F.posexplode(F.map_entries("techniques")).alias("ord", "e"))
    return entries.select("ord", F.col("e.key").alias("label"), F.coalesce("e.value.aliases", F.array().cast("array<string>")).alias("aliases"), "e.value.status", F.coalesce("e.value.definition", F.lit("")).alias("definition"), "e.value.source", "e.value.first_seen")


def reviewed(spark: SparkSession, path: str) -> DataFrame:
    """(rk) of the reviewed set; a file that isn't valid JSON counts as empty (see reviewed_parts)."""
    return reviewed_parts(spark, path).good.select(F.explode("reviewed").alias("rk")).distinct()


def reviewed_parts(spark: SparkSession, path: str) -> rejects.Parted:
    """The reviewed set's files that can be read, and those that can't, as they are."""
    return rejects.json_rows(spark, path, "reviewed array<string>", whole_files=True)


def embedding_store(rows: DataFrame, model: str) -> DataFrame:
    """(kind, id, vector) of one model's store, unit vectors; zero vectors are out."""
    kind = F.when(F.col("node_id").startswith("paper:"), "paper").otherwise("concept")
    out = rows.where(F.col("model") == model).select(kind.alias("kind"), after_prefix(F.col("node_id")).alias("id"), normalized(F.col("vector")).alias("vector"))
    return out.where("vector is not null")


def append_embeddings(new: DataFrame, have: DataFrame, path: str) -> None:
    """Append what isn't stored yet, partitioned by model."""
    new.join(have, ["node_id", "model"], "left_anti").write.mode("append").partitionBy("model").parquet(path)


def markdown_sections(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, value) with the headings above: h2, h3, h4. A heading ends lower ones."""
    level = F.length(F.regexp_extract("value", r"^(#{1,6})\s", 1))
    marked = lines.withColumn("level", level).withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_replace("value", r"^#+\s*", ""))))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = marked
    for n in (2, 3, 4):
        # '' where a higher heading resets this level
        mark = F.when(F.col("level") == n, F.col("title")).when((F.col("level") > 0) & (F.col("level") < n), F.lit(""))
        out = out.withColumn(f"h{n}", F.nullif(F.last(mark, ignorenulls=True).over(order), F.lit("")))
    return out.drop("title")


def markdown_bullets(sections: DataFrame) -> DataFrame:
    """Bullets with a link: (file, line_no, section, title, url)."""
    link = r"^\s*[-*]\s+.*?\[([^\]]+)\]\(([^)]+)\)"
    section = F.concat_ws(" / ", "h2", "h3", "h4")
    return sections.where(F.col("value").rlike(link)).select("file", "line_no", section.alias("section"), F.regexp_extract("value", link, 1).alias("title"), F.regexp_extract("value", link, 2).alias("url"))


def markdown_table(lines: DataFrame) -> DataFrame:
    """Rows of Markdown tables: (file, line_no, cells), without rules between heads and bodies."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim("value").startswith("|")).select("file", "line_no", cells.alias("cells"))
    return rows.where(~F.forall("cells", lambda x: x.rlike(r"^:?-+:?$")))


def table_links(rows: DataFrame) -> DataFrame:
    """(file, line_no, cell, title, url) of the links in table cells."""
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    cells = rows.select("file", "line_no", F.posexplode("cells").alias("cell", "value")).where(F.col("value").rlike(link))
    return cells.select("file", "line_no", "cell", F.regexp_extract("value", link, 1).alias("title"), F.regexp_extract("value", link, 2).alias("url"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, quotes and line ends in values as write_csv makes it; empty is null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_triples(triples: DataFrame, path: str) -> None:
    """One statement a line."""
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode("overwrite").text(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of what write_triples wrote; a literal keeps its quotes and escapes."""
    part = r"^(\S+) (\S+) (.*) \.$"
    return spark.read.text(path).select(*[F.regexp_extract("value", part, i + 1).alias(c) for i, c in enumerate("spo")])


def report_lines(rows: DataFrame, template: str, *columns: str) -> DataFrame:
    """(value): one formatted line a row, for text or Markdown reports."""
    return rows.select(F.format_string(template, *columns).alias("value"))
