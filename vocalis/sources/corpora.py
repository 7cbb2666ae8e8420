"""Quality corpora, fixtures, snapshots and asset bundles as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, language string, mode string, category string, expectation string, input string, expected_normalized string, expected_pronunciation string, diagnostics string"
FIXTURE = "input string, language string, expected string, category string, source string, adapted string, provenance string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Nine-column TSV with \\n and \\t escapes; fails on a repeated id or where preserve and equality disagree."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=CORPUS, quote="", escape="", mode="FAILFAST")
    text = ["input", "expected_normalized", "expected_pronunciation"]
    rows = raw.withColumns({c: F.replace(F.replace(F.col(c), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")) for c in text})
    checked = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if((F.col("expectation") == "preserve") != (F.col("input") == F.col("expected_normalized"))).alias("bad")).first()
    if checked["n"] != checked["ids"] or checked["bad"]:
        raise ValueError(f"{path}: {checked['n'] - checked['ids']} repeated ids, {checked['bad']} wrong expectations")
    return rows


def write_corpus(rows: DataFrame, path: str) -> None:
    text = ["input", "expected_normalized", "expected_pronunciation"]
    out = rows.withColumns({c: F.replace(F.replace(F.col(c), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")) for c in text})
    out.orderBy("id").write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURE).json(path).where("category is not null and source is not null")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Tagged TSV rows of any width: tag, key, value (further fields stay joined by tabs)."""
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).where("value <> ''").select(parts[0].alias("tag"), F.coalesce(F.get(parts, 1), F.lit("")).alias("key"), F.coalesce(F.get(parts, 2), F.lit("")).alias("value"))


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.orderBy("tag", "key").select(F.concat_ws("\t", "tag", "key", "value").alias("value")).write.text(path)


def asset_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def broken_assets(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (name, sha256) whose file is missing or differs."""
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("actual"))
    return manifest.join(named, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("actual")))


def generate(templates: DataFrame, numbers: DataFrame) -> DataFrame:
    """Every template (category, template, spoken_template, with %s) with every number (written, spoken). Templates are
    written by hand and few, so they are gathered into one array that each number meets; numbers may be any many."""
    every = templates.agg(F.collect_list(F.struct("category", "template", "spoken_template")).alias("ts"))
    each = numbers.join(F.broadcast(every), F.col("ts").isNotNull()).select("written", "spoken", F.explode("ts").alias("t")).select("written", "spoken", "t.*")
    return each.select("category", F.replace("template", F.lit("%s"), F.col("written")).alias("input"), F.replace("spoken_template", F.lit("%s"), F.col("spoken")).alias("expected"))
