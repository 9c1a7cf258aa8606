"""Other files in and out: alignments, CSV, whole texts; CSV, LaTeX and provenance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENT = "SrcEntity string, TgtEntity string, Score double"


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated reference pairs with the derived Label."""
    df = spark.read.schema(ALIGNMENT).option("sep", "\t").option("header", True).csv(path)
    return df.withColumn("Label", F.coalesce((F.col("Score") == 1.0).cast("int"), F.lit(0)))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; pass a schema for large files, or two passes are made."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def write_csv(df: DataFrame, path: str) -> None:
    """K1"""
    df.write.option("header", True).mode("overwrite").csv(path)


def append_text(path: str, text: str) -> None:
    """K2: to a report file of the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def new_terms(transformed: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of transformed(concept_uri, source_uri, source_term, transformed_term, language_tag) that pool(term, language_tag) lacks, by case."""
    known = pool.select(F.col("term").alias("transformed_term"), "language_tag").distinct()
    return transformed.join(known, ["transformed_term", "language_tag"], "left_anti").select(transformed.columns)


def _escaped(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r'(["\\])', r"\\$1"), "\n", r"\\n")


#: Prefixes of what is minted, and of the terms that describe it.
PREFIXES = {"run": "run:", "label": "label:", "term": "term:"}


def provenance(transformed: DataFrame, pool: DataFrame, operations: list[str], editor: str, created: str, prefixes: dict[str, str] = PREFIXES) -> tuple[DataFrame, DataFrame]:
    """K4: (labels, provenance) of the new terms, each with minted URIs and its Turtle; literals are escaped.

    URIs are digests of what they name below the given prefixes, so a run that is repeated mints the same ones.
    """
    fresh = new_terms(transformed, pool)
    digest = lambda kind, n: F.substring(F.sha1(F.concat_ws("|", F.lit(kind), "concept_uri", "source_uri", "source_term", "transformed_term", "language_tag")), 1, n)
    rows = fresh.withColumn("instance", F.concat(F.lit(prefixes["run"] + "instance-"), digest("instance", 40))).withColumn("label_uri", F.concat(F.lit(prefixes["label"]), digest("label", 30)))
    run = F.concat(F.lit(prefixes["run"]), F.sha1(F.lit("|".join([*operations, editor, created]))))
    term, source, lang = _escaped(F.col("transformed_term")), _escaped(F.col("source_term")), F.col("language_tag")
    labels = rows.select(
        "label_uri", "concept_uri", F.col("transformed_term").alias("literal_form"), "language_tag", F.lit(editor).alias("editor"), F.lit(created).alias("created"),
        F.format_string('%s skosxl:literalForm "%s"@%s; a skosxl:Label ; pav:createdOn ' + created + " ; pav:lastUpdatedOn " + created + " ; pav:createdBy " + editor + " ; pav:curatedBy " + editor + " . %s skosxl:altLabel %s .", "label_uri", term, lang, "concept_uri", "label_uri").alias("turtle"),
    )
    events = rows.select(
        run.alias("run_uri"), "instance", "source_uri", "source_term", "transformed_term", F.lit(", ".join(operations)).alias("created_with"),
        F.format_string('%s prov:used %s ; ' + prefixes["term"] + 'input "%s" ; ' + prefixes["term"] + 'output "%s" . %s prov:wasDerivedFrom %s .', "instance", "source_uri", source, term, "label_uri", "instance").alias("turtle"),
    )
    return labels, events


def ntriples(triples: DataFrame) -> DataFrame:
    """K5: (line) for each triple of (s, p, o, o_kind, lang), as N-Triples."""
    name = lambda c, blank: F.when(blank, F.concat(F.lit("_:"), F.regexp_replace(c, "^_:", ""))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), F.col("lang")), F.lit("")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(name(F.col("o"), F.col("o_kind") == "bnode"))
    return triples.select(F.concat_ws(" ", name(F.col("s"), F.col("s").startswith("_:")), name(F.col("p"), F.lit(False)), obj, F.lit(".")).alias("line"))


def write_graph(triples: DataFrame, path: str) -> None:
    """K5: each task writes its part."""
    ntriples(triples).write.mode("overwrite").text(path)


def store_normalization(transformed: DataFrame, pool: DataFrame, operations: list[str], editor: str, created: str, path: str) -> str:
    """K4: append both tables below path; the message says whether there was anything new."""
    labels, events = provenance(transformed, pool, operations, editor, created)
    if labels.limit(1).count() == 0:
        return "No new terms to be transformed."
    labels.write.mode("append").parquet(f"{path}/labels")
    events.write.mode("append").parquet(f"{path}/provenance")
    return "stored"
