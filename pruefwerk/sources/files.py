"""Files around the tables: JSON between steps, the call log, review sheets, and documents with a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_COLUMNS = ["human_correctness_baseline", "human_correctness_semantic", "human_correctness_raw", "human_faithfulness_semantic", "human_faithfulness_raw"]


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON arrays; a schema spares the pass that would infer one."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_calls(calls: DataFrame, path: str) -> None:
    """Append calls to the log, a JSON object to a line."""
    calls.write.mode("append").json(path)


def write_review(sample: DataFrame, path: str) -> None:
    """A review sheet with a column for each score a person is to fill in."""
    blank = sample.select("*", *(F.lit("").alias(c) for c in REVIEW_COLUMNS))
    blank.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).csv(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A filled-in review sheet; what isn't a number is missing."""
    sheet = spark.read.option("sep", ";").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    number = lambda c: F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    return sheet.select(*(number(c).alias(c) if c in REVIEW_COLUMNS else F.col(c) for c in sheet.columns))


def validation_sheet(labelled: DataFrame, machine: str, human: str, note: str = "checked by hand") -> DataFrame:
    """Labelled rows with their agreement, 1 or 0, and a note, as they are written for a check of the labels."""
    return labelled.withColumn("agreement", F.col(machine).eqNullSafe(F.col(human)).cast("int")).withColumn("note", F.lit(note))


def write_validation(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).csv(path)


def score_of(record, system: str, metric: str):
    """The score of a JSON record: nested under system and metric, else flat; null where it is no number."""
    nested = F.get_json_object(record, f"$.{system}.{metric}")
    flat = F.get_json_object(record, f"$.{system}_{metric}")
    is_object = nested.startswith("{")
    found = F.when(is_object, F.get_json_object(record, f"$.{system}.{metric}.score")).otherwise(flat)
    return F.when(found == "true", 1.0).when(found == "false", 0.0).otherwise(found.try_cast("double"))


def extracted_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]], first: int = 1, last: int | None = None) -> DataFrame:
    """``path, page_number, text, error`` of documents; ``extract`` gives the text of each page of one.

    Pages are taken from ``extract`` one by one, and none after ``last``. A document that can't be read gives a row with the error instead of stopping the others.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(name, n, text, None) for n, text in enumerate(islice(extract(content), first - 1, last), first)]
                except Exception as error:  # noqa: BLE001
                    rows.append((name, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"])

    pages = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, page_number int, text string, error string")
    return pages


def cropped(pages: DataFrame, header: float = 0.0, footer: float = 0.1) -> DataFrame:
    """Pages without the share of their lines at the top and the bottom."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    kept = F.slice(lines, F.floor(n * header).cast("int") + 1, F.greatest(n - F.floor(n * header).cast("int") - F.floor(n * footer).cast("int"), F.lit(0)))
    return pages.withColumn("text", F.array_join(kept, "\n"))


def with_images(text: str, descriptions: str):
    """A text whose i-th image mark is replaced by the i-th description; marks without one are taken out."""
    parts = F.split(text, r"!\[.*?\]\(.*?\)")
    described = lambda p, i: F.when(F.try_element_at(F.col(descriptions), i + 1) != "", F.concat(F.lit("\n[BILD-INFO: "), F.try_element_at(F.col(descriptions), i + 1), F.lit("]\n"))).otherwise("")
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < last, F.coalesce(described(p, i), F.lit(""))).otherwise(F.lit("")))), "")


def page_markdown(pages: DataFrame, document: str) -> DataFrame:
    """The pages of a document as one text with a marker before each page."""
    marked = F.concat(F.lit("### Seite "), F.col("page_number"), F.lit("\n"), F.coalesce("text", F.lit("")))
    ordered = pages.groupBy(document).agg(F.sort_array(F.collect_list(F.struct("page_number", marked.alias("marked")))).alias("p"))
    return ordered.select(document, F.array_join(F.col("p.marked"), "\n\n").alias("text"))
