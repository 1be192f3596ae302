"""The registered queries of the numbered problems, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import table
from . import encode, neardup, pack, pairs, residue, scan_noise, split, truncation


def _limits(spark: SparkSession, sf_dir: str, field: str) -> tuple[int, int]:
    """The limit and overlap of a field; ``split_limits`` has a row for each field and doesn't grow."""
    row = table(spark, sf_dir, "split_limits").where(F.col("field") == field).first()
    return int(row["max_chars"]), int(row["overlap_chars"])


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = split.split_oversized(table(spark, sf_dir, "pages_raw", "page_id", "text"), "page_id", "text", *_limits(spark, sf_dir, "pages_raw.text"))
    semantic = table(spark, sf_dir, "chunks", "chunk_uid", "mode", "content").where("mode = 'semantic'")
    chunks = split.split_oversized(semantic, "chunk_uid", "content", *_limits(spark, sf_dir, "chunks.semantic.content"))
    named = lambda df, field: df.select(F.lit(field).alias("field"), "*")
    return named(pages, "pages_raw.text").unionByName(named(chunks, "chunks.semantic.content"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text over the limit is one that came out in more than one piece; each has one first piece."""
    return p1_pieces(spark, sf_dir).where("n_pieces > 1 and piece_no = 1").select("field", "record_id")


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text over its limit whether its pieces, without their overlaps, are the text, keep the limit and begin with the overlap."""
    pages = table(spark, sf_dir, "pages_raw", F.lit("pages_raw.text").alias("field"), F.col("page_id").alias("record_id"), "text")
    semantic = table(spark, sf_dir, "chunks", "chunk_uid", "mode", "content").where("mode = 'semantic'")
    texts = pages.unionByName(semantic.select(F.lit("chunks.semantic.content").alias("field"), F.col("chunk_uid").alias("record_id"), F.col("content").alias("text")))
    limits = table(spark, sf_dir, "split_limits")
    found = p1_pieces(spark, sf_dir).groupBy("field", "record_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece")))["piece"].alias("pieces"))
    joined = texts.where("text IS NOT NULL").join(found, ["field", "record_id"]).join(F.broadcast(limits), "field")
    after = F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(1)))
    rest = F.when(F.size("pieces") > 1, after).otherwise(F.array().cast("array<string>"))
    whole = F.concat(F.col("pieces")[0], F.array_join(F.transform(rest, lambda p: F.substring(p, F.col("overlap_chars") + 1, F.length(p))), ""))
    return joined.select(
        "field", "record_id", (whole == F.col("text")).alias("covers"), F.forall("pieces", lambda p: F.length(p) <= F.col("max_chars")).alias("in_limit"),
        F.forall(F.arrays_zip(F.slice("pieces", 1, F.greatest(F.size("pieces") - 1, F.lit(0))).alias("a"), rest.alias("b")), lambda z: F.right(z["a"], F.col("overlap_chars")) == F.left(z["b"], F.col("overlap_chars"))).alias("overlaps"),
    )


#: The fields of problem 2 by their codes.
COPY_FIELDS = ["chunks.raw.content", "answers.retrieved_context"]


def _copy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "chunks", "chunk_uid", "mode", "content").where("mode = 'raw'")
    contexts = table(spark, sf_dir, "answers", "answer_id", "retrieved_context")
    as_record = lambda df, code, key, text: df.select(F.lit(code).alias("field"), F.col(key).alias("id"), F.col(text).alias("text"))
    return as_record(raw, 0, "chunk_uid", "content").unionByName(as_record(contexts, 1, "answer_id", "retrieved_context"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.all_pairs(*neardup.near_copies(_copy_records(spark, sf_dir)))
    return pairs.select(neardup.field_names(F.col("field"), COPY_FIELDS).alias("field"), "id_a", "id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_copies(_copy_records(spark, sf_dir))
    grouped = neardup.groups(cut_lineage(members), cut_lineage(links))
    return grouped.select(neardup.field_names(F.col("field"), COPY_FIELDS).alias("field"), F.col("id").alias("record_id"), "group_id", "n_links")


def _answer_field() -> Column:
    return F.when(F.col("system") == "baseline", F.lit("baseline_answer")).otherwise(F.lit("rag_answer"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "answers", "answer_id", "system", "question", "answer")
    golden = table(spark, sf_dir, "golden", "golden_id", "question", "answer")
    records = answers.select(_answer_field().alias("field"), F.col("answer_id").alias("record_id"), "question", "answer").unionByName(
        golden.select(F.lit("golden.answer").alias("field"), F.col("golden_id").alias("record_id"), "question", "answer")
    )
    return pairs.defective_pairs(records, "question", "answer")


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and raw chunk as readable paragraphs, with the kinds of noise that were in it."""
    pages = table(spark, sf_dir, "pages_raw", "page_id", "script_id", "page_number", "text")
    raw = table(spark, sf_dir, "chunks", "chunk_uid", "script_id", "mode", "content").where("mode = 'raw'")
    nowhere = F.lit(None).cast("int")
    records = pages.select(F.lit("pages_raw.text").alias("field"), F.col("page_id").alias("record_id"), "script_id", "page_number", "text").unionByName(
        raw.select(F.lit("chunks.raw.content").alias("field"), F.col("chunk_uid").alias("record_id"), "script_id", nowhere.alias("page_number"), F.col("content").alias("text"))
    )
    return scan_noise.repair(records, pages)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_text(spark, sf_dir).select("field", "record_id", F.explode("noise").alias("noise"))


def _cut_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All answers and reasonings, and those of them that are cut and have no other defect; each id once."""
    answers = table(spark, sf_dir, "answers", "answer_id", "system", "model", "question", "answer")
    reasonings = table(spark, sf_dir, "evaluation_results", "eval_id", "judge_model", "reasoning")
    records = answers.select(
        F.lit("answer").alias("kind"), _answer_field().alias("field"), F.col("answer_id").alias("record_id"), F.col("model").alias("made_by"), F.col("answer").alias("text")
    ).unionByName(reasonings.select(
        F.lit("reasoning").alias("kind"), F.lit("evaluation_results.reasoning").alias("field"), F.col("eval_id").alias("record_id"), F.col("judge_model").alias("made_by"), F.col("reasoning").alias("text")
    ))
    once = ["kind", "field", "record_id", "made_by"]
    cut = truncation.truncated(records).distinct()
    # only cut answers are looked at for the other defects
    asked = answers.select(F.lit("answer").alias("kind"), F.col("answer_id").alias("record_id"), "question", "answer")
    judged = truncation.other_defect(cut.join(asked, ["kind", "record_id"], "left"), "question", "answer")
    return records.select(*once).distinct(), judged.where("NOT defective").select(*once)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_records(spark, sf_dir)[1].select("field", "record_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model of answers and each judge model of reasonings the share of its records that are cut."""
    return truncation.truncation_rates(*_cut_records(spark, sf_dir), "made_by")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_ids(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "pack_settings"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packing_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_settings"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of container the documents that are in one, the overfull ones, and those in more parts than needed."""
    packed = cut_lineage(p7_containers(spark, sf_dir))
    settings = table(spark, sf_dir, "pack_settings", "container_kind", "capacity")
    filled = packed.groupBy("container_kind", "container_id").agg(F.sum("part_tokens").alias("tokens")).join(F.broadcast(settings), "container_kind")
    overfull = filled.groupBy("container_kind").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("n_overfull"))
    parts = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("part_tokens").alias("tokens")).join(F.broadcast(settings), "container_kind")
    needed = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))
    whole = parts.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n") != needed).alias("n_wrongly_split"))
    return whole.join(overfull, "container_kind").select("container_kind", "n_documents", "n_overfull", "n_wrongly_split")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left for use."""
    return table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").join(p8_found(spark, sf_dir), "doc_id", "left_anti")


def p8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.validation(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_checks, p2_found, p2_groups, p3_found, p4_found, p4_text, p5_found, p5_rates, p6_ids, p7_containers, p7_fill, p7_checks, p8_found, p8_clean, p8_validation)}
