"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, line_dedup
from . import url_filters as urls
from . import warc
from .jaccard_join import ORACLE as JACCARD_SQL
from .jaccard_join import jaccard_components
from .lexical import ORACLE as LEXICAL_SQL
from .lexical import search
from .licenses import scan
from .mixing import mix
from .pieces import encode_texts, load
from .quality_model import score_quality
from .quality_rules import quality_rules
from .sketches import sketch_with_next
from .store import Scratch, table
from .toxicity import score_toxicity


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, containment, first_word, windows: a row for each document and license found."""
    return scan(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: three-word shingles, similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed, failed_rule, kept of every document."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return urls.url_filters(table(spark, sf_dir, "pages"), URL_RULES)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    scratch = Scratch(spark, "warc")
    index = warc.write(table(spark, sf_dir, "pages"), scratch)
    return warc.read(index, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and parts (pass, shard, words) of every document."""
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sizes, fingerprints of each text and of its edited form, and their likeness."""
    return sketch_with_next(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), load(), ["doc_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the 20 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and the counts of five filters, in all orders."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filters": op5_url_filters,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_line_dedup": op12_line_dedup,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": JACCARD_SQL, "op5_url_filters": urls.oracle(URL_RULES), "op6_warc": warc.ORACLE, "op11_ranked_search": LEXICAL_SQL, "op12_line_dedup": line_dedup.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
