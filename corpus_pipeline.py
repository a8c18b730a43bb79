"""From raw documents to token ids: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. n_chars follows the text where a stage edits it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, quality, secrets, simhash
from tidemark.llm.common import documents, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of their own for each row, which repeated and null doc_ids aren't."""
    return staged(docs.select(*COLUMNS).withColumn("rid", F.monotonically_increasing_id()), "rows")


def _by_row(rows: DataFrame) -> DataFrame:
    """For operators: the rows' own keys as doc_id."""
    return rows.withColumn("doc_id", F.col("rid")).drop("rid")


def _decided(rows: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined with an operator's decisions on _by_row of them."""
    return rows.join(decisions.withColumnRenamed("doc_id", "rid"), "rid", how)


def _edited(rows: DataFrame, places: str, edit: Callable[[str, list], str]) -> DataFrame:
    """The documents with the given places edited; n_chars follows where the text changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [edit(text, at) for text, at in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            lengths = [n if new == old.as_py() else len(new) for new, old, n in zip(texts, batch.column(1), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(lengths, pa.int64())], names=list(COLUMNS))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"n_chars": "long"}
    return rows.select(*COLUMNS, places).mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in COLUMNS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id (nulls last) of each group of near copies: five-word Jaccard of 0.8 or more, linked singly."""
    rows = _keyed(docs)
    grouped = rows.select("rid", "doc_id").join(simhash.similar(rows), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")).select("first.rid")
    return rows.join(first.hint("merge"), "rid", "left_semi").select(*COLUMNS)  # never broadcast: it grows with the corpus


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages in the others are cut out."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS[1:])
    # staged, so that no task needs two Python workers at a time
    found = staged(found.where("not contaminated").select(*COLUMNS, "spans"), "windows")
    return _edited(found, "spans", lambda text, spans: decontaminate.cut_spans(text, [(s["start"], s["end"]) for s in spans]) if spans else text)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; widely copied examples stay."""
    rows = _keyed(docs)
    found = secrets.secrets(_by_row(rows), widely=True).where("n_live > 0").select("doc_id", F.filter("marks", lambda m: m.live).alias("marks"))
    hit = staged(found, "live-secrets")
    clean = _decided(rows, hit, "left_anti").select(*COLUMNS)
    return clean.unionByName(_edited(_decided(rows, hit), "marks", lambda text, marks: secrets.mask(text, [(m["start"], m["end"]) for m in marks])))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("byte-level bpe", tokenise),
]

#: Likelihood ratios, SimHash groups and BPE can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
