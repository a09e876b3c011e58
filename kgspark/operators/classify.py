"""Literal and column classification, and entity recognition without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import literals as L
from kgspark.plans.tables import shipped

LITERAL_KINDS, ENTITY_KINDS = ("NUMBER", "DATE", "STRING"), ("PERSON", "ORGANIZATION", "LOCATION", "OTHER")
VOTES = (*LITERAL_KINDS, *ENTITY_KINDS)
LABELS = {"PERS": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION"}


def literals(tokens: DataFrame) -> DataFrame:
    """(literal, datatype, classification, tag, xml_datatype), one row a distinct literal."""
    named = tokens.select("literal").distinct().withColumn("datatype", L.literal_class(F.col("literal")))
    d = F.col("datatype")
    return named.select("literal", "datatype", L.described(d, 0).alias("classification"), L.described(d, 1).alias("tag"), L.described(d, 2).alias("xml_datatype"))


def columns(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(table_id, col_id, classification, tag, datatype, probability): the class that most cells of a column have.

    Cells vote NUMBER, DATE or STRING by their literal class, and strings that are names of a ``gazetteer`` (``known``)
    for its label; ties go to the first of ``VOTES``.  Empty and null cells do not vote; a column without votes is
    UNKNOWN with probability 0.  Equal cells of a column are counted before they are classified.
    """
    same = cells.groupBy("table_id", "col_id", "value").agg(F.count("*").alias("n"))
    group = L.described(L.literal_class(F.col("value")), 0)
    vote = F.when(F.length(F.trim(F.coalesce("value", F.lit("")))) == 0, None).otherwise(F.when(group == "DATETIME", "DATE").otherwise(group))
    voted = same.select("table_id", "col_id", "value", "n", vote.alias("vote"))
    if known is not None:
        key = F.when(F.col("vote") == "STRING", F.lower(F.trim("value"))).alias("key")
        voted = voted.withColumn("key", key).join(known.select("key", "label"), "key", "left").withColumn("vote", F.coalesce("label", "vote"))
    counted = voted.groupBy("table_id", "col_id", "vote").agg(F.sum("n").alias("n"))
    order = -F.array_position(F.array(*[F.lit(x) for x in VOTES]), F.col("vote"))
    best = counted.groupBy("table_id", "col_id").agg(
        F.max(F.when(F.col("vote").isNotNull(), F.struct("n", order.alias("order"), "vote"))).alias("best"), F.sum(F.when(F.col("vote").isNotNull(), F.col("n")).otherwise(0)).alias("votes")
    )
    found = F.coalesce(F.col("best.vote"), F.lit("UNKNOWN"))
    share = F.coalesce(F.col("best.n") / F.nullif(F.col("votes"), F.lit(0)), F.lit(0.0))
    return best.select("table_id", "col_id", found.alias("classification"), tag_of(found).alias("tag"), found.alias("datatype"), share.alias("probability"))


def tag_of(name):
    return F.when(name.isin(*LITERAL_KINDS), "LIT").when(name.isin(*ENTITY_KINDS), "NE").otherwise("UNKNOWN")


CAPITALISED = r"\p{Lu}[\p{L}\p{M}'’-]*(?: \p{Lu}[\p{L}\p{M}'’-]*)*"


def capitalised(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Runs of capitalised words as (mention, OTHER, start, end): what can be told without a language model."""
    import regex

    for found in regex.finditer(CAPITALISED, text):
        yield found.group(), "OTHER", found.start(), found.end()


def recognise(texts: DataFrame, model: Callable[[str], Iterable[tuple[str, str, int, int]]] = capitalised) -> DataFrame:
    """(text_id, mention, label, start, end) of (text_id, text); offsets are characters from 0, the end exclusive.

    ``model`` runs on the executors and can be a language model's function.  A null text has no mentions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, text in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = list(model(text or ""))
                if found:
                    mention, label, start, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([text_id] * len(found), pa.int64()), pa.array(mention, pa.string()), pa.array(label, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["text_id", "mention", "label", "start", "end"])

    return shipped(texts.select(F.col("text_id").cast("long").alias("text_id"), "text")).mapInArrow(run, "text_id long, mention string, label string, start int, end int")


def gazetteer(named: DataFrame) -> DataFrame:
    """(key, label) of a name index: what a lower-case name stands for, by the most popular entity that has it; of equals one with a class."""
    label = F.lit("OTHER")
    for ner_type, said in LABELS.items():
        label = F.when(F.col("ner_type") == ner_type, said).otherwise(label)
    return named.select(F.lower("name").alias("key"), label.alias("label"), "popularity").groupBy("key").agg(F.max_by("label", F.struct("popularity", F.col("label") != "OTHER", "label")).alias("label"))


def recognise_known(texts: DataFrame, known: DataFrame, model: Callable[[str], Iterable[tuple[str, str, int, int]]] = capitalised) -> DataFrame:
    """As ``recognise``, where a mention that is a name of a ``gazetteer`` has its label."""
    found = recognise(texts, model).withColumnRenamed("label", "told").withColumn("key", F.lower("mention"))
    return found.join(known.select("key", "label"), "key", "left").select("text_id", "mention", F.coalesce("label", "told").alias("label"), "start", "end")
