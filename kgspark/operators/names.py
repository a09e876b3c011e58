"""From items to what lookup searches: surface forms, postings, vocabulary, corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as T

ITEM_COLUMNS = ["description", "kind", "ner_type", "explicit_types", "extended_types", "popularity"]


def max_popularity(items: DataFrame) -> DataFrame:
    return items.agg(F.max("popularity").alias("max_popularity"))


def with_popularity_norm(items: DataFrame) -> DataFrame:
    """Popularity over the largest, half-even to two digits; 0 where the largest is not positive.  The largest is one row."""
    most = F.broadcast(max_popularity(items))
    share = F.when(F.col("max_popularity") > 0, T.round_half_even(F.col("popularity") / F.col("max_popularity"))).otherwise(0.0)
    return items.join(most, F.lit(True)).withColumn("popularity_norm", share).drop("max_popularity")


def not_indexed(items: DataFrame, names: DataFrame) -> DataFrame:
    return items.join(names.select("entity").distinct(), "entity", "left_anti")


def _surface(labels: Column, aliases: Column) -> Column:
    """An item's surface forms as an array of (name, languages, is_alias), made within its row."""
    none = F.array().cast("array<struct<is_alias:boolean,pos:int,at:int,name:string,lang:string,key:string>>")
    form = lambda alias, pos, at, name, lang: F.struct(F.lit(alias).alias("is_alias"), pos.alias("pos"), at.alias("at"), name.alias("name"), lang.alias("lang"), F.lower(name).alias("key"))
    label = F.transform(F.map_entries(labels), lambda e, i: form(False, i, F.lit(0), e["value"], e["key"]))
    alias = F.flatten(F.transform(F.map_entries(aliases), lambda e, i: F.coalesce(F.transform(e["value"], lambda v, j: form(True, i, j, v, e["key"])), none)))
    every = F.array_sort(F.filter(F.concat(F.coalesce(label, none), F.coalesce(alias, none)), lambda x: x["name"].isNotNull()))

    def one(same: Column) -> Column:
        first = same[0]
        languages = F.transform(F.filter(same, lambda x: x["is_alias"] == first["is_alias"]), lambda x: x["lang"])
        return F.struct(first["name"].alias("name"), languages.alias("languages"), first["is_alias"].alias("is_alias"))

    # Sorted once: the first of a spelling names it.
    held = lambda sorted_: F.transform(F.array_distinct(F.transform(sorted_, lambda x: x["key"])), lambda k: one(F.filter(sorted_, lambda x: x["key"] == k)))
    return F.transform(F.array(every), held)[0]


def _person(ner_type: Column, label: Column) -> Column:
    """A person's dotted abbreviations as such an array."""
    form = lambda name: F.struct(name.alias("name"), F.array(F.lit("en")).alias("languages"), F.lit(True).alias("is_alias"))
    none = F.array().cast("array<struct<name:string,languages:array<string>,is_alias:boolean>>")
    return F.when((ner_type == "PERS") & label.isNotNull(), F.transform(T.abbreviations(label), form)).otherwise(none)


def _ner_type() -> Column:
    return F.coalesce("ner_type", F.try_element_at("ner_types", F.lit(1)))


def surface_forms(items: DataFrame) -> DataFrame:
    """(entity, name, languages, is_alias): spellings that differ by case are one, the first one; an alias that equals a
    label is left out.  Order is that of the maps."""
    return items.select("entity", F.inline(_surface(F.col("labels"), F.col("aliases"))))


def person_forms(items: DataFrame) -> DataFrame:
    """Dotted abbreviations of persons' English names, as aliases; the full name among them, whether it is indexed or not."""
    return items.select("entity", F.inline(_person(_ner_type(), F.col("labels")["en"])))


def names(items: DataFrame) -> DataFrame:
    """One row a surface form, with the columns of its item that lookup filters by and returns.

    Forms are made in the rows of the items, which are dealt by entity, so that forms met twice are found without another shuffle.
    """
    flat = items.withColumn("ner_type", _ner_type())
    for c in ("explicit_types", "extended_types"):
        flat = flat.withColumn(c, F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))
    kept = with_popularity_norm(flat).repartition("entity")
    forms = F.concat(_surface(F.col("labels"), F.col("aliases")), _person(F.col("ner_type"), F.col("labels")["en"]))
    rows = kept.select("entity", *ITEM_COLUMNS, "popularity_norm", F.inline(forms))
    return rows.select(
        F.xxhash64("entity", "name", "is_alias").alias("doc_id"), "entity", "name", "languages", "is_alias", F.length("name").cast("long").alias("name_len"),
        F.size(F.split("name", " ")).cast("long").alias("n_token"), *ITEM_COLUMNS, "popularity_norm", F.array_join("explicit_types", " ").alias("types"),
    ).dropDuplicates(["entity", "doc_id"])


def postings(named: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_len), counted within the row of a name."""
    words = named.select("doc_id", T.analysed(F.col("name")).alias("words"))
    each = words.select("doc_id", "words", F.explode(F.array_distinct("words")).alias("term"))
    return each.select("term", "doc_id", F.size(F.filter("words", lambda w: w == F.col("term"))).alias("tf"), F.size("words").alias("doc_len"))


def vocabulary(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("term_len", F.length("term"))


def corpus_stats(named: DataFrame) -> DataFrame:
    """One row: number of names and their mean length in words."""
    return named.select(F.size(T.analysed(F.col("name"))).alias("doc_len")).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def keep_latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key, the one that comes last."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def ner_counts(items: DataFrame) -> DataFrame:
    """(ner_type, entities)."""
    return items.groupBy("ner_type").agg(F.count("*").alias("entities"))


def described(description: Column, lang: str = "en") -> Column:
    """A description that is a map by language: that of a language, else the first by language code, else empty."""
    first = F.try_element_at(F.array_sort(F.map_keys(description)), F.lit(1))
    return F.coalesce(F.try_element_at(description, F.lit(lang)), F.try_element_at(description, first), F.lit(""))
