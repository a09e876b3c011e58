"""Key-value retrieval for sets of ids: semi-joins with the tables of a snapshot.  ``ids``: (entity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.plans.tables import dealt

PREFIXES = {"wikidata": "https://www.wikidata.org/wiki/", "dbpedia": "http://dbpedia.org/resource/"}


def _of(table: DataFrame, ids: DataFrame, key: str = "entity") -> DataFrame:
    return table.join(ids.select(F.col("entity").alias(key)), key, "left_semi")


def types(items: DataFrame, ids: DataFrame) -> DataFrame:
    return _of(items, ids).select("entity", F.explode("explicit_types").alias("type"))


def objects(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(subject, object, predicates) in the order of the claims."""
    rows = _of(edges, ids, "subject").groupBy("subject", "object").agg(F.sort_array(F.collect_list(F.struct("pos", "predicate"))).alias("p"))
    return rows.select("subject", "object", F.transform("p", lambda x: x["predicate"]).alias("predicates"))


def literals(table: DataFrame, ids: DataFrame) -> DataFrame:
    rows = _of(table, ids, "subject").groupBy("subject", "datatype", "predicate").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return rows.select("subject", "datatype", "predicate", F.transform("v", lambda x: x["value"]).alias("values"))


def checked_pairs(pairs: DataFrame) -> DataFrame:
    """(pair) arrays as (subject, object); a pair of another size, or across families of ids, ends the query."""
    a, b = F.try_element_at("pair", F.lit(1)), F.try_element_at("pair", F.lit(2))
    fine = (F.size("pair") == 2) & (T.knowledge_graph(a) == T.knowledge_graph(b))
    said = F.raise_error(F.concat(F.lit("not two ids of one family: "), F.coalesce(F.array_join("pair", " "), F.lit("null"))))
    return pairs.select(F.when(fine, a).otherwise(said.cast("string")).alias("subject"), F.when(fine, b).otherwise(said.cast("string")).alias("object"))


def predicates(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, predicates) of directed pairs (subject, object); pairs without an edge are absent."""
    rows = edges.join(pairs.select("subject", "object").distinct(), ["subject", "object"]).groupBy("subject", "object").agg(F.sort_array(F.collect_list(F.struct("pos", "predicate"))).alias("p"))
    return rows.select(F.concat_ws(" ", "subject", "object").alias("pair"), F.transform("p", lambda x: x["predicate"]).alias("predicates"))


def _narrowed(m: Column, lang: str | None) -> Column:
    return m if not lang else F.when(F.map_contains_key(m, lang), F.create_map(F.lit(lang), m[lang])).otherwise(m)


def labels(items: DataFrame, ids: DataFrame, lang: str | None = None, category: str | None = None, kg: str = "wikidata") -> DataFrame:
    """Labels and aliases, each narrowed to a language if it is there; url, description, kind and NER type."""
    rows = _of(items, ids)
    if category:
        rows = rows.filter(F.col("kind") == category)
    return rows.select("entity", F.concat(F.lit(PREFIXES[kg]), "entity").alias("url"), "description", "kind", "ner_type", _narrowed(F.col("labels"), lang).alias("labels"), _narrowed(F.col("aliases"), lang).alias("aliases"))


def sameas(items: DataFrame, ids: DataFrame) -> DataFrame:
    return _of(items, ids).select("entity", F.explode(F.coalesce("urls", F.create_map().cast("map<string,string>"))).alias("site", "url"))


def sameas_lists(items: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity, urls array<struct<site, url>>): every requested entity that is known, with an empty list where it has no links."""
    urls = F.transform(F.array_sort(F.map_keys(F.coalesce("urls", F.create_map().cast("map<string,string>")))), lambda k: F.struct(k.alias("site"), F.col("urls")[k].alias("url")))
    return _of(items, ids).select("entity", urls.alias("urls"))


def summary_table(table: DataFrame) -> DataFrame:
    """(entity, predicate, count) of edges or literals."""
    return dealt(table.select(F.col("subject").alias("entity"), "predicate"), "entity").groupBy("entity", "predicate").agg(F.count("*").alias("count"))


def summary(counts: DataFrame, entities: list[str] | None = None, rank_order: str = "desc", k: int = 10) -> DataFrame:
    """The k rows with the largest counts (smallest unless ``desc``); ties by entity and predicate."""
    rows = counts.filter(F.col("entity").isin(entities)) if entities else counts
    return rows.orderBy(F.col("count").desc() if rank_order == "desc" else F.col("count").asc(), "entity", "predicate").limit(k)


def bags(texts: DataFrame, key: str, stopwords: list[str] = T.STOPWORDS) -> DataFrame:
    """(key, words) of (key, text)."""
    return texts.select(key, T.bag_of_words(F.col("text"), stopwords).alias("words"))


def bow_similarity(rows: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id, entity, similarity, matched) of asked pairs: the share of the row's words that the entity's bag holds.

    ``rows``: (row_id, words); ``candidates``: (entity, words); ``pairs``: (row_id, entity)."""
    both = pairs.join(rows, "row_id").join(candidates.withColumnRenamed("words", "bag"), "entity")
    matched = F.array_sort(F.array_intersect("words", "bag"))
    return both.select("row_id", "entity", F.coalesce(F.try_divide(F.size(matched).cast("double"), F.size("words").cast("double")), F.lit(0.0)).alias("similarity"), matched.alias("matched"))
