"""Queries over the synthetic tables and their DuckDB twins, one per operator; ``sources.demo`` says how the tables are a graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import engine
from kgspark.functions import literals as L
from kgspark.functions import text as T
from kgspark.operators import classify, lookup, names, retrieve
from kgspark.plans import closure as C
from kgspark.plans import tables
from kgspark.sources import company_csv, demo, dump, edges_tsv, snapshots
from kgspark.sources.demo import table, with_
from kgspark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def joined(column: str, name: str | None = None):
    return F.array_join(column, " ").alias(name or column)


def entities(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("entity")).distinct()


# Closure of the type hierarchy


@query(with_("type_edges", "closure") + " SELECT subclass, superclass FROM closure")
def closure_full(spark, d):
    return C.closure(demo.type_edges(spark, d)).select("subclass", "superclass")


@query(with_("cyclic_edges", "closure").replace("type_edges", "cyclic_edges") + " SELECT subclass, superclass FROM closure")
def closure_cyclic(spark, d):
    return C.closure(demo.cyclic_edges(spark, d)).select("subclass", "superclass")


@query(with_("type_edges", "closure") + " SELECT subclass, superclass FROM closure WHERE subclass IN (SELECT 'Q1' || s_suppkey FROM supplier)")
def closure_seeded(spark, d):
    seeds = table(spark, d, "supplier").select(demo.qid(demo.PART, "s_suppkey").alias("item"))
    return C.closure(demo.type_edges(spark, d), seeds).select("subclass", "superclass")


@query(with_("type_edges", "closure") + " SELECT 'Q1' || p_partkey AS item, coalesce(string_agg(superclass, ' ' ORDER BY superclass), '') AS superclasses FROM part LEFT JOIN closure ON subclass = 'Q1' || p_partkey GROUP BY 1")
def closure_all_items(spark, d):
    asked = table(spark, d, "part").select(demo.qid(demo.PART, "p_partkey").alias("item"))
    return C.superclasses(asked, C.closure(demo.type_edges(spark, d))).select("item", joined("superclasses"))


@query(
    with_("type_edges", "closure", "instances")
    + ", seeds AS (SELECT child, parent FROM instances UNION SELECT child, parent FROM type_edges) SELECT child AS item, parent AS superclass FROM seeds UNION SELECT s.child, c.superclass FROM seeds s JOIN closure c ON s.parent = c.subclass"
)
def closure_instance(spark, d):
    edges = demo.type_edges(spark, d)
    return C.of_instances(demo.instances(spark, d), edges, C.closure(edges))


@query(with_("type_edges", "closure") + " SELECT subclass AS entity FROM closure WHERE superclass = 'Q12' UNION SELECT 'Q12'")
def descendants(spark, d):
    return C.below(demo.type_edges(spark, d), "Q12")


@query(with_("type_edges", "closure") + " SELECT superclass AS entity FROM closure WHERE subclass = 'Q1100' UNION SELECT 'Q1100'")
def ancestors(spark, d):
    return C.above(demo.type_edges(spark, d), "Q1100")


_SEEDS, _SMALL = "(SELECT 'Q1' || s_suppkey FROM supplier)", "(SELECT 'Q1' || p_partkey FROM part WHERE p_size <= 10)"


@query(with_("type_edges", "closure") + f" SELECT DISTINCT superclass AS entity FROM closure WHERE subclass IN {_SMALL} AND superclass NOT IN {_SMALL}")
def closure_outside(spark, d):
    """Classes above the small parts that are not small parts."""
    seeds = table(spark, d, "part").filter("p_size <= 10").select(demo.qid(demo.PART, "p_partkey").alias("item"))
    return C.outside(demo.type_edges(spark, d), seeds)


@query(with_("type_edges", "closure") + f" SELECT subclass AS item, superclass, row_number() OVER (PARTITION BY subclass ORDER BY superclass) AS place FROM closure WHERE subclass IN {_SEEDS} ORDER BY 1, 2")
def closure_ordered(spark, d):
    """Superclasses of items in order, each with its place."""
    seeds = table(spark, d, "supplier").select(demo.qid(demo.PART, "s_suppkey").alias("item"))
    return C.ordered(C.closure(demo.type_edges(spark, d), seeds))


_SETS = """, places AS (SELECT subclass AS entity FROM closure WHERE superclass = 'Q12' UNION SELECT 'Q12' EXCEPT (SELECT subclass FROM closure WHERE superclass IN ('Q19', 'Q110') UNION SELECT unnest(['Q19', 'Q110']))),
orgs AS (SELECT subclass AS entity FROM closure WHERE superclass = 'Q13' UNION SELECT 'Q13' EXCEPT (SELECT subclass FROM closure WHERE superclass = 'Q114' UNION SELECT 'Q114'))"""


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = C.under(demo.type_edges(spark, d), ["Q12", "Q19", "Q110", "Q13", "Q114"])
    return C.class_set(pairs, "Q12", ["Q19", "Q110"]), C.class_set(pairs, "Q13", ["Q114"])


@query(with_("type_edges", "closure") + _SETS + " SELECT entity FROM places")
def class_set_difference(spark, d):
    return _sets(spark, d)[0]


@query(with_("type_edges", "closure", "items") + " SELECT entity, type FROM items WHERE type IS NOT NULL UNION SELECT i.entity, c.superclass FROM items i JOIN closure c ON i.type = c.subclass")
def extended_types(spark, d):
    explicit = demo.items(spark, d).select("entity", F.explode("explicit_types").alias("type"))
    return C.extended_types(explicit, C.closure(demo.type_edges(spark, d)))


@query(
    with_("type_edges", "closure")
    + _SETS
    + """, claims AS (SELECT 'Q5' || l_orderkey AS entity, l_partkey AS pos, CASE WHEN l_partkey = 7 THEN 'PERS' WHEN p.entity IS NOT NULL THEN 'LOC' WHEN o.entity IS NOT NULL THEN 'ORG' ELSE 'OTHERS' END AS ner
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN places p ON p.entity = 'Q1' || l_partkey LEFT JOIN orgs o ON o.entity = 'Q1' || l_partkey)
SELECT entity, string_agg(ner, ' ' ORDER BY pos) AS ner_types FROM (SELECT entity, ner, min(pos) AS pos FROM claims GROUP BY 1, 2) GROUP BY 1"""
)
def ner_typing(spark, d):
    explicit = table(spark, d, "lineitem").select(demo.qid(demo.ORDER, "l_orderkey").alias("entity"), F.col("l_partkey").alias("pos"), demo.qid(demo.PART, "l_partkey").alias("type"))
    return dump.ner_types(explicit, *_sets(spark, d), human="Q17").select("entity", joined("ner_types"))


# Retrieval by ids


@query(with_("items") + " SELECT entity, type FROM items WHERE entity IN (SELECT 'Q2' || c_custkey FROM customer)")
def types_lookup(spark, d):
    return retrieve.types(demo.items(spark, d), table(spark, d, "customer").select(demo.qid(demo.CUSTOMER, "c_custkey").alias("entity")))


@query(with_("edges") + " SELECT subject, object, string_agg(predicate, ' ' ORDER BY predicate) AS predicates FROM edges WHERE subject IN (SELECT 'Q5' || l_orderkey FROM lineitem) GROUP BY 1, 2")
def objects_lookup(spark, d):
    return retrieve.objects(demo.edges(spark, d), entities(demo.instances(spark, d), "child")).select("subject", "object", joined("predicates"))


@query(with_("literals") + ' SELECT subject, datatype, predicate, string_agg(value, \' \' ORDER BY value) AS "values" FROM literals WHERE subject IN (SELECT \'Q2\' || o_custkey FROM orders) GROUP BY 1, 2, 3')
def literals_lookup(spark, d):
    ids = table(spark, d, "orders").select(demo.qid(demo.CUSTOMER, "o_custkey").alias("entity"))
    return retrieve.literals(demo.literals(spark, d), ids).select("subject", "datatype", "predicate", joined("values"))


@query(
    with_("edges")
    + ", pairs AS (SELECT 'Q2' || c_custkey AS s, 'Q4' || c_nationkey AS o FROM customer UNION SELECT 'Q4' || c_nationkey, 'Q2' || c_custkey FROM customer) SELECT s || ' ' || o AS pair, string_agg(predicate, ' ' ORDER BY predicate) AS predicates FROM pairs JOIN edges ON subject = s AND object = o GROUP BY 1"
)
def predicates_pairs(spark, d):
    c = table(spark, d, "customer").select(demo.qid(demo.CUSTOMER, "c_custkey").alias("a"), demo.qid(demo.NATION, "c_nationkey").alias("b"))
    pairs = c.select(F.array("a", "b").alias("pair")).union(c.select(F.array("b", "a")))
    return retrieve.predicates(demo.edges(spark, d), retrieve.checked_pairs(pairs)).select("pair", joined("predicates"))


@query(with_("edges") + " SELECT entity, CASE WHEN regexp_matches(entity, '^[QP][0-9]+$') THEN 'wikidata' ELSE 'dbpedia' END AS kg FROM (SELECT subject AS entity FROM edges UNION SELECT n_name FROM nation)")
def kg_recognise(spark, d):
    every = demo.edges(spark, d).select(F.col("subject").alias("entity")).union(table(spark, d, "nation").select("n_name"))
    return tables.dealt(every, "entity").distinct().select("entity", T.knowledge_graph(F.col("entity")).alias("kg"))


_LABELS = " SELECT entity, 'https://www.wikidata.org/wiki/' || entity AS url, kind, ner_type, {} AS label, {} AS aliases FROM items WHERE {}"


def _flat_labels(rows: DataFrame, lang: str) -> DataFrame:
    return rows.select("entity", "url", "kind", "ner_type", F.col("labels")[lang].alias("label"), F.array_join(F.coalesce(F.flatten(F.map_values("aliases")), F.array().cast("array<string>")), "|").alias("aliases"))


@query(with_("items") + _LABELS.format("upper(label)", "coalesce(alias || '|' || upper(label), '')", "true"))
def labels_lang(spark, d):
    items = demo.items(spark, d)
    return _flat_labels(retrieve.labels(items, entities(items, "entity"), "fr"), "fr")


@query(with_("items") + _LABELS.format("label", "coalesce(alias || '|' || upper(label), '')", "kind = 'type'"))
def labels_category(spark, d):
    items = demo.items(spark, d)
    return _flat_labels(retrieve.labels(items, entities(items, "entity"), None, "type"), "en")


@query(with_("items") + " SELECT entity, 'wikidata' AS site, 'https://www.wikidata.org/wiki/' || entity AS url FROM items WHERE entity IN (SELECT object FROM edges)".replace("edges", "(SELECT 'Q4' || c_nationkey AS object FROM customer UNION SELECT 'Q1' || l_partkey FROM lineitem)"))
def sameas(spark, d):
    asked = demo.instances(spark, d).select(F.col("parent").alias("entity")).union(table(spark, d, "customer").select(demo.qid(demo.NATION, "c_nationkey")))
    return retrieve.sameas(demo.items(spark, d), asked)


@query(with_("items") + " SELECT entity, CASE WHEN kind = 'type' THEN 'wikidata' ELSE '' END AS sites FROM items")
def sameas_lists(spark, d):
    """Lists of links of all entities, of which only types have any here: an entity without links has an empty list."""
    items = demo.items(spark, d).withColumn("urls", F.when(F.col("kind") == "type", F.col("urls")))
    return retrieve.sameas_lists(items, entities(items, "entity")).select("entity", F.array_join(F.transform("urls", lambda u: u["site"]), " ").alias("sites"))


@query(with_("items") + " SELECT entity, CAST(substr(entity, 2) AS BIGINT) AS number FROM items")
def numeric_ids(spark, d):
    return demo.items(spark, d).select("entity", T.numeric_id(F.col("entity")).alias("number"))


@query(with_("items") + " SELECT ner_type, count(*) AS entities FROM items GROUP BY 1")
def ner_counts(spark, d):
    return names.ner_counts(demo.items(spark, d))


def _summary_sql(source: str, order: str, where: str = "true") -> str:
    return with_(source) + f' SELECT subject AS entity, predicate, count(*) AS "count" FROM {source} WHERE {where} GROUP BY 1, 2 ORDER BY 3 {order}, 1, 2 LIMIT 10'


@query(_summary_sql("edges", "DESC"))
def summary_objects_desc(spark, d):
    return retrieve.summary(retrieve.summary_table(demo.edges(spark, d)))


@query(_summary_sql("edges", "ASC"))
def summary_objects_asc(spark, d):
    return retrieve.summary(retrieve.summary_table(demo.edges(spark, d)), rank_order="asc")


@query(_summary_sql("literals", "DESC", "subject IN ('Q21', 'Q22', 'Q51', 'Q52')"))
def summary_literals(spark, d):
    return retrieve.summary(retrieve.summary_table(demo.literals(spark, d)), ["Q21", "Q22", "Q51", "Q52"])


@query(_summary_sql("literals", "ASC"))
def summary_literals_all(spark, d):
    return retrieve.summary(retrieve.summary_table(demo.literals(spark, d)), rank_order="asc")


def _bag_sql(text: str) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
    return f"list_filter(list_distinct(regexp_split_to_array(lower(trim({text})), '[^\\p{{L}}\\p{{N}}]+')), lambda w: w <> '' AND NOT list_contains([{stop}], w))"


@query(f"SELECT doc_id, unnest({_bag_sql('text')}) AS word FROM documents")
def bow_tokens(spark, d):
    return retrieve.bags(table(spark, d, "documents"), "doc_id").select("doc_id", F.explode("words").alias("word"))


@query(
    f"WITH r AS (SELECT item_id AS row_id, {_bag_sql('text')} AS words FROM benchmark), c AS (SELECT doc_id AS entity, {_bag_sql('text')} AS bag FROM documents), p AS (SELECT DISTINCT l_suppkey AS row_id, l_partkey AS entity FROM lineitem) "
    "SELECT row_id, entity, round(CASE WHEN len(words) = 0 THEN 0 ELSE len(list_intersect(words, bag)) / len(words) END, 9) AS similarity, array_to_string(list_sort(list_intersect(words, bag)), ' ') AS matched FROM p JOIN r USING (row_id) JOIN c USING (entity)"
)
def bow_similarity(spark, d):
    """Documents and benchmark texts whose numbers meet as part and supplier of an order line."""
    texts, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("entity")).distinct()
    rows, bags = retrieve.bags(texts.withColumnRenamed("item_id", "row_id"), "row_id"), retrieve.bags(docs.withColumnRenamed("doc_id", "entity"), "entity")
    return retrieve.bow_similarity(rows, bags, pairs).select("row_id", "entity", F.round("similarity", 9).alias("similarity"), joined("matched"))


# The name index


@query(with_("items") + " SELECT max(popularity) AS max_popularity FROM items")
def max_popularity(spark, d):
    return names.max_popularity(demo.items(spark, d))


@query(with_("items") + " SELECT entity, popularity, round_even(popularity / (SELECT max(popularity) FROM items), 2) AS popularity_norm FROM items")
def popularity_norm(spark, d):
    return names.with_popularity_norm(demo.items(spark, d)).select("entity", "popularity", "popularity_norm")


@query(
    with_("items")
    + " SELECT entity, label AS name, 'en fr' AS languages, false AS is_alias FROM items UNION ALL SELECT entity, alias, 'en', true FROM items WHERE alias IS NOT NULL AND lower(alias) <> lower(label)"
)
def surface_forms(spark, d):
    return names.surface_forms(demo.items(spark, d)).select("entity", "name", joined("languages"), "is_alias")


@query(with_("items", "names") + " SELECT entity, name FROM names WHERE ner_type = 'PERS' AND is_alias")
def person_abbrev(spark, d):
    return names.person_forms(demo.items(spark, d)).select("entity", "name")


@query(with_("items") + " SELECT entity FROM items WHERE kind <> 'type'")
def anti_existing(spark, d):
    items = demo.items(spark, d)
    return names.not_indexed(items, names.surface_forms(items.filter("kind = 'type'"))).select("entity")


@query(with_("items", "names", "postings") + " SELECT term, p.entity, n.name, n.is_alias, tf, CAST(doc_len AS INTEGER) AS doc_len FROM postings p JOIN names n ON p.key = n.entity || chr(1) || n.name || chr(1) || n.is_alias")
def postings(spark, d):
    named = names.names(demo.items(spark, d))
    return names.postings(named).join(named.select("doc_id", "entity", "name", "is_alias"), "doc_id").select("term", "entity", "name", "is_alias", F.col("tf").cast("long").alias("tf"), "doc_len")


@query(with_("items", "names", "postings") + " SELECT term, count(*) AS df, CAST(length(term) AS INTEGER) AS term_len FROM postings GROUP BY 1")
def vocabulary(spark, d):
    return names.vocabulary(names.postings(names.names(demo.items(spark, d)))).select("term", "df", "term_len")


@query(with_("items", "names") + " SELECT count(*) AS n_docs, round(avg(len(string_split(lower(name), ' '))), 9) AS avg_len FROM names")
def corpus_stats(spark, d):
    return names.corpus_stats(names.names(demo.items(spark, d))).select("n_docs", F.round("avg_len", 9).alias("avg_len"))


# Lookup


#: The default of a lookup.
LIMIT = 1000
CLASSES = ["Q110", "Q111", "Q112", "Q125", "Q150", "Q199"]


def _lookup_sql(out: str, where: str = "true", score: str = "bm25", fuzzy: bool = False, mention: str = "p_name", limit: int = LIMIT) -> str:
    """Hits as ``ranked``, with features as ``featured``, one form an entity as ``best``; ``out`` selects from them."""
    plain = "terms AS (SELECT mention, token AS term, CAST(times AS DOUBLE) AS times FROM tokens)"
    near = """near AS (SELECT token, term, levenshtein(token, term) AS distance, CASE WHEN length(token) <= 2 THEN 0 WHEN length(token) <= 5 THEN 1 ELSE 2 END AS most
FROM (SELECT DISTINCT token FROM tokens) JOIN vocab ON abs(length(token) - length(term)) <= 2 WHERE distance <= most),
terms AS (SELECT mention, term, times * (1 - distance / greatest(length(token), length(term))) AS times FROM tokens JOIN near USING (token))"""
    grams = "list_distinct(flatten(list_transform(list_filter({}, lambda t: length(t) >= 3), lambda t: list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))))"
    return (
        with_("items", "names", "postings")
        + f""", stats AS (SELECT count(*) AS n_docs, avg(len(string_split(lower(name), ' '))) AS avg_len FROM names), vocab AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
mentions AS (SELECT DISTINCT {mention} AS mention FROM part),
tokens AS (SELECT mention, token, count(*) AS times FROM (SELECT mention, unnest(string_split(mention, ' ')) AS token FROM mentions) GROUP BY 1, 2),
{near if fuzzy else plain},
summed AS (SELECT mention, key, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) * {1.0 if fuzzy else 2.0}) AS bm25
FROM terms JOIN vocab USING (term) JOIN postings USING (term) CROSS JOIN stats GROUP BY 1, 2),
scored AS (SELECT s.mention, n.*, round({score}, 9) AS score FROM summed s JOIN names n ON s.key = n.entity || chr(1) || n.name || chr(1) || n.is_alias WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, popularity DESC, entity, name, is_alias) AS rank FROM scored QUALIFY rank <= {limit}),
placed AS (SELECT *, rank / count(*) OVER (PARTITION BY mention) AS pos_score, score / max(score) OVER (PARTITION BY mention) AS es_score FROM ranked),
parts AS (SELECT *, lower(name) AS clean_name, list_distinct(string_split(mention, ' ')) AS mw, list_distinct(string_split(lower(name), ' ')) AS nw FROM placed),
gram AS (SELECT *, {grams.format('mw')} AS mg, {grams.format('nw')} AS ng FROM parts),
featured AS (SELECT *, 1 - levenshtein(mention, clean_name) / greatest(length(mention), length(clean_name)) AS ed_score, len(list_intersect(mw, nw)) / greatest(len(mw), len(nw), 1) AS jaccard_score,
len(list_intersect(mg, ng)) / greatest(len(mg), len(ng), 1) AS jaccard_ngram_score FROM gram),
best AS (SELECT *, min(rank) OVER (PARTITION BY mention, entity) AS position FROM featured QUALIFY row_number() OVER (PARTITION BY mention, entity ORDER BY round(ed_score + jaccard_score, 9) DESC, rank) = 1),
firsts AS (SELECT mention, entity, arg_min(clean_name, rank) AS first_name FROM featured GROUP BY 1, 2),
amb AS (SELECT mention, avg(CASE WHEN first_name = mention THEN 1.0 ELSE 0 END) AS ambiguity_mention FROM firsts GROUP BY 1),
held AS (SELECT mention, list_distinct(flatten(list(nw))) AS words, any_value(mw) AS mw FROM featured GROUP BY 1),
cor AS (SELECT mention, len(list_intersect(mw, words)) / len(mw) AS corrects_tokens FROM held)
{out}"""
    )


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("mention_id"), F.col("p_name").alias("name")).distinct()


def _index(spark: SparkSession, d: str) -> lookup.Index:
    items = tables.written(demo.items(spark, d), "items")
    return lookup.stored(lookup.index(names.names(items), items))


def _hits(spark, d, fuzzy=False, filters=None, limit=LIMIT) -> tuple[DataFrame, DataFrame]:
    mentions = _mentions(spark, d)
    if fuzzy:
        mentions = mentions.select(F.replace("mention_id", F.lit("e"), F.lit("a")).alias("mention_id"), F.replace("name", F.lit("e"), F.lit("a")).alias("name")).distinct()
    cleaned = lookup.mentions_of(mentions)
    return cleaned, lookup.hits(cleaned, _index(spark, d), limit, fuzzy, filters)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_HIT_SQL = " SELECT mention AS mention_id, entity, name, is_alias, rank, round(score, 6) AS score FROM ranked"


def _flat_hits(ranked: DataFrame) -> DataFrame:
    return _rounded(ranked, "score").select("mention_id", "entity", "name", "is_alias", "rank", "score")


_CANDIDATE_SQL = """ SELECT b.mention AS mention_id, b.entity AS id, name, b.kind, b.ner_type, coalesce(b.type, '') AS types, round(ambiguity_mention, 6) AS ambiguity_mention, round(corrects_tokens, 6) AS corrects_tokens,
len(string_split(b.mention, ' ')) AS ntoken_mention, len(string_split(name, ' ')) AS ntoken_entity, length(b.mention) AS length_mention, length(name) AS length_entity,
round_even(b.popularity / (SELECT max(popularity) FROM items), 2) AS popularity, round(pos_score, 6) AS pos_score, round(es_score, 6) AS es_score, round(ed_score, 6) AS ed_score, round(jaccard_score, 6) AS jaccard_score,
round(jaccard_ngram_score, 6) AS jaccard_ngram_score, position FROM best b JOIN amb USING (mention) JOIN cor USING (mention)"""


@query(_lookup_sql(_CANDIDATE_SQL))
def lookup_exact(spark, d):
    """Candidates of every distinct part name, with all features."""
    rows = lookup.lookup(_mentions(spark, d), _index(spark, d), LIMIT)
    flat = rows.withColumn("types", joined("explicit_types")).drop("explicit_types", "extended_types", "description")
    return _rounded(flat, "ambiguity_mention", "corrects_tokens", "pos_score", "es_score", "ed_score", "jaccard_score", "jaccard_ngram_score")


@query(_lookup_sql(_HIT_SQL, fuzzy=True, mention="replace(p_name, 'e', 'a')"))
def lookup_fuzzy(spark, d):
    return _flat_hits(_hits(spark, d, fuzzy=True)[1])


@query(_lookup_sql(_HIT_SQL, where=f"kind = 'type' AND ner_type IN ('OTHERS', 'LOC') AND list_contains(string_split(languages, ' '), 'en') AND list_contains({CLASSES}, type)"))
def lookup_hard_filters(spark, d):
    return _flat_hits(_hits(spark, d, filters=lookup.Filters(kind="type", ner_types=["OTHERS", "LOC"], types=CLASSES, extended_types=CLASSES, language="en"))[1])


@query(_lookup_sql(_HIT_SQL, score=f"CASE WHEN list_contains({CLASSES}, type) THEN bm25 + 2.0 + 1.5 + 1.2 ELSE (bm25 + 2.0) * 0.1 * 0.2 END"))
def lookup_soft(spark, d):
    return _flat_hits(_hits(spark, d, filters=lookup.Filters(ner_types=["OTHERS"], types=CLASSES, extended_types=CLASSES, soft=True))[1])


@query(_lookup_sql(" SELECT mention AS mention_id, entity, name, is_alias, rank, round(pos_score, 6) AS pos_score, round(es_score, 6) AS es_score FROM placed", limit=5))
def lookup_topk(spark, d):
    return _rounded(_hits(spark, d, limit=5)[1], "pos_score", "es_score").select("mention_id", "entity", "name", "is_alias", "rank", "pos_score", "es_score")


_FEATURES = ["ed_score", "jaccard_score", "jaccard_ngram_score"]


@query(_lookup_sql(" SELECT mention AS mention_id, entity, name, is_alias, rank, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURES) + " FROM featured"))
def lookup_features(spark, d):
    return _rounded(lookup.features(*_hits(spark, d)), *_FEATURES).select("mention_id", "entity", "name", "is_alias", "rank", *_FEATURES)


@query(_lookup_sql(" SELECT mention AS mention_id, entity, name, is_alias, rank, position FROM best"))
def lookup_dedup(spark, d):
    return lookup.best_forms(lookup.features(*_hits(spark, d))).select("mention_id", "entity", "name", "is_alias", "rank", "position")


@query(_lookup_sql(" SELECT mention AS mention_id, entity, coalesce(b.type, '') AS type_id, coalesce(t.label, b.type, '') AS type_name FROM best b LEFT JOIN (SELECT entity AS e, label FROM items WHERE kind = 'type') t ON t.e = b.type"))
def lookup_type_labels(spark, d):
    cleaned, ix = lookup.mentions_of(_mentions(spark, d)), _index(spark, d)
    rows = lookup.with_type_labels(lookup.best_forms(lookup.features(cleaned, lookup.hits(cleaned, ix, LIMIT))), ix.type_labels)
    return rows.select("mention_id", "entity", F.array_join(F.transform("types", lambda t: t["id"]), " ").alias("type_id"), F.array_join(F.transform("types", lambda t: t["name"]), " ").alias("type_name"))


_FORCED = """ SELECT mention AS mention_id, entity AS id, name, round(pos_score, 6) AS pos_score, round(es_score, 6) AS es_score, round(ed_score, 6) AS ed_score FROM best
UNION ALL SELECT mention, entity, label, 1.0, 1.0, round(1 - levenshtein(mention, lower(label)) / greatest(length(mention), length(label)), 6) FROM items CROSS JOIN mentions WHERE entity = 'Q61' AND (mention, entity) NOT IN (SELECT (mention, entity) FROM best)"""


@query(_lookup_sql(_FORCED))
def lookup_forced_ids(spark, d):
    mentions = _mentions(spark, d)
    wanted = mentions.select("mention_id", F.lit("Q61").alias("entity"))
    return _rounded(lookup.lookup(mentions, _index(spark, d), LIMIT, wanted=wanted), "pos_score", "es_score", "ed_score").select("mention_id", "id", "name", "pos_score", "es_score", "ed_score")


@query(_lookup_sql(_HIT_SQL, where="popularity > 10 AND is_alias"))
def lookup_raw_condition(spark, d):
    cleaned = lookup.mentions_of(_mentions(spark, d))
    return _flat_hits(lookup.hits(cleaned, _index(spark, d), LIMIT, where="popularity > 10 AND is_alias"))


@query(_lookup_sql(" SELECT mention AS mention_id, round(ambiguity_mention, 6) AS ambiguity_mention, round(corrects_tokens, 6) AS corrects_tokens FROM amb JOIN cor USING (mention)"))
def ambiguity(spark, d):
    return _rounded(lookup.ambiguity(*_hits(spark, d)), "ambiguity_mention", "corrects_tokens")


# Classification


_TOKENS = """tokens AS (SELECT DISTINCT literal FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS literal FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT CAST(l_partkey AS VARCHAR) FROM lineitem
UNION ALL SELECT CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) FROM lineitem UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT strftime(ts, '%Y-%m-%dT%H:%M') FROM events UNION ALL SELECT strftime(ts, '%H:%M') FROM events))"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    line, events = table(spark, d, "lineitem"), table(spark, d, "events")
    parts = [
        table(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("literal")), table(spark, d, "pages").select("url"), line.select(F.col("l_partkey").cast("string")),
        line.select(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")), table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd")),
        events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")), events.select(F.date_format("ts", "HH:mm")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.distinct()


def _class_sql(column: str) -> str:
    quoted = {name: pattern.replace("'", "''") for name, pattern in L.PATTERNS.items()}
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{n}'" for n, p in quoted.items()) + " ELSE 'STRING' END"


def _described_sql(column: str, field: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v[field]}'" for k, v in L.CLASSES.items()) + " END"


@query(f"WITH {_TOKENS} SELECT literal, {_class_sql('literal')} AS datatype FROM tokens")
def literal_classify(spark, d):
    return _tokens(spark, d).select("literal", L.literal_class(F.col("literal")).alias("datatype"))


@query(f"WITH {_TOKENS}, c AS (SELECT literal, {_class_sql('literal')} AS datatype FROM tokens) SELECT literal, datatype, {_described_sql('datatype', 0)} AS classification, {_described_sql('datatype', 1)} AS tag, {_described_sql('datatype', 2)} AS xml_datatype FROM c")
def literal_datatypes(spark, d):
    return classify.literals(_tokens(spark, d))


def _value_sql(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '{L.ISO}') THEN 'DATETIME' WHEN regexp_matches({column}, '{L.NUMBER}') THEN 'NUMBER' ELSE 'STRING' END"


@query(f"WITH {_TOKENS} SELECT literal, {_value_sql('literal')} AS datatype FROM tokens")
def value_typing(spark, d):
    return _tokens(spark, d).select("literal", L.value_type(F.col("literal")).alias("datatype"))


_CELLS = """cells AS (SELECT 'customer' AS table_id, unnest(['id', 'name', 'balance', 'segment', 'empty']) AS col_id, unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR), c_mktsegment, '']) AS value FROM customer
UNION ALL SELECT 'orders', unnest(['id', 'status', 'date']), unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y-%m-%d')]) FROM orders)"""


@query(
    f"""WITH {_CELLS}, votes AS (SELECT table_id, col_id, CASE WHEN trim(value) = '' THEN NULL ELSE replace({_described_sql(_class_sql('value').join('()'), 0)}, 'DATETIME', 'DATE') END AS vote FROM cells),
n AS (SELECT table_id, col_id, vote, count(*) AS n FROM votes GROUP BY 1, 2, 3), b AS (SELECT table_id, col_id, arg_max(vote, n) FILTER (vote IS NOT NULL) AS vote, max(n) FILTER (vote IS NOT NULL) AS n, sum(n) FILTER (vote IS NOT NULL) AS total FROM n GROUP BY 1, 2)
SELECT table_id, col_id, coalesce(vote, 'UNKNOWN') AS classification, CASE WHEN vote IS NULL THEN 'UNKNOWN' ELSE 'LIT' END AS tag, coalesce(vote, 'UNKNOWN') AS datatype, round(coalesce(n / total, 0), 9) AS probability FROM b"""
)
def column_analysis(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    customer = c.select(F.lit("customer").alias("table_id"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("").alias("empty"))
    orders = o.select(F.lit("orders").alias("table_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    cells = customer.unpivot("table_id", customer.columns[1:], "col_id", "value").union(orders.unpivot("table_id", orders.columns[1:], "col_id", "value"))
    return classify.columns(cells).withColumn("probability", F.round("probability", 9))


_MENTION = classify.CAPITALISED.replace("'", "''")
# Mentions and what stands before each, whose lengths add up to offsets.
_MENTIONS_SQL = """WITH RECURSIVE m AS (SELECT id, regexp_extract_all(text, '{0}') AS ms, string_split_regex(text, '{0}') AS ps FROM ({1})),
u AS (SELECT id, unnest(ms) AS mention, unnest(ps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
found AS (SELECT id AS text_id, mention, CAST(sum(length(gap) + length(mention)) OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS "end" FROM u)"""


@query(_MENTIONS_SQL.format(_MENTION, "SELECT doc_id AS id, text FROM documents") + """ SELECT text_id, mention, 'OTHER' AS label, CAST("end" - length(mention) AS INTEGER) AS start, "end" FROM found""")
def entity_recognition(spark, d):
    return classify.recognise(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


_KNOWN_SQL = "known AS (SELECT lower(name) AS key, CASE arg_max(ner_type, popularity) WHEN 'PERS' THEN 'PERSON' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'LOC' THEN 'LOCATION' ELSE 'OTHER' END AS label FROM names GROUP BY 1)"


@query(
    _MENTIONS_SQL.format(_MENTION, "SELECT n_nationkey AS id, 'Goods of ' || r_name || ' pass ' || r_name || ', then Port ' || n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
    + ", " + ", ".join(demo.SQL[x] for x in ("items", "names")) + f""", {_KNOWN_SQL} SELECT text_id, mention, coalesce(label, 'OTHER') AS label, CAST("end" - length(mention) AS INTEGER) AS start, "end" FROM found LEFT JOIN known ON key = lower(mention)"""
)
def entity_recognition_known(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    texts = both.select(F.col("n_nationkey").cast("long").alias("text_id"), F.concat(F.lit("Goods of "), "r_name", F.lit(" pass "), "r_name", F.lit(", then Port "), "n_name").alias("text"))
    return classify.recognise_known(texts, classify.gazetteer(names.names(demo.items(spark, d))))


_NAMED = "SELECT 'customer' AS col_id, c_name AS value FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'part', p_name FROM part UNION ALL SELECT 'segment', c_mktsegment FROM customer"


@query(
    with_("items", "names")
    + f""", {_KNOWN_SQL}, cells AS ({_NAMED}), n AS (SELECT col_id, coalesce(label, 'STRING') AS vote, count(*) AS n FROM cells LEFT JOIN known ON key = lower(value) GROUP BY 1, 2)
SELECT 'all' AS table_id, col_id, arg_max(vote, n) AS classification, CASE WHEN arg_max(vote, n) = 'STRING' THEN 'LIT' ELSE 'NE' END AS tag, arg_max(vote, n) AS datatype, round(max(n) / sum(n), 9) AS probability FROM n GROUP BY col_id"""
)
def column_entities(spark, d):
    """Columns of names of known entities."""
    cells = None
    for col_id, name, column in (("customer", "customer", "c_name"), ("supplier", "supplier", "s_name"), ("nation", "nation", "n_name"), ("part", "part", "p_name"), ("segment", "customer", "c_mktsegment")):
        one = table(spark, d, name).select(F.lit("all").alias("table_id"), F.lit(col_id).alias("col_id"), F.col(column).alias("value"))
        cells = one if cells is None else cells.union(one)
    return classify.columns(cells, classify.gazetteer(names.names(demo.items(spark, d)))).withColumn("probability", F.round("probability", 9))


# Loading


_CSV = """extra AS (SELECT 'c' || l_suppkey AS permalink, 'about ' || l_suppkey AS description, count(*) AS rank FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def _company_csv(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier")
    main = s.select(F.concat(F.lit("c"), "s_suppkey").alias("permalink"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("balance"), F.lit("2020-01-02").alias("founded"))
    extra = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("rank"))
    return main, extra.select(F.concat(F.lit("c"), "l_suppkey").alias("permalink"), F.concat(F.lit("about "), "l_suppkey").alias("description"), "rank")


@query(f"WITH {_CSV} SELECT 'c' || s_suppkey AS entity, coalesce(description, '') AS description, coalesce(rank, 0) AS popularity, s_name AS label, 'ORG' AS ner_type FROM supplier LEFT JOIN extra ON permalink = 'c' || s_suppkey")
def csv_enrich(spark, d):
    main, extra = _company_csv(spark, d)
    return company_csv.items(main, company_csv.latest_extra(extra, "rank")).select("entity", "description", "popularity", F.col("labels")["en"].alias("label"), "ner_type")


@query("SELECT 'c' || s_suppkey AS subject, 'balance' AS predicate, 'NUMBER' AS datatype, CAST(CAST(s_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS value FROM supplier UNION ALL SELECT 'c' || s_suppkey, 'founded', 'DATETIME', '2020-01-02' FROM supplier")
def csv_literals(spark, d):
    return company_csv.literals(_company_csv(spark, d)[0]).drop("pos")


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """Customers and parts as lines of a dump, between the brackets of its array."""
    target = lambda q: F.to_json(F.struct(q.alias("id")))
    claim = lambda p, kind, v: F.struct(F.struct(F.lit(p).alias("property"), F.lit(kind).alias("datatype"), F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak"))
    said = lambda v: F.create_map(F.lit("en"), F.struct(F.lit("en").alias("language"), v.alias("value")))

    def line(df, entity, label, claims, sites):
        columns = {"id": entity, "type": F.lit("item"), "labels": said(label), "descriptions": said(F.concat(F.lit("about "), label)), "claims": claims, "sitelinks": sites}
        return df.select(F.concat(F.to_json(F.struct(*[v.alias(k) for k, v in columns.items()])), F.lit(",")).alias("value"))

    # The text of a value is JSON itself, as a claim's value is an object; to_json would quote it, so its quotes are undone.
    site = lambda title: F.create_map(F.lit("enwiki"), F.struct(F.lit("enwiki").alias("site"), title.alias("title")))
    none = F.create_map().cast("map<string,struct<site:string,title:string>>")
    amount = lambda v: F.to_json(F.struct(v.alias("amount")))
    # A small file is one task's, whatever its rows cost: they are dealt before lines are made of them.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    c = line(table(spark, d, "customer").repartition(parts, "c_custkey"), demo.qid(demo.CUSTOMER, "c_custkey"), F.col("c_name"), F.create_map(F.lit("P31"), F.array(claim("P31", "wikibase-item", target(demo.qid(demo.NATION, "c_nationkey")))), F.lit("P10"), F.array(claim("P10", "quantity", amount(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))))), none)
    p = line(table(spark, d, "part").repartition(parts, "p_partkey"), demo.qid(demo.PART, "p_partkey"), F.col("p_name"), F.create_map(F.lit("P279"), F.array(claim("P279", "wikibase-item", target(demo.qid(demo.PART, F.expr("p_partkey div 2")))))), site(F.col("p_name")))
    brackets = spark.createDataFrame([("[",), ("]",), ("{broken,",)], "value string")
    # By a generator, so that conditions on lines are not drawn below the dealing, where each would make the lines again.
    text = c.union(p).select(F.explode(F.array(F.replace(F.regexp_replace("value", r'"value":"(\{.*?\})"', '"value":$1'), F.lit('\\"'), F.lit('"')))).alias("value"))
    return dump.parsed(brackets.union(text))


@query(
    "SELECT 'Q2' || c_custkey AS entity, 'entity' AS kind, 'about ' || c_name AS description, 1 AS popularity, c_name AS label, 'Q4' || c_nationkey AS explicit_types, '' AS wikipedia FROM customer "
    "UNION ALL SELECT 'Q1' || p_partkey, 'type', 'about ' || p_name, 1, p_name, 'Q1' || (p_partkey // 2), 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') FROM part"
)
def dump_items(spark, d):
    return dump.items(_dump(spark, d)).select("entity", "kind", "description", "popularity", F.col("labels")["en"].alias("label"), joined("explicit_types"), F.col("urls")["wikipedia"].alias("wikipedia"))


@query("SELECT 'Q2' || c_custkey AS subject, 'P31' AS predicate, 'Q4' || c_nationkey AS object FROM customer UNION ALL SELECT 'Q1' || p_partkey, 'P279', 'Q1' || (p_partkey // 2) FROM part")
def dump_edges(spark, d):
    return dump.edges(_dump(spark, d)).drop("pos")


@query("SELECT 'Q2' || c_custkey AS subject, 'P10' AS predicate, 'NUMBER' AS datatype, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS value FROM customer")
def dump_literals(spark, d):
    return dump.literals(_dump(spark, d)).drop("pos")


@query("SELECT 'Q2' || c_custkey AS child, 'Q4' || c_nationkey AS parent, 'P31' AS property FROM customer UNION ALL SELECT 'Q1' || p_partkey, 'Q1' || (p_partkey // 2), 'P279' FROM part")
def dump_type_edges(spark, d):
    return dump.type_edges(_dump(spark, d))


@query("SELECT DISTINCT 'Q5' || l_orderkey AS child, 'Q1' || l_partkey AS parent FROM lineitem")
def edge_dedup(spark, d):
    return table(spark, d, "lineitem").select(demo.qid(demo.ORDER, "l_orderkey").alias("child"), demo.qid(demo.PART, "l_partkey").alias("parent")).dropDuplicates()


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def keep_latest(spark, d):
    return names.keep_latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicated_keys(spark, d):
    return names.duplicated(table(spark, d, "lineitem"), "l_orderkey")


_DATABASES = [("kgdemo01012024", "DONE"), ("kgdemo15062024", "DONE"), ("kgdemo31122024", "DOING"), ("other05052020", "DONE")]


@query("SELECT * FROM (VALUES ('kgdemo', 'kgdemo15062024', DATE '2024-06-15'), ('other', 'other05052020', DATE '2020-05-05')) t(kg, name, date)")
def snapshot_latest(spark, d):
    return snapshots.resolved(spark.createDataFrame(_DATABASES, "name string, status string"))


# Dumps and snapshots as files


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of this run in the shared folder, removed when the session's JVM ends."""
    path = f"{tables.shared_dir(spark)}/kgspark/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: A claim of each datatype, as JSON around the supplier's key, with what its literal is (None: none).
_CLAIMS = [
    ("P20", "external-id", '"x{}"', "STRING", "x{}"), ("P21", "quantity", '{"amount":"+{}"}', "NUMBER", "+{}"), ("P22", "globe-coordinate", '{"latitude":{}.5,"longitude":-1.25}', "STRING", "{}.5,-1.25"), ("P23", "string", '"s {}"', "STRING", "s {}"),
    ("P24", "monolingualtext", '{"language":"en","text":"t {}"}', "STRING", "t {}"), ("P25", "commonsMedia", '"{}.png"', "STRING", "{}.png"), ("P26", "time", '{"time":"+2001-01-01T00:00:0{}Z"}', "DATETIME", "+2001-01-01T00:00:0{}Z"), ("P27", "url", '"http://example.org/{}"', "STRING", "http://example.org/{}"),
    ("P28", "geo-shape", '"Data:{}.map"', "GEOSHAPE", "Data:{}.map"), ("P29", "math", '"x_{}"', "MATH", "x_{}"), ("P30", "musical-notation", '"c{}"', "MUSICAL_NOTATION", "c{}"), ("P31", "wikibase-item", '{"id":"Q63"}', None, None),
    ("P32", "tabular-data", '"Data:{}.tab"', "TABULAR_DATA", "Data:{}.tab"), ("P33", "wikibase-lexeme", '{"id":"L{}"}', None, None), ("P34", "wikibase-property", '{"id":"P{}"}', None, None),
]


def _dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """(at, value): suppliers with a claim of each datatype, nations as disambiguations, regions as properties, a line that is broken."""
    claims = ",".join(f'"{p}":[{{"mainsnak":{{"property":"{p}","datatype":"{kind}","datavalue":{{"value":{value}}}}}}}]' for p, kind, value, _, _ in _CLAIMS)
    said = lambda name: F.concat(F.lit('"labels":{"en":{"language":"en","value":"'), name, F.lit('"}},"aliases":{"en":[{"language":"en","value":"'), F.lower(name), F.lit('"},{"language":"en","value":"'), F.lower(name), F.lit('"}]},'))
    line = lambda key, name, body: F.concat(F.lit('{"id":"'), key, F.lit('",'), said(name), F.lit('"claims":{'), body, F.lit("}},"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("at"), line(demo.qid(demo.SUPPLIER, "s_suppkey"), F.col("s_name"), F.replace(F.lit(claims), F.lit("{}"), F.col("s_suppkey").cast("string"))).alias("value"))
    of_kind = F.lit('"P31":[{"mainsnak":{"property":"P31","datatype":"wikibase-item","datavalue":{"value":{"id":"Q4167410"}}}}]')
    nation = table(spark, d, "nation").select((F.col("n_nationkey") - 1000).cast("long").alias("at"), line(demo.qid(demo.NATION, "n_nationkey"), F.col("n_name"), of_kind).alias("value"))
    region = table(spark, d, "region").select((F.col("r_regionkey") - 2000).cast("long").alias("at"), line(F.concat(F.lit("P9"), F.col("r_regionkey").cast("string")), F.col("r_name"), F.lit("")).alias("value"))
    edge = spark.createDataFrame([(-3000, "["), (-2999, '{"id":"Q77","labels":{broken},}'), (2**40, "]")], "at long, value string")
    return edge.union(region).union(nation).union(supplier)


def _dump_files(spark: SparkSession, d: str) -> str:
    """A folder of compressed files whose names and lines are in the order of ``at``."""
    path = _scratch(spark, "dump")
    _dump_lines(spark, d).repartitionByRange(4, "at").sortWithinPartitions("at").select("value").write.option("compression", "bzip2").text(path)
    return path


_KINDS = "(SELECT 'Q3' || s_suppkey AS entity, 'entity' AS kind, s_name AS label, lower(s_name) AS aliases FROM supplier UNION ALL SELECT 'Q4' || n_nationkey, 'disambiguation', n_name, lower(n_name) FROM nation UNION ALL SELECT 'P9' || r_regionkey, 'predicate', r_name, lower(r_name) FROM region)"
_ALL_LITERALS = " UNION ALL ".join(f"SELECT 'Q3' || s_suppkey AS subject, '{p}' AS predicate, '{bucket}' AS datatype, replace('{said}', '{{}}', CAST(s_suppkey AS VARCHAR)) AS value FROM supplier" for p, _, _, bucket, said in _CLAIMS if bucket)


def _kinds(entities: DataFrame) -> DataFrame:
    return dump.items(entities).select("entity", "kind", F.col("labels")["en"].alias("label"), F.array_join(F.col("aliases")["en"], "|").alias("aliases"))


@query(f"SELECT * FROM {_KINDS}")
def dump_file_kinds(spark, d):
    return _kinds(dump.parsed(dump.lines(spark, _dump_files(spark, d)), prefix=None))


@query(_ALL_LITERALS)
def dump_file_datatypes(spark, d):
    return dump.literals(dump.parsed(dump.lines(spark, _dump_files(spark, d)))).drop("pos")


@query("SELECT 'Q3' || s_suppkey AS entity FROM supplier QUALIFY row_number() OVER (ORDER BY s_suppkey) > 3")
def dump_skip_lines(spark, d):
    ahead = table(spark, d, "nation").count() + table(spark, d, "region").count() + 2
    return dump.parsed(dump.skipped(spark, _dump_files(spark, d), ahead + 3)).select(F.col("id").alias("entity"))


@query("SELECT 'Q3' || s_suppkey AS entity FROM supplier WHERE s_suppkey >= 5")
def dump_resume(spark, d):
    return dump.parsed(dump.resumed(spark, _dump_files(spark, d), "Q35")).select(F.col("id").alias("entity"))


@query(f"SELECT * FROM {_KINDS} WHERE kind <> 'predicate'")
def dump_pipe(spark, d):
    rows = _dump_lines(spark, d).select("value").toLocalIterator(prefetchPartitions=True)  # stands for a pipe
    return _kinds(dump.parsed(dump.piped(spark, (r.value + "\n" for r in rows))))


@query(
    "SELECT s + n + r + 3 AS lines, s + n + r AS entities, 1 AS errors, 2 * s + n AS edges, "
    f"{sum(bool(c[3]) for c in _CLAIMS)} * s AS literals FROM (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r)"
)
def dump_counters(spark, d):
    return dump.counters(dump.lines(spark, _dump_files(spark, d))).drop("mean_size")


@query("SELECT 'Q3' || s_suppkey AS entity FROM supplier WHERE 'Q3' || s_suppkey NOT IN (SELECT 'Q3' || r_regionkey FROM region)")
def dump_skip_known(spark, d):
    known = table(spark, d, "region").select(demo.qid(demo.SUPPLIER, "r_regionkey").alias("id"))
    entities = dump.parsed(dump.lines(spark, _dump_files(spark, d))).filter(F.col("id").startswith("Q3"))
    return dump.without_known(entities, known, "id").select(F.col("id").alias("entity"))


@query(f"SELECT * FROM {_KINDS} WHERE kind <> 'predicate'")
def dump_stream(spark, d):
    """The files of a dump as a stream that stops when all have been read."""
    out, checkpoint = _scratch(spark, "streamed"), _scratch(spark, "stream-checkpoint")
    ingest.follow(spark, _dump_files(spark, d), out, checkpoint, files_at_once=2).awaitTermination()
    read = spark.read.parquet(f"{out}/items")
    return read.select("entity", "kind", F.col("labels")["en"].alias("label"), F.array_join(F.col("aliases")["en"], "|").alias("aliases"))


@query(with_("instances") + " SELECT child, parent FROM instances")
def edges_file(spark, d):
    path = _scratch(spark, "edges")
    once = demo.instances(spark, d)
    edges_tsv.write(once, path)
    edges_tsv.write(once.filter("parent LIKE 'Q11%'"), path, "append")  # what is added again counts once
    return edges_tsv.read(spark, path)


@query(with_("edges") + " SELECT subject, predicate, object FROM edges")
def snapshot_newest(spark, d):
    """Written twice, under two dates; the newest is read."""
    root, edges = _scratch(spark, "snapshots"), demo.edges(spark, d)
    snapshots.write({"edges": edges.filter("predicate = 'P1'")}, root, "demo", "20240101")
    snapshots.write({"edges": edges}, root, "demo", "20240201")
    return snapshots.read(spark, root, "demo", "edges").select("subject", "predicate", "object")


@query(
    f"SELECT entity, kind, label, term, CAST(df AS BIGINT) AS df FROM {_KINDS} CROSS JOIN LATERAL (SELECT unnest(list_distinct(string_split(lower(label), ' '))) AS term) "
    f"JOIN (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(string_split(lower(label), ' '))) AS term FROM {_KINDS} WHERE kind <> 'predicate') GROUP BY 1) USING (term) WHERE kind <> 'predicate'"
)
def snapshot_extended(spark, d):
    """A snapshot of the first lines, extended by all lines, twice: every name is indexed once."""
    root, lines = _scratch(spark, "extended"), _dump_lines(spark, d)
    engine.build(lines.filter("at < 4").select("value"), root, "demo", "20240101")
    for date in ("20240201", "20240301"):
        engine.extend(lines.select("value"), root, "demo", date)
    graph = engine.KnowledgeGraph(spark, root, "demo")
    label = graph.table("items").select("entity", "kind", F.col("labels")["en"].alias("label"))
    posted = graph.table("postings").join(graph.table("names").select("doc_id", "entity"), "doc_id").join(graph.table("vocabulary"), "term")
    return label.join(posted.select("entity", "term", "df"), "entity")


@query(with_("type_edges", "closure") + " SELECT subclass, superclass FROM closure")
def closure_stored(spark, d):
    """From the stored table, since there is one."""
    path, edges = _scratch(spark, "closure"), demo.type_edges(spark, d)
    C.stored_or_computed(edges, path).write.parquet(path)
    return C.stored_or_computed(edges, path).select("subclass", "superclass")


@query("SELECT * FROM (VALUES ('kgdemo01012024', 'kgdemo'), ('kgdemo15062024', 'kgdemo'), ('kgdemo31122024', 'kgdemo'), ('other05052020', 'other')) t(name, index_name)")
def index_names(spark, d):
    return spark.createDataFrame(_DATABASES, "name string, status string").select("name", snapshots.index_name(F.col("name")).alias("index_name"))


@query(_lookup_sql(" SELECT mention AS mention_id, entity, name, is_alias, rank, round(score, 6) AS es_score, CAST(popularity AS DOUBLE) AS popularity FROM ranked", mention="p_name"))
def lookup_raw_scores(spark, d):
    """Scores and popularity as they are, not as shares of the largest."""
    cleaned = lookup.mentions_of(_mentions(spark, d))
    ranked = lookup.hits(cleaned, _index(spark, d), LIMIT, normalize=False)
    return _rounded(ranked, "es_score").select("mention_id", "entity", "name", "is_alias", "rank", "es_score", F.col("popularity_out").alias("popularity"))
