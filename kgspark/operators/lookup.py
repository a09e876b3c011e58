"""Entity lookup for a batch of mentions: one lazy plan from mentions to feature rows.

Scores are BM25 (k1 1.2, b 0.75, statistics of the whole index).  The postings of the mentions' words are dealt by name and
meet the mentions there; scores are summed by (mention, name), and the best ``limit`` names of each mention are kept, in
each task and then of all, so that the pairs themselves are not shuffled.  Ties go to the more popular name, then by entity, name and kind of name, on scores rounded to nine digits, so that ranks do not hang on the order of
summation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import names as N
from kgspark.plans.tables import shares, written

K1, B = 1.2, 0.75
# Boosts and penalties of clauses.
EXACT_BOOST, NER_BOOST, TYPE_BOOST, EXTENDED_BOOST = 2.0, 2.0, 1.5, 1.2
TYPE_PENALTY, EXTENDED_PENALTY = 0.1, 0.2
# Bytes of the postings' files whose names one task ranks: more where there are tasks enough, so that few of the best are sent.
PAIRED_AT_ONCE, PAIRED_AT_LEAST = 2 << 20, 128 << 10


@dataclass
class Index:
    """The tables that lookup reads; build with ``index`` and write them, postings and vocabulary by term."""

    names: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    type_labels: DataFrame | None = None


@dataclass
class Filters:
    kind: str | None = None
    ner_types: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    extended_types: list[str] = field(default_factory=list)
    language: str | None = None
    soft: bool = False


def index(named: DataFrame, items: DataFrame | None = None) -> Index:
    posted = N.postings(named)
    labels = None
    if items is not None:
        labels = items.filter(F.col("kind") == "type").select(F.col("entity").alias("type_id"), F.col("labels")["en"].alias("type_name"), F.lit(True).alias("known"))
    return Index(named, posted, N.vocabulary(posted), N.corpus_stats(named), labels)


def stored(ix: Index) -> Index:
    """The index as written tables: built once, whatever a query reads of it and how often."""
    named, posted = written(ix.names, "names"), written(ix.postings, "postings")
    return Index(named, posted, written(N.vocabulary(posted), "vocabulary"), written(N.corpus_stats(named), "stats"), ix.type_labels)


def mentions_of(mentions: DataFrame) -> DataFrame:
    """(mention_id, mention, ntoken_mention, length_mention) of (mention_id, name), cleaned."""
    cleaned = mentions.select("mention_id", T.clean(F.col("name")).alias("mention"))
    return cleaned.withColumns({"ntoken_mention": F.size(T.tokens(F.col("mention"))).cast("long"), "length_mention": F.length("mention").cast("long")})


def _terms(cleaned: DataFrame) -> DataFrame:
    """Words of the mentions; a word that is repeated counts each time."""
    return cleaned.select("mention_id", F.explode(T.analysed(F.col("mention"))).alias("token")).groupBy("mention_id", "token").agg(F.count("*").alias("times"))


def edits_allowed(length: Column) -> Column:
    """Of a word: none up to two letters, one up to five, else two."""
    return F.when(length <= 2, 0).when(length <= 5, 1).otherwise(2)


def deletions(word: Column, most: Column) -> Column:
    """The word and what is left of it after leaving out up to ``most`` (0 to 2) letters."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    first = F.when((most >= 1) & (F.length(word) > 0), once(word)).otherwise(F.array().cast("array<string>"))
    second = F.when(most >= 2, F.flatten(F.transform(first, lambda w: F.when(F.length(w) > 0, once(w)).otherwise(F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), first, second))


def fuzzy_terms(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term, distance) within the edits that the token's length allows.

    Two words within k edits share a string that either reaches by leaving out at most k letters; those strings are the
    join keys, so that no token is compared with the whole vocabulary.  Distances are then computed.
    """
    asked = tokens.select("token").distinct().withColumn("most", edits_allowed(F.length("token")))
    left = asked.select("token", "most", F.explode(deletions(F.col("token"), F.col("most"))).alias("key"))
    right = vocabulary.select("term", F.explode(deletions(F.col("term"), F.lit(2))).alias("key"))
    near = left.join(right, "key").filter(F.abs(F.length("token") - F.length("term")) <= F.col("most")).select("token", "term", "most").distinct()
    return near.withColumn("distance", F.levenshtein("token", "term")).filter(F.col("distance") <= F.col("most")).select("token", "term", "distance")


def hits(cleaned: DataFrame, ix: Index, limit: int, fuzzy: bool = False, filters: Filters | None = None, where: str | None = None, normalize: bool = True) -> DataFrame:
    """(mention_id, doc_id, rank, pos_score, es_score, score) and the columns of the name: the best names of each mention."""
    filters = filters or Filters()
    terms = _terms(cleaned)
    if fuzzy:
        near = fuzzy_terms(terms, ix.vocabulary)
        terms = terms.join(near, "token").select("mention_id", "term", (F.col("times") * (1 - F.col("distance") / F.greatest(F.length("token"), F.length("term")))).alias("times"))
    else:
        terms = terms.withColumnRenamed("token", "term")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms.join(ix.vocabulary.select("term", "df"), "term").join(F.broadcast(ix.stats), F.lit(True))  # statistics: one row
    asked = written(known.select("mention_id", "term", "times", idf.alias("idf"), "avg_len"), "terms")
    # Postings of the asked terms go to the tasks of their names once; pairs of mention and name are made, summed and ranked there.
    posted = ix.postings.join(asked.select("term").distinct(), "term", "left_semi")
    parts = max(shares(ix.postings, PAIRED_AT_ONCE), min(shares(ix.postings, PAIRED_AT_LEAST), cleaned.sparkSession.sparkContext.defaultParallelism))
    named = weighed(ix.names, filters, where).select("doc_id", "popularity", "boost", "penalty").repartition(parts, "doc_id")
    pairs = posted.repartition(parts, "doc_id").join(named, "doc_id").join(asked, "term")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    summed = pairs.groupBy("doc_id", "mention_id", "popularity", "boost", "penalty").agg(F.sum(F.col("times") * weight * (1.0 if fuzzy else EXACT_BOOST)).alias("bm25"))
    of = Window.partitionBy("mention_id")
    scored = summed.select("mention_id", "doc_id", "popularity", "bm25", F.round((F.col("bm25") + F.col("boost")) * F.col("penalty"), 9).alias("score"))
    # Only names that can be among the best, ties included, meet the wide table.
    placed = scored.withColumn("place", F.rank().over(of.orderBy(F.desc("score"), F.desc("popularity")))).filter(F.col("place") <= limit)
    rows = written(placed.select("mention_id", "doc_id", "bm25", "score"), "hits").join(ix.names, "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), F.desc("popularity"), "entity", "name", "is_alias"))).filter(F.col("rank") <= limit)
    pos, es = F.col("rank") / F.count("*").over(of), F.col("score") / F.max("score").over(of)
    return ranked.withColumns({"pos_score": pos, "es_score": es if normalize else F.col("score"), "popularity_out": F.col("popularity_norm") if normalize else F.col("popularity").cast("double")})


def weighed(named: DataFrame, f: Filters, where: str | None = None) -> DataFrame:
    """Names with ``boost`` and ``penalty``: hard filters drop names; soft ones add to the score of matches and shrink that of the others."""
    boost, penalty = F.lit(0.0), F.lit(1.0)
    if where:
        return named.filter(F.expr(where)).withColumns({"boost": boost, "penalty": penalty})
    if f.kind:
        named = named.filter(F.col("kind") == f.kind)
    if f.language:
        named = named.filter(F.array_contains("languages", f.language))
    if f.ner_types:
        match = F.coalesce(F.col("ner_type").isin(f.ner_types), F.lit(False))
        named, boost = (named, boost + F.when(match, NER_BOOST).otherwise(0.0)) if f.soft else (named.filter(match), boost)
    for column, wanted, each_boost, shrink in (("explicit_types", f.types, TYPE_BOOST, TYPE_PENALTY), ("extended_types", f.extended_types, EXTENDED_BOOST, EXTENDED_PENALTY)):
        if not wanted:
            continue
        match = F.arrays_overlap(F.col(column), F.array(*[F.lit(x) for x in wanted]))
        if f.soft:
            each = sum((F.when(F.array_contains(column, x), each_boost).otherwise(0.0) for x in wanted), F.lit(0.0))
            boost, penalty = boost + each, penalty * F.when(match, 1.0).otherwise(shrink)
        else:
            named = named.filter(match)
    return named.withColumns({"boost": boost, "penalty": penalty})


def ambiguity(cleaned: DataFrame, ranked: DataFrame) -> DataFrame:
    """(mention_id, ambiguity_mention, corrects_tokens) from unfiltered hits: the share of entities whose first hit is
    the mention itself, and of the mention's words that any hit holds."""
    named = ranked.select("mention_id", "entity", "rank", T.clean(F.col("name")).alias("clean_name")).join(cleaned.select("mention_id", "mention"), "mention_id")
    first = named.groupBy("mention_id", "entity").agg(F.min_by("clean_name", "rank").alias("first_name"), F.first("mention").alias("mention"))
    share = first.groupBy("mention_id").agg(F.avg((F.col("first_name") == F.col("mention")).cast("double")).alias("ambiguity_mention"))
    words = cleaned.select("mention_id", F.explode(F.array_distinct(T.tokens(F.col("mention")))).alias("word"))
    seen = named.select("mention_id", F.explode(F.array_distinct(T.tokens(F.col("clean_name")))).alias("word")).distinct().withColumn("seen", F.lit(1))
    held = words.join(seen, ["mention_id", "word"], "left").groupBy("mention_id").agg(F.avg(F.coalesce("seen", F.lit(0)).cast("double")).alias("corrects_tokens"))
    return cleaned.select("mention_id").join(share, "mention_id", "left").join(held, "mention_id", "left").select("mention_id", F.coalesce("ambiguity_mention", F.lit(0.0)).alias("ambiguity_mention"), F.coalesce("corrects_tokens", F.lit(0.0)).alias("corrects_tokens"))


def features(cleaned: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds ed_score, jaccard_score and jaccard_ngram_score of the name against the mention."""
    both = ranked.join(cleaned, "mention_id").withColumn("clean_name", T.clean(F.col("name")))
    m, n = F.col("mention"), F.col("clean_name")
    return both.withColumns({"ed_score": T.edit_similarity(m, n), "jaccard_score": T.overlap(T.token_set(m), T.token_set(n)), "jaccard_ngram_score": T.overlap(T.trigrams(m), T.trigrams(n))})


def best_forms(featured: DataFrame) -> DataFrame:
    """One row an entity and mention: the form most like the mention, the first-ranked of equals; ``position`` is where
    the entity first appeared."""
    of = Window.partitionBy("mention_id", "entity")
    like = F.round(F.col("ed_score") + F.col("jaccard_score"), 9)
    return featured.withColumns({"position": F.min("rank").over(of), "turn": F.row_number().over(of.orderBy(F.desc(like), "rank"))}).filter("turn = 1").drop("turn")


def with_type_labels(rows: DataFrame, type_labels: DataFrame) -> DataFrame:
    """``types`` as (id, name) in order: an unknown type is named by its id, a known one without an English label null."""
    exploded = rows.select("mention_id", "entity", F.posexplode("explicit_types").alias("pos", "type_id")).join(type_labels, "type_id", "left")
    named = exploded.withColumn("label", F.when(F.col("known"), F.col("type_name")).otherwise(F.col("type_id")))
    lists = named.groupBy("mention_id", "entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("type_id").alias("id"), F.col("label").alias("name")))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("types"))
    return rows.drop("types").join(lists, ["mention_id", "entity"], "left")


def forced(cleaned: DataFrame, found: DataFrame, wanted: DataFrame, ix: Index, normalize: bool = True) -> DataFrame:
    """Rows for wanted ids (mention_id, entity) that the result lacks: the English label, with full position and score."""
    missing = wanted.select("mention_id", "entity").distinct().join(found.select("mention_id", "entity"), ["mention_id", "entity"], "left_anti")
    labels = ix.names.filter(F.array_contains("languages", "en") & ~F.col("is_alias"))
    one = missing.join(labels, "entity").withColumn("turn", F.row_number().over(Window.partitionBy("mention_id", "entity").orderBy("name"))).filter("turn = 1").drop("turn")
    pop = F.col("popularity_norm") if normalize else F.col("popularity").cast("double")
    rows = one.withColumns({"bm25": F.lit(1.0), "score": F.lit(1.0), "rank": F.lit(2**31 - 1), "pos_score": F.lit(1.0), "es_score": F.lit(1.0), "popularity_out": pop})
    return features(cleaned, rows).withColumn("position", F.lit(2**31 - 1))


CANDIDATE = [
    "mention_id", "id", "name", "description", "types", "kind", "ner_type", "explicit_types", "extended_types", "ambiguity_mention", "corrects_tokens", "ntoken_mention", "ntoken_entity", "length_mention",
    "length_entity", "popularity", "pos_score", "es_score", "ed_score", "jaccard_score", "jaccard_ngram_score", "position",
]


def lookup(mentions: DataFrame, ix: Index, limit: int = 1000, fuzzy: bool = False, filters: Filters | None = None, wanted: DataFrame | None = None, where: str | None = None, normalize: bool = True) -> DataFrame:
    """Candidates of every mention (mention_id, name) with all features, in the order of ``position``.

    ``wanted``: (mention_id, entity) rows that must be in the result.  ``where``: a SQL condition on names in place of
    the filters and the wanted ids.
    """
    cleaned = mentions_of(mentions)
    ranked = hits(cleaned, ix, limit, fuzzy, filters, where, normalize)
    plain = ranked if not fuzzy and not filters and not where else hits(cleaned, ix, limit, normalize=normalize)
    rows = best_forms(features(cleaned, ranked))
    if wanted is not None and not where:
        rows = rows.unionByName(forced(cleaned, rows, wanted, ix, normalize))
    rows = rows.join(ambiguity(cleaned, plain), "mention_id", "left")
    if ix.type_labels is not None:
        rows = with_type_labels(rows, ix.type_labels)
    else:
        rows = rows.withColumn("types", F.transform("explicit_types", lambda t: F.struct(t.alias("id"), t.alias("name"))))
    named = rows.drop("popularity").withColumnsRenamed({"entity": "id", "n_token": "ntoken_entity", "name_len": "length_entity", "popularity_out": "popularity"})
    return named.select(*CANDIDATE)
