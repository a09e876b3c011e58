"""The engine's surface: a graph's snapshot with every retrieval, and the build of one from a dump."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import schema, validate
from kgspark.operators import classify, lookup, names, retrieve
from kgspark.plans import closure as C
from kgspark.plans.tables import written
from kgspark.sources import company_csv, dump, snapshots


def build(raw: DataFrame, root: str, kg: str, date: str, known: DataFrame | None = None) -> None:
    """Lines of a dump (value) to a snapshot; ``known``: (entity) rows that an earlier snapshot holds and this skips."""
    entities = written(dump.parsed(raw), "entities")
    fresh = entities if known is None else dump.without_known(entities, known.withColumnRenamed("entity", "id"), "id")
    type_edges = dump.type_edges(entities)
    pairs = written(C.closure(type_edges.filter("property = 'P279'")), "closure")
    items = written(dump.typed(dump.items(fresh).dropDuplicates(["entity"]), pairs, C.class_set(pairs, *dump.PLACE), C.class_set(pairs, *dump.ORGANISATION)), "items")
    _write({"items": items, "edges": dump.edges(fresh), "literals": dump.literals(fresh), "type_edges": type_edges.dropDuplicates(), "closure": pairs}, root, kg, date)


def extend(raw: DataFrame, root: str, kg: str, date: str) -> None:
    """The newest whole snapshot before ``date`` and the entities of further lines that it lacks, as the snapshot ``date``.

    What is known stays, so lines that come again change nothing, and a run that failed can be run again.  Types, closure
    and name index are those of a build from all lines, since one new class or a larger popularity may change any of them.
    """
    spark = raw.sparkSession
    old = KnowledgeGraph(spark, root, kg, snapshots.newest(spark, root, kg, snapshots.LAST, date))
    entities = written(dump.parsed(raw), "entities")
    fresh = dump.without_known(entities, old.table("items").select(F.col("entity").alias("id")), "id")
    type_edges = written(old.table("type_edges").unionByName(dump.type_edges(entities)).dropDuplicates(), "type_edges")
    pairs = written(C.closure(type_edges.filter("property = 'P279'")), "closure")
    plain = dump.items(fresh).dropDuplicates(["entity"])
    every = old.table("items").select(*plain.columns).unionByName(plain)
    items = written(dump.typed(every, pairs, C.class_set(pairs, *dump.PLACE), C.class_set(pairs, *dump.ORGANISATION)), "items")
    both = {"edges": old.table("edges").unionByName(dump.edges(fresh)), "literals": old.table("literals").unionByName(dump.literals(fresh))}
    _write({"items": items, "type_edges": type_edges, "closure": pairs} | both, root, kg, date)


def build_companies(main: DataFrame, extra: DataFrame, root: str, kg: str, date: str) -> None:
    """A company list and its descriptions and ranks (``company_csv``) to a snapshot; of repeated permalinks one stays.

    Extended types are the explicit ones, and there are no edges, no type hierarchy and no links.
    """
    spark = main.sparkSession
    items = company_csv.items(main, extra).dropDuplicates(["entity"]).withColumns({"extended_types": F.col("explicit_types"), "urls": F.create_map().cast("map<string,string>")})
    none = {name: spark.createDataFrame([], ddl) for name, ddl in (("edges", schema.EDGES), ("type_edges", schema.TYPE_EDGES), ("closure", schema.CLOSURE))}
    _write({"items": written(items, "items"), "literals": company_csv.literals(main).dropDuplicates()} | none, root, kg, date)


def _write(tables: dict[str, DataFrame], root: str, kg: str, date: str) -> None:
    """The tables of a snapshot and the name index made from its items."""
    named = written(names.names(tables["items"]), "names")
    posted = written(names.postings(named), "postings")
    snapshots.write(tables | {"names": named, "postings": posted, "vocabulary": names.vocabulary(posted)}, root, kg, date)


class KnowledgeGraph:
    """Queries over a snapshot.  Ids come as lists or as a DataFrame (entity); every answer is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, root: str, kg: str = "wikidata", date: str | None = None):
        self.spark, self.root, self.kg, self.date = spark, root, kg, date
        self._index: lookup.Index | None = None

    def table(self, name: str) -> DataFrame:
        return snapshots.read(self.spark, self.root, self.kg, name, self.date)

    def _ids(self, entities: Iterable[str] | DataFrame) -> DataFrame:
        return entities if isinstance(entities, DataFrame) else self.spark.createDataFrame([(e,) for e in entities], "entity string")

    def index(self) -> lookup.Index:
        if self._index is None:
            named = self.table("names")
            made = lookup.index(named, self.table("items"))
            self._index = lookup.Index(named, self.table("postings"), self.table("vocabulary"), made.stats, made.type_labels)
        return self._index

    def lookup(
        self, mentions: DataFrame | Iterable[str], limit: int = validate.DEFAULT_LIMIT, fuzzy: bool = False, kind: str | None = None, ner_type: str | Iterable[str] | None = None, types: str | Iterable[str] | None = None,
        extended_types: str | Iterable[str] | None = None, language: str | None = None, ids: Iterable[str] | DataFrame | None = None, query: str | None = None, soft_filtering: bool = False, normalize_score: bool = True,
    ) -> DataFrame:
        """Candidates of mentions, names or (mention_id, name) rows.

        ``ids``: entities that every mention's result must hold, or (mention_id, entity) rows.  ``query``: a SQL
        condition on the columns of names instead of the filters.
        """
        if not isinstance(mentions, DataFrame):
            mentions = self.spark.createDataFrame([(m, m) for m in dict.fromkeys(mentions)], "mention_id string, name string")
        if ids is not None and not isinstance(ids, DataFrame):
            ids = mentions.select("mention_id").crossJoin(self._ids(ids))  # a request's list of ids for each mention
        filters = lookup.Filters(kind, validate.ner_types(ner_type), validate.values(types), validate.values(extended_types), language, soft_filtering)
        return lookup.lookup(mentions, self.index(), limit, fuzzy, filters if filters != lookup.Filters() else None, ids, query, normalize_score)

    def types(self, entities) -> DataFrame:
        return retrieve.types(self.table("items"), self._ids(entities))

    def objects(self, entities) -> DataFrame:
        return retrieve.objects(self.table("edges"), self._ids(entities))

    def literals(self, entities) -> DataFrame:
        return retrieve.literals(self.table("literals"), self._ids(entities))

    def predicates(self, pairs: Iterable[tuple[str, str]] | DataFrame) -> DataFrame:
        if not isinstance(pairs, DataFrame):
            pairs = self.spark.createDataFrame([(list(p),) for p in pairs], "pair array<string>")
        return retrieve.predicates(self.table("edges"), retrieve.checked_pairs(pairs))

    def labels(self, entities, lang: str | None = None, category: str | None = None) -> DataFrame:
        return retrieve.labels(self.table("items"), self._ids(entities), lang, category, self.kg if self.kg in retrieve.PREFIXES else "wikidata")

    def sameas(self, entities) -> DataFrame:
        return retrieve.sameas(self.table("items"), self._ids(entities))

    def bow(self, text: str, entities: Iterable[str], texts: DataFrame) -> DataFrame:
        """Similarity of a text with each entity's text; ``texts``: (entity, text)."""
        row = self.spark.createDataFrame([(0, text)], "row_id long, text string")
        asked = self._ids(entities).selectExpr("0L AS row_id", "entity")
        return retrieve.bow_similarity(retrieve.bags(row, "row_id"), retrieve.bags(texts.join(asked.select("entity"), "entity", "left_semi"), "entity"), asked).drop("row_id")

    def objects_summary(self, entities: list[str] | None = None, rank_order: str = "desc", k: int | None = None) -> DataFrame:
        return retrieve.summary(retrieve.summary_table(self.table("edges")), entities, rank_order, validate.k(k))

    def literals_summary(self, entities: list[str] | None = None, rank_order: str = "desc", k: int | None = None) -> DataFrame:
        return retrieve.summary(retrieve.summary_table(self.table("literals")), entities, rank_order, validate.k(k))

    def classify_literals(self, literals: Iterable[str]) -> DataFrame:
        return classify.literals(self.spark.createDataFrame([(x,) for x in literals], "literal string"))

    def classify_columns(self, tables: list[list[list[str]]]) -> DataFrame:
        """Tables as lists of columns, columns as lists of cells."""
        cells = [(f"table_{t}", c, v) for t, columns in enumerate(tables, 1) for c, column in enumerate(columns) for v in column or [None]]
        return classify.columns(self.spark.createDataFrame(cells, "table_id string, col_id int, value string"), self._known())

    def recognize_entities(self, texts: Iterable[str], model=classify.capitalised) -> DataFrame:
        return classify.recognise_known(self.spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"), self._known(), model)

    def _known(self) -> DataFrame:
        return classify.gazetteer(self.table("names"))
