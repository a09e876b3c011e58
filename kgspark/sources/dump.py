"""Entity dumps (one JSON object a line, in an array) as tables.

Lines are cleaned and filtered before they are parsed; maps keep the order of the document.  A claim's value stays JSON
text and is decoded by the claim's datatype.  Everything comes from one parsed DataFrame, so write that, or the tables,
once.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark import schema
from kgspark.plans.tables import shared_dir, written

# Datatypes and their buckets, datatypes of claims, class ids of the public knowledge base.
BUCKETS = {
    "external-id": "STRING", "quantity": "NUMBER", "globe-coordinate": "STRING", "string": "STRING", "monolingualtext": "STRING", "commonsMedia": "STRING", "time": "DATETIME", "url": "STRING",
    "geo-shape": "GEOSHAPE", "math": "MATH", "musical-notation": "MUSICAL_NOTATION", "tabular-data": "TABULAR_DATA",
}
TO_ENTITY, SKIPPED = ("wikibase-item", "wikibase-property"), ("wikibase-lexeme", "wikibase-form", "wikibase-sense", "entity-schema")
DISAMBIGUATION, HUMAN = "Q4167410", "Q5"
NER = ("LOC", "ORG", "OTHERS", "PERS")
ORGANISATION = ("Q43229", ["Q6256", "Q515", "Q5119", "Q15916867", "Q17350442", "Q623109", "Q8436"])
PLACE = ("Q2221906", ["Q2095", "Q2385804", "Q327333", "Q484652", "Q12143"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a text file or folder, compressed or not; bz2 is split."""
    return spark.read.text(path)


def piped(spark: SparkSession, stream: Iterable[str], lot: int = 100_000) -> DataFrame:
    """(value) of lines that come through a pipe: stored in lots in the shared folder, so that the driver holds one lot."""
    path = f"{shared_dir(spark)}/kgspark/piped-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    rest = iter(stream)
    spark.createDataFrame([], "value string").write.text(path)
    while part := [(x.rstrip("\r\n"),) for x in itertools.islice(rest, lot)]:
        spark.createDataFrame(part, "value string").write.mode("append").text(path)
    return lines(spark, path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines with their number from 0, through the files in the order of their names.

    A first scan counts the lines of each split.  That table has one row a split, so the running sum over it is small;
    it is stored, so that its true size decides how it is joined.  The dump itself is not shuffled.
    """
    line = F.monotonically_increasing_id().alias("at")
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    counted = lines(spark, path).select(*split, line).groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    base = written(counted.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("base")), "splits")
    return lines(spark, path).select("value", *split, line).join(base, ["file", "start"]).select("value", (F.col("at") + F.col("base")).alias("line"))


def skipped(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(value) without the first n lines."""
    return numbered(spark, path).filter(F.col("line") >= n).select("value")


def resumed(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """(value) from the line of an entity on, that line included; nothing if no line is that entity's."""
    known = numbered(spark, path)
    holds = F.get_json_object(F.regexp_replace(F.trim("value"), r",\s*$", ""), "$.id") == entity
    first = known.filter(F.contains("value", F.lit(entity)) & holds).agg(F.min("line").alias("first"))  # one row
    return known.join(F.broadcast(first), F.col("line") >= F.col("first")).select("value")


def counters(raw: DataFrame) -> DataFrame:
    """One row: lines, entities, lines in braces that hold no entity, edges, literals, mean length of an entity's line."""
    line = F.regexp_replace(F.trim("value"), r",\s*$", "")
    size = raw.select(F.length("value").alias("size"), (line.startswith("{") & line.endswith("}")).alias("braced"))
    sizes = size.agg(F.count("*").alias("lines"), F.count_if("braced").alias("braced"), F.avg(F.when(F.col("braced"), F.col("size"))).alias("mean_size"))
    entities = parsed(raw, prefix=None)
    sums = entities.agg(F.count("*").alias("entities"))
    for name, table in (("edges", edges(entities)), ("literals", literals(entities))):
        sums = sums.join(table.agg(F.count("*").alias(name)), F.lit(True))  # one row each
    return sizes.join(sums, F.lit(True)).select("lines", "entities", (F.col("braced") - F.col("entities")).alias("errors"), "edges", "literals", F.round("mean_size", 6).alias("mean_size"))


def parsed(raw: DataFrame, prefix: str | None = "Q") -> DataFrame:
    """The objects of the lines (value): brackets, short, broken and other lines are left out; ids begin with ``prefix``."""
    line = F.regexp_replace(F.trim("value"), r",\s*$", "")
    kept = raw.select(line.alias("line")).filter((F.length("line") >= 10) & F.col("line").startswith("{") & F.col("line").endswith("}"))
    # Conditions on columns are not drawn below a generator; below a projection each of them would parse the line again.
    entity = kept.select(F.inline(F.array(F.from_json("line", schema.DUMP)))).filter(F.col("id").isNotNull())
    return entity.filter(F.col("id").startswith(prefix)) if prefix else entity


def _field(json: Column, *names: str) -> Column:
    return F.get_json_object(json, "$." + ".".join(names))


def _ids(claims: Column, property_: str) -> Column:
    """Entity ids that a property's claims point to."""
    snaks = F.coalesce(claims[property_], F.array().cast("array<struct<mainsnak:struct<property:string,datatype:string,datavalue:struct<value:string>>>>"))
    return F.filter(F.transform(snaks, lambda c: _field(c["mainsnak"]["datavalue"]["value"], "id")), lambda x: x.isNotNull() & x.startswith("Q"))


def type_edges(entities: DataFrame) -> DataFrame:
    """(child, parent, property) of instance-of (P31) and subclass-of (P279)."""
    one = lambda p: entities.select(F.col("id").alias("child"), F.explode(_ids(F.col("claims"), p)).alias("parent"), F.lit(p).alias("property"))
    return one("P31").unionByName(one("P279"))


def items(entities: DataFrame) -> DataFrame:
    """Labels, aliases, description, popularity, kind, explicit types and urls; NER and extended types come from ``typed``."""
    p31, p279 = _ids(F.col("claims"), "P31"), _ids(F.col("claims"), "P279")
    has = F.coalesce(F.map_contains_key("claims", "P279"), F.lit(False))
    kind = F.when(has, "type").when(F.col("id").startswith("P"), "predicate").when(F.array_contains(p31, DISAMBIGUATION), "disambiguation").otherwise("entity")
    sites = F.coalesce("sitelinks", F.create_map().cast("map<string,struct<site:string,title:string>>"))
    first = F.try_element_at(F.map_entries(sites), F.lit(1))
    page = lambda lang, title: F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))
    wiki = F.coalesce(page(F.coalesce(F.col("labels")["en"]["language"], F.lit("en")), sites["enwiki"]["title"]), page(F.split_part(first["key"], F.lit("wiki"), F.lit(1)), first["value"]["title"]), F.lit(""))
    return entities.select(
        F.col("id").alias("entity"), kind.alias("kind"), F.coalesce(F.col("descriptions")["en"]["value"], F.lit("")).alias("description"), F.greatest(F.size(F.map_keys(sites)), F.lit(1)).cast("long").alias("popularity"),
        F.transform_values(F.coalesce("labels", F.create_map().cast("map<string,struct<language:string,value:string>>")), lambda _, v: v["value"]).alias("labels"),
        F.transform_values(F.coalesce("aliases", F.create_map().cast("map<string,array<struct<language:string,value:string>>>")), lambda _, v: F.array_distinct(F.transform(v, lambda x: x["value"]))).alias("aliases"),
        F.array_distinct(F.concat(p31, p279)).alias("explicit_types"), F.create_map(F.lit("wikidata"), F.concat(F.lit("https://www.wikidata.org/wiki/"), "id"), F.lit("wikipedia"), wiki).alias("urls"),
    )


def _claims(entities: DataFrame) -> DataFrame:
    one = entities.select("id", F.explode("claims").alias("predicate", "snaks")).select("id", "predicate", F.posexplode("snaks").alias("pos", "s"))
    return one.select("id", "predicate", "pos", F.col("s.mainsnak.datatype").alias("type"), F.col("s.mainsnak.datavalue.value").alias("value")).filter(F.col("value").isNotNull() & ~F.col("type").isin(*SKIPPED))


def edges(entities: DataFrame) -> DataFrame:
    found = _claims(entities).filter(F.col("type").isin(*TO_ENTITY)).select(F.col("id").alias("subject"), "predicate", _field(F.col("value"), "id").alias("object"), "pos")
    return found.filter("object IS NOT NULL")


def literals(entities: DataFrame) -> DataFrame:
    bucket = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])[F.col("type")]
    v = F.col("value")
    value = (
        F.when(F.col("type") == "globe-coordinate", F.concat_ws(",", _field(v, "latitude"), _field(v, "longitude")))
        .when(F.col("type") == "quantity", _field(v, "amount")).when(F.col("type") == "monolingualtext", _field(v, "text")).when(F.col("type") == "time", _field(v, "time")).otherwise(v)
    )
    return _claims(entities).select(F.col("id").alias("subject"), "predicate", bucket.alias("datatype"), value.alias("value"), "pos").filter("datatype IS NOT NULL")


def ner_types(explicit: DataFrame, places: DataFrame, organisations: DataFrame, human: str = HUMAN) -> DataFrame:
    """(entity, ner_types): categories of the explicit types, each once, in the order in which they first occur.

    ``explicit``: (entity, pos, type), rows may repeat; ``places``, ``organisations``: (entity) sets of classes.
    """
    marks = places.select(F.col("entity").alias("type"), F.lit("LOC").alias("ner")).unionByName(organisations.select(F.col("entity").alias("type"), F.lit("ORG").alias("ner")))
    by_type = marks.groupBy("type").agg(F.min("ner").alias("ner"))  # a class in both sets is a place
    named = explicit.join(by_type, "type", "left").withColumn("ner", F.when(F.col("type") == human, "PERS").otherwise(F.coalesce("ner", F.lit("OTHERS"))))
    # Where each category first occurs is all that is kept of an entity while rows are grouped.
    firsts = named.groupBy("entity").agg(*[F.min(F.when(F.col("ner") == x, F.coalesce(F.col("pos").cast("long"), F.lit(-(2**63))))).alias(x) for x in NER])
    ordered = F.sort_array(F.filter(F.array(*[F.struct(F.col(x).alias("pos"), F.lit(x).alias("ner")) for x in NER]), lambda x: x["pos"].isNotNull()))
    return firsts.select("entity", F.transform(ordered, lambda x: x["ner"]).alias("ner_types"))


def typed(rows: DataFrame, closure_pairs: DataFrame, places: DataFrame, organisations: DataFrame) -> DataFrame:
    """Items with ner_types, ner_type and extended_types."""
    explicit = rows.select("entity", F.posexplode("explicit_types").alias("pos", "type"))
    up = explicit.join(closure_pairs.select(F.col("subclass").alias("type"), "superclass"), "type").groupBy("entity").agg(F.array_sort(F.collect_set("superclass")).alias("up"))
    none = F.array().cast("array<string>")
    joined = rows.join(ner_types(explicit, places, organisations), "entity", "left").join(up, "entity", "left")
    return joined.withColumns({"ner_types": F.coalesce("ner_types", none), "ner_type": F.try_element_at("ner_types", F.lit(1)), "extended_types": F.array_union("explicit_types", F.coalesce("up", none))}).drop("up")


def without_known(new: DataFrame, known: DataFrame, key: str = "entity") -> DataFrame:
    """Exact skip of what has been loaded."""
    return new.join(known.select(key), key, "left_anti")
