"""The synthetic tables seen as a knowledge graph, in Spark and, as common table expressions, in SQL.

Ids are ``Q``, a family digit and the key: 1 part, 2 customer, 3 supplier, 4 nation, 5 order, 6 region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.plans.tables import dealt

PART, CUSTOMER, SUPPLIER, NATION, ORDER, REGION = range(1, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qid(family: int, key: Column | str) -> Column:
    return F.concat(F.lit(f"Q{family}"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over parts: each below the one with half its key."""
    p = table(spark, sf_dir, "part").filter("p_partkey > 1")
    return p.select(qid(PART, "p_partkey").alias("child"), qid(PART, F.expr("p_partkey div 2")).alias("parent"))


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_edges(spark, sf_dir).union(spark.createDataFrame([("Q11", "Q12"), ("Q11", "Q12")], "child string, parent string"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").distinct()
    return line.select(qid(ORDER, "l_orderkey").alias("child"), qid(PART, "l_partkey").alias("parent"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    one = lambda df, a, b, p: df.select(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"))
    line = lambda other: dealt(t("lineitem").select("l_orderkey", other), "l_orderkey").distinct()
    parts = [
        one(t("customer"), qid(CUSTOMER, "c_custkey"), qid(NATION, "c_nationkey"), "P1"), one(t("supplier"), qid(SUPPLIER, "s_suppkey"), qid(NATION, "s_nationkey"), "P1"),
        one(t("nation"), qid(NATION, "n_nationkey"), qid(REGION, "n_regionkey"), "P2"), one(t("orders"), qid(ORDER, "o_orderkey"), qid(CUSTOMER, "o_custkey"), "P3"),
        one(line("l_partkey"), qid(ORDER, "l_orderkey"), qid(PART, "l_partkey"), "P4"), one(line("l_suppkey"), qid(ORDER, "l_orderkey"), qid(SUPPLIER, "l_suppkey"), "P5"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("pos", F.lit(0))


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    one = lambda df, a, p, kind, v: df.select(a.alias("subject"), F.lit(p).alias("predicate"), F.lit(kind).alias("datatype"), v.alias("value"))
    cust, order = qid(CUSTOMER, "c_custkey"), qid(ORDER, "o_orderkey")
    rows = one(c, cust, "P10", "NUMBER", F.col("c_acctbal").cast("decimal(18,2)").cast("string")).union(one(c, cust, "P11", "STRING", F.col("c_mktsegment")))
    rows = rows.union(one(o, order, "P12", "DATETIME", F.date_format("o_orderdate", "yyyy-MM-dd"))).union(one(o, order, "P13", "NUMBER", F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return rows.withColumn("pos", F.lit(0))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are types with two names; customers persons, suppliers organisations, nations and regions places."""
    t = lambda n: table(spark, sf_dir, n)
    none, no_alias = F.array().cast("array<string>"), F.create_map().cast("map<string,array<string>>")
    sold = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    bought = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    supplied = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))

    def one(df, entity, kind, popularity, ner, label, alias, types):
        return df.select(
            entity.alias("entity"), F.lit(kind).alias("kind"), F.lit("").alias("description"), F.greatest(F.coalesce(popularity, F.lit(0)), F.lit(1)).cast("long").alias("popularity"), F.array(F.lit(ner)).alias("ner_types"),
            F.lit(ner).alias("ner_type"), F.create_map(F.lit("en"), label, F.lit("fr"), F.upper(label)).alias("labels"), alias.alias("aliases"), types.alias("explicit_types"), types.alias("extended_types"),
            F.create_map(F.lit("wikidata"), F.concat(F.lit("https://www.wikidata.org/wiki/"), entity)).alias("urls"),
        )

    part = t("part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = one(part, qid(PART, "p_partkey"), "type", F.col("n"), "OTHERS", F.col("p_name"), F.create_map(F.lit("en"), F.array(F.concat_ws(" ", "p_brand", "p_name"), F.upper("p_name"))), F.array(qid(PART, F.expr("p_partkey div 2"))))
    cust = t("customer").join(bought, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.unionByName(one(cust, qid(CUSTOMER, "c_custkey"), "entity", F.col("n"), "PERS", F.col("c_name"), no_alias, F.array(qid(NATION, "c_nationkey"))))
    supp = t("supplier").join(supplied, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    rows = rows.unionByName(one(supp, qid(SUPPLIER, "s_suppkey"), "entity", F.col("n"), "ORG", F.col("s_name"), no_alias, F.array(qid(PART, "s_suppkey"))))
    rows = rows.unionByName(one(t("nation"), qid(NATION, "n_nationkey"), "entity", F.lit(1), "LOC", F.col("n_name"), no_alias, F.array(qid(REGION, "n_regionkey"))))
    return rows.unionByName(one(t("region"), qid(REGION, "r_regionkey"), "entity", F.lit(1), "LOC", F.col("r_name"), no_alias, none))


SQL = {
    "type_edges": "type_edges AS (SELECT 'Q1' || p_partkey AS child, 'Q1' || (p_partkey // 2) AS parent FROM part WHERE p_partkey > 1)",
    "cyclic_edges": "cyclic_edges AS (SELECT 'Q1' || p_partkey AS child, 'Q1' || (p_partkey // 2) AS parent FROM part WHERE p_partkey > 1 UNION ALL SELECT 'Q11', 'Q12')",
    "instances": "instances AS (SELECT DISTINCT 'Q5' || l_orderkey AS child, 'Q1' || l_partkey AS parent FROM lineitem)",
    "closure": "closure AS (SELECT child AS subclass, parent AS superclass FROM type_edges UNION SELECT c.subclass, e.parent FROM closure c JOIN type_edges e ON c.superclass = e.child)",
    "edges": (
        "edges AS (SELECT 'Q2' || c_custkey AS subject, 'P1' AS predicate, 'Q4' || c_nationkey AS object FROM customer UNION ALL SELECT 'Q3' || s_suppkey, 'P1', 'Q4' || s_nationkey FROM supplier "
        "UNION ALL SELECT 'Q4' || n_nationkey, 'P2', 'Q6' || n_regionkey FROM nation UNION ALL SELECT 'Q5' || o_orderkey, 'P3', 'Q2' || o_custkey FROM orders "
        "UNION ALL SELECT DISTINCT 'Q5' || l_orderkey, 'P4', 'Q1' || l_partkey FROM lineitem UNION ALL SELECT DISTINCT 'Q5' || l_orderkey, 'P5', 'Q3' || l_suppkey FROM lineitem)"
    ),
    "literals": (
        "literals AS (SELECT 'Q2' || c_custkey AS subject, 'P10' AS predicate, 'NUMBER' AS datatype, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS value FROM customer UNION ALL SELECT 'Q2' || c_custkey, 'P11', 'STRING', c_mktsegment FROM customer "
        "UNION ALL SELECT 'Q5' || o_orderkey, 'P12', 'DATETIME', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'Q5' || o_orderkey, 'P13', 'NUMBER', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders)"
    ),
    "items": (
        "items AS (SELECT 'Q1' || p_partkey AS entity, 'type' AS kind, 'OTHERS' AS ner_type, greatest(coalesce(n, 0), 1) AS popularity, p_name AS label, p_brand || ' ' || p_name AS alias, 'Q1' || (p_partkey // 2) AS type "
        "FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey "
        "UNION ALL SELECT 'Q2' || c_custkey, 'entity', 'PERS', greatest(coalesce(n, 0), 1), c_name, NULL, 'Q4' || c_nationkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey "
        "UNION ALL SELECT 'Q3' || s_suppkey, 'entity', 'ORG', greatest(coalesce(n, 0), 1), s_name, NULL, 'Q1' || s_suppkey FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey "
        "UNION ALL SELECT 'Q4' || n_nationkey, 'entity', 'LOC', 1, n_name, NULL, 'Q6' || n_regionkey FROM nation UNION ALL SELECT 'Q6' || r_regionkey, 'entity', 'LOC', 1, r_name, NULL, NULL FROM region)"
    ),
    # One row a surface form: the label (its upper-case French spelling is the same form), the alias, a person's dotted names.
    "names": (
        "names AS (SELECT entity, label AS name, false AS is_alias, 'en fr' AS languages, kind, ner_type, popularity, type FROM items "
        "UNION ALL SELECT entity, alias, true, 'en', kind, ner_type, popularity, type FROM items WHERE alias IS NOT NULL AND lower(alias) <> lower(label) "
        "UNION SELECT entity, list_aggregate(list_transform(w, lambda x, j: CASE WHEN j <= i AND j < len(w) THEN x[1] || '.' ELSE x END), 'string_agg', ' '), true, 'en', kind, ner_type, popularity, type "
        "FROM (SELECT *, string_split(label, ' ') AS w, unnest(range(len(string_split(label, ' ')))) AS i FROM items WHERE ner_type = 'PERS'))"
    ),
    "postings": "postings AS (SELECT term, key, entity, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT entity || chr(1) || name || chr(1) || is_alias AS key, entity, len(string_split(lower(name), ' ')) AS n, unnest(string_split(lower(name), ' ')) AS term FROM names) GROUP BY term, key, entity)",
}


def with_(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
