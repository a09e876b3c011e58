import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kgspark import cli, engine
from kgspark.operators import classify, lookup, names, retrieve
from kgspark.plans import closure as C
from kgspark.sources import company_csv, dump, edges_tsv, snapshots
from kgspark.streaming import ingest

EDGES = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("E", "D"), ("E", "D"), (None, "A")]


def test_closure(spark, rows, tmp_path):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    pairs = C.closure(edges)
    assert rows(pairs.select("subclass", "superclass")) == sorted([(x, y) for x in "ABC" for y in "ABCD"] + [("E", "D")])
    assert rows(C.closure(pairs.selectExpr("subclass AS child", "superclass AS parent")).select("subclass", "superclass")) == rows(pairs.select("subclass", "superclass"))
    seeds = spark.createDataFrame([("E",), ("D",)], "item string")
    assert rows(C.closure(edges, seeds)) == [("E", "D", 1)]
    assert rows(C.superclasses(seeds, pairs)) == [("D", []), ("E", ["D"])]
    assert rows(C.class_set(pairs, "D", ["B"])) == [("D",), ("E",)]
    assert C.closure(spark.createDataFrame([], "child string, parent string")).count() == 0
    edges_tsv.write(edges.filter("child IS NOT NULL"), f"{tmp_path}/edges")
    assert edges_tsv.read(spark, f"{tmp_path}/edges").count() == 5


def test_class_sets_from_roots(spark, rows):
    """Pairs below some roots without the whole closure; categories of an entity by where each first occurs, not by lists."""
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    whole = C.closure(edges)
    assert rows(C.under(edges, ["D", "B", "E"])) == rows(whole.filter("superclass IN ('D', 'B', 'E')"))
    explicit = spark.createDataFrame([("Q1", 2, "A"), ("Q1", 0, "X"), ("Q1", 2, "A"), ("Q1", 1, "H"), ("Q1", 3, "D"), ("Q2", 0, "A"), ("Q2", 0, "H"), ("Q3", None, "D"), ("Q3", 0, "A")], "entity string, pos int, type string")
    one = lambda *x: spark.createDataFrame([(y,) for y in x], "entity string")
    found = dump.ner_types(explicit, one("A"), one("A", "D"), human="H")
    assert rows(found) == [("Q1", ["OTHERS", "PERS", "LOC", "ORG"]), ("Q2", ["LOC", "PERS"]), ("Q3", ["ORG", "LOC"])]
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_lookup_keeps_pairs_in_place(spark, monkeypatch):
    """Names and postings are made within rows, and pairs of mention and name are not shuffled before they are ranked."""
    labels = "entity string, description string, kind string, ner_type string, ner_types array<string>, explicit_types array<string>, extended_types array<string>, popularity long, labels map<string,string>, aliases map<string,array<string>>"
    items = spark.createDataFrame([(f"Q{i}", "", "entity", "PERS" if i % 2 else "LOC", None, [f"T{i % 3}"], [], i, {"en": f"Blue Ring {i % 5}", "fr": f"BLUE ring {i % 5}"}, {"en": ["ring", f"Gear {i}"]}) for i in range(40)], labels)
    assert "Exchange" not in names.surface_forms(items)._jdf.queryExecution().toString()
    assert "Exchange" not in names.postings(spark.createDataFrame([(1, "a b A")], "doc_id long, name string"))._jdf.queryExecution().toString()
    plans, write = [], lookup.written
    monkeypatch.setattr(lookup, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    ix = lookup.stored(lookup.index(names.names(items)))
    asked = lookup.mentions_of(spark.createDataFrame([("m", "blue ring"), ("n", "gear 7")], "mention_id string, name string"))
    best = lookup.hits(asked, ix, 3, filters=lookup.Filters(ner_types=["LOC"], types=["T1"], soft=True)).orderBy("mention_id", "rank").collect()
    plan = dict(plans)["hits"]
    assert not [x for x in plan.split("Exchange hashpartitioning(")[1:] if "doc_id" in x.split(")")[0] and "mention_id" in x.split(")")[0]]
    assert [(r.mention_id, r.rank, r.entity) for r in best][:3] == [("m", 1, "Q34"), ("m", 2, "Q28"), ("m", 3, "Q22")]


def claim(p, kind, value):
    return {"mainsnak": {"property": p, "datatype": kind, "datavalue": {"value": value}}}


def dump_lines():
    say = lambda **v: {k: {"language": k, "value": x} for k, x in v.items()}
    one = {"id": "Q1", "type": "item", "labels": say(en="Paris", fr="paris", it="Parigi"), "aliases": {"en": [{"language": "en", "value": "PARIS"}, {"language": "en", "value": "City of Light"}], "fr": [{"language": "fr", "value": "City of light"}]}, "descriptions": say(en="capital"), "sitelinks": {"dewiki": {"site": "dewiki", "title": "Paris an der Seine"}}}
    one["claims"] = {
        "P31": [claim("P31", "wikibase-item", {"id": "Q10"})], "P1": [claim("P1", "globe-coordinate", {"latitude": 1.5, "longitude": 2}), claim("P1", "quantity", {"amount": "+3"})], "P2": [claim("P2", "monolingualtext", {"text": "hé", "language": "fr"})],
        "P3": [claim("P3", "time", {"time": "+2001-01-01T00:00:00Z"}), claim("P3", "wikibase-lexeme", {"id": "L1"}), {"mainsnak": {"property": "P3", "datatype": "string"}}], "P4": [claim("P4", "string", "x y")], "P5": [claim("P5", "wikibase-property", {"id": "P9"})],
    }
    kind = {"id": "Q10", "labels": say(en="city"), "claims": {"P279": [claim("P279", "wikibase-item", {"id": "Q2221906"})]}}
    person = {"id": "Q3", "labels": say(en="John Ronald Tolkien"), "claims": {"P31": [claim("P31", "wikibase-item", {"id": "Q5"})]}}
    blank = {"id": "Q4", "labels": say(en="Paris"), "claims": {"P31": [claim("P31", "wikibase-item", {"id": "Q4167410"})]}}
    property_ = {"id": "P9", "labels": say(en="name")}
    texts = [json.dumps(x, ensure_ascii=False) + "," for x in (one, kind, property_, person, blank)]
    return ["[", *texts, "{broken json here,", '{"id":"Q5","labels":{}}', "]", "", None]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("kg"))
    engine.build(spark.createDataFrame([(x,) for x in dump_lines()], "value string"), root, "wikidata", "20240101")
    return root


def test_dump(spark, rows):
    e = dump.parsed(spark.createDataFrame([(x,) for x in dump_lines()], "value string"))
    assert {r[0] for r in rows(e.select("id"))} == {"Q1", "Q10", "Q3", "Q4", "Q5"}
    items = {r.entity: r for r in dump.items(e).collect()}
    assert {k: v.kind for k, v in items.items()} == {"Q1": "entity", "Q10": "type", "Q3": "entity", "Q4": "disambiguation", "Q5": "entity"}
    assert items["Q1"].urls["wikipedia"] == "https://de.wikipedia.org/wiki/Paris_an_der_Seine" and items["Q3"].urls["wikipedia"] == "" and items["Q1"].popularity == 1 and items["Q3"].description == ""
    assert rows(dump.edges(e).select("subject", "predicate", "object").filter("subject = 'Q1'")) == [("Q1", "P31", "Q10"), ("Q1", "P5", "P9")]
    assert rows(dump.literals(e).select("predicate", "datatype", "value")) == [("P1", "NUMBER", "+3"), ("P1", "STRING", "1.5,2"), ("P2", "STRING", "hé"), ("P3", "DATETIME", "+2001-01-01T00:00:00Z"), ("P4", "STRING", "x y")]
    assert rows(dump.type_edges(e)) == [("Q1", "Q10", "P31"), ("Q10", "Q2221906", "P279"), ("Q3", "Q5", "P31"), ("Q4", "Q4167410", "P31")]


def test_engine(spark, rows, built):
    g = engine.KnowledgeGraph(spark, built)
    items = {r.entity: r for r in g.table("items").collect()}
    assert items["Q1"].ner_types == ["LOC"] and items["Q3"].ner_types == ["PERS"] and sorted(items["Q1"].extended_types) == ["Q10", "Q2221906"]
    names_ = rows(g.table("names").filter("entity = 'Q1'").selectExpr("name", "array_join(languages, ' ')", "is_alias"))
    assert names_ == [("City of Light", "en fr", True), ("Parigi", "it", False), ("Paris", "en fr", False)]
    assert {r[0] for r in rows(g.table("names").filter("entity = 'Q3' AND is_alias").select("name"))} == {"John Ronald Tolkien", "J. Ronald Tolkien", "J. R. Tolkien"}
    found = g.lookup(["paris", "Jon Tolkien", "nothing"], ids=["Q10"]).collect()
    by = {(r.mention_id, r.id): r for r in found}
    assert ("paris", "Q1") in by and ("paris", "Q4") in by and ("Jon Tolkien", "Q3") in by and ("nothing", "Q10") in by
    assert max(r.es_score for r in found if r.mention_id == "paris") == 1 and by["paris", "Q1"].ambiguity_mention == 1.0 and by["paris", "Q1"].ed_score == 1
    assert [(t.id, t.name) for t in by["paris", "Q1"].types] == [("Q10", "city")]
    assert {r.id for r in g.lookup(["pariz"], fuzzy=True).collect()} == {"Q1", "Q4"}
    assert {r.id for r in g.lookup(["paris"], ner_type="LOC").collect()} == {"Q1"} and {r.id for r in g.lookup(["paris"], query="kind = 'disambiguation'").collect()} == {"Q4"}
    soft = {r.id: r.es_score for r in g.lookup(["paris"], types="Q10", soft_filtering=True).collect()}
    assert soft["Q1"] == 1 and soft["Q4"] < 0.2
    together = rows(g.lookup(["paris", "city"]).drop("types"))
    assert together == sorted(rows(g.lookup(["paris"]).drop("types")) + rows(g.lookup(["city"]).drop("types")), key=repr)
    assert rows(g.types(["Q1", "Q99"])) == [("Q1", "Q10")] and rows(g.objects(["Q1"])) == [("Q1", "P9", ["P5"]), ("Q1", "Q10", ["P31"])]
    assert rows(g.predicates([("Q1", "Q10"), ("Q10", "Q1")])) == [("Q1 Q10", ["P31"])] and len(rows(g.literals(["Q1"]))) == 5
    with pytest.raises(PySparkException):
        g.predicates([("Q1", "Berlin")]).collect()
    label = g.labels(["Q1"], "it").first()
    assert label.labels == {"it": "Parigi"} and set(label.aliases) == {"en", "fr"} and g.labels(["Q1"], category="type").count() == 0
    assert ("Q3", "wikipedia", "") in rows(g.sameas(["Q3"])) and g.objects_summary(k=2).count() == 2 and g.literals_summary(["Q3"]).count() == 0
    assert g.bow("The white city of light", ["Q1"], spark.createDataFrame([("Q1", "City lights, white")], "entity string, text string").select("entity", "text")).first().matched == ["city", "white"]
    assert rows(g.classify_literals(["12", "12", "x"]).select("literal", "datatype")) == [("12", "INTEGER"), ("x", "STRING")]
    assert [tuple(r)[2:5] for r in g.classify_columns([[["1", "2", "x"], [""], ["2020-01-02"]]]).orderBy("col_id").collect()] == [("NUMBER", "LIT", "NUMBER"), ("UNKNOWN", "UNKNOWN", "UNKNOWN"), ("DATE", "LIT", "DATE")]
    assert rows(g.recognize_entities(["go to New York, Bob", ""])) == [(0, "Bob", "OTHER", 16, 19), (0, "New York", "OTHER", 6, 14)]
    assert rows(g.recognize_entities(["from Paris to Port", None])) == [(0, "Paris", "LOCATION", 5, 10), (0, "Port", "OTHER", 14, 18)]
    columns = [[["paris ", "Parigi", "John Ronald Tolkien"], ["7", "7", "Paris"], ["no", "Paris"]]]
    assert [(r.classification, r.tag, round(r.probability, 3)) for r in g.classify_columns(columns).orderBy("col_id").collect()] == [("LOCATION", "NE", 0.667), ("NUMBER", "LIT", 0.667), ("STRING", "LIT", 0.5)]
    with pytest.raises(ValueError):
        engine.KnowledgeGraph(spark, built, "other").table("items")


def test_build_skips_what_is_known(spark, rows, built, tmp_path):
    known = engine.KnowledgeGraph(spark, built).table("items").filter("entity <> 'Q3'").select("entity")
    engine.build(spark.createDataFrame([(x,) for x in dump_lines()], "value string"), str(tmp_path), "wikidata", "20240202", known)
    assert rows(engine.KnowledgeGraph(spark, str(tmp_path)).table("items").select("entity")) == [("Q3",)]


def test_cli(spark, built, capsys):
    cli.main(["--root", built, "types", "Q1"])
    cli.main(["--root", built, "lookup", "paris", "--limit", "1"])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out[0] == {"entity": "Q1", "type": "Q10"} and out[1]["mention_id"] == "paris" and len(out) == 2


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = [x for x in dump_lines() if x is not None]
    for k, part in enumerate((text[:2], text[2:])):
        (folder / f"part-{k}").write_text("\n".join(part), encoding="utf-8")
        ingest.follow(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/items").groupBy("batch").count().count() == 2
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out/items").select("entity").collect()) == ["Q1", "Q10", "Q3", "Q4", "Q5"]


def test_fuzzy_terms_are_all_within_the_edits(spark, rows):
    tokens = spark.createDataFrame([("ab",), ("plate",), ("plates",), ("",)], "token string")
    words = ["ab", "abc", "plate", "plat", "lpate", "plates", "slate", "slates", "palates", "xplatesx", "pltaes", ""]
    found = lookup.fuzzy_terms(tokens, spark.createDataFrame([(w,) for w in words], "term string"))
    every = tokens.crossJoin(spark.createDataFrame([(w,) for w in words], "term string")).withColumn("d", F.levenshtein("token", "term")).filter(F.col("d") <= lookup.edits_allowed(F.length("token")))
    assert rows(found) == rows(every)


def test_csv(spark, rows, tmp_path):
    (tmp_path / "main.csv").write_text("permalink,name,alias1,alias2,alias3,founded,size\na,Acme,,,,2020-01-02,5\n,none,,,,,\nb,Beta,,,,,x\n")
    main = company_csv.read(spark, str(tmp_path / "main.csv"))
    extra = company_csv.latest_extra(spark.createDataFrame([("a", "u", "old", 1.0, 1), ("a", "u", "new", None, 2)], "permalink string, cb_url string, description string, rank double, at int"), "at")
    assert rows(company_csv.items(main, extra).select("entity", "description", "popularity", "ner_type")) == [("a", "new", 0, "ORG"), ("b", "", 0, "ORG")]
    assert rows(company_csv.literals(main).drop("pos")) == [("a", "founded", "DATETIME", "2020-01-02"), ("a", "size", "NUMBER", "5"), ("b", "size", "STRING", "x")]


def test_snapshots(spark, rows):
    found = snapshots.resolved(spark.createDataFrame([("kgdemo01012024", None), ("kgdemo15062024", "DONE"), ("kgdemo31122024", "DOING"), ("plain", None)], "name string, status string"))
    assert {r.kg: r.name for r in found.collect()} == {"kgdemo": "kgdemo15062024", "plain": "plain"}


def test_small_ones(spark, rows):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at int, v string")
    assert rows(names.keep_latest(t, "k", F.col("at"))) == [("a", 2, "y"), ("b", 1, None)] and rows(names.duplicated(t, "k")) == [("a", 2)]
    ties = retrieve.summary(spark.createDataFrame([("b", "p", 2), ("a", "p", 2), ("c", "p", 1)], "entity string, predicate string, count long"), k=2)
    assert [r.entity for r in ties.collect()] == ["a", "b"]
    assert classify.columns(spark.createDataFrame([("t", 0, None)], "table_id string, col_id int, value string")).first().probability == 0


def test_closure_from_one_root_and_from_a_table(spark, rows, tmp_path):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("E", "D"), ("E", "D")], "child string, parent string")
    assert rows(C.above(edges, "E")) == [("D",), ("E",)] and rows(C.below(edges, "D")) == [("A",), ("B",), ("C",), ("D",), ("E",)]
    asked = spark.createDataFrame([("B",), ("E",)], "item string")
    assert rows(C.outside(edges, asked)) == [("A",), ("C",), ("D",)]
    computed = rows(C.stored_or_computed(edges, f"{tmp_path}/none"))
    C.closure(edges).write.parquet(f"{tmp_path}/closure")
    assert rows(C.stored_or_computed(edges, f"{tmp_path}/closure")) == computed


def test_descriptions_by_language(spark):
    found = spark.sql("SELECT map('en', 'a', 'de', 'b') AS d UNION ALL SELECT map('fr', 'c', 'de', 'b') UNION ALL SELECT cast(null AS map<string, string>)")
    assert sorted(r[0] for r in found.select(names.described(F.col("d"))).collect()) == ["", "a", "b"]


def test_companies_as_a_snapshot(spark, tmp_path):
    """A company list is found by name, with its rank, description and literals; a repeated permalink counts once."""
    main = spark.createDataFrame([("a", "Acme Works", "x", "5"), ("a", "Acme Works", "x", "5"), ("b", "Other Works", None, None), (None, "No Key", None, "1")], "permalink string, name string, alias1 string, size string")
    extra = company_csv.latest_extra(spark.createDataFrame([("a", "u", "makes things", 7.0)], "permalink string, cb_url string, description string, rank double"))
    engine.build_companies(main, extra, str(tmp_path), "companies", "20240101")
    graph = engine.KnowledgeGraph(spark, str(tmp_path), "companies")
    assert sorted((r.entity, r.description, r.popularity) for r in graph.table("items").collect()) == [("a", "makes things", 7), ("b", "", 0)]
    found = graph.lookup(["acme works"]).collect()
    assert {r.id for r in found} == {"a", "b"} and max(found, key=lambda r: r.ed_score).id == "a"
    assert {(r.subject, r.predicate, r.value) for r in graph.table("literals").collect()} == {("a", "size", "5")}


def test_lines_by_number(spark, tmp_path):
    """Numbers follow the files' names and the lines in them, however the files are split."""
    folder = tmp_path / "in"
    folder.mkdir()
    said = [json.dumps({"id": f"Q{k}", "labels": {"en": {"language": "en", "value": "x" * (k % 50)}}}) + "," for k in range(3000)]
    for name, part in (("a", said[:10]), ("b", said[10:2500]), ("c", []), ("d", said[2500:])):
        (folder / f"{name}.json").write_text("".join(x + "\n" for x in part), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = dump.numbered(spark, str(folder)).collect()
        assert {r.line: r.value for r in found} == dict(enumerate(said)) and len(found) == 3000
        assert sorted(r.value for r in dump.skipped(spark, str(folder), 2499).collect()) == sorted(said[2499:]) and dump.skipped(spark, str(folder), 9999).count() == 0
        assert sorted(r.value for r in dump.resumed(spark, str(folder), "Q777").collect()) == sorted(said[777:]) and dump.resumed(spark, str(folder), "Q9999").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in dump.piped(spark, iter(["a\n", "b\r\n", "c"]), lot=2).orderBy("value").collect()] == ["a", "b", "c"] and dump.piped(spark, []).count() == 0


def test_counters(spark):
    raw = spark.createDataFrame([(x,) for x in dump_lines()], "value string")
    counted = dump.counters(raw).first()
    assert (counted.lines, counted.entities, counted.errors, counted.edges, counted.literals) == (11, 6, 0, 5, 5)
    assert tuple(dump.counters(raw.filter("false")).first()) == (0, 0, 0, 0, 0, None)


def test_extending_is_building_from_all_lines(spark, rows, built, tmp_path):
    """Whatever comes first, and however often lines come again."""
    raw = spark.createDataFrame([(x,) for x in dump_lines()], "value string")
    engine.build(raw.filter("value NOT LIKE '%\"Q10\",%' OR value IS NULL"), str(tmp_path), "wikidata", "20240101")
    for date in ("20240202", "20240303", "20240303"):
        engine.extend(raw, str(tmp_path), "wikidata", date)
    whole, grown = engine.KnowledgeGraph(spark, built), engine.KnowledgeGraph(spark, str(tmp_path))
    for name in snapshots.TABLES:
        texts = [sorted(r[0] for r in g.table(name).select(F.to_json(F.struct(*sorted(g.table(name).columns)))).collect()) for g in (whole, grown)]
        assert texts[0] == texts[1], name
    with pytest.raises(ValueError):
        engine.extend(raw, str(tmp_path), "wikidata", "20230101")


def test_build_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "dump.json").write_text("\n".join(x for x in dump_lines() if x is not None), encoding="utf-8")
    cli.main(["--root", f"{tmp_path}/kg", "build", f"{tmp_path}/dump.json", "20240101", "--resume-from", "Q3"])
    assert sorted(r.entity for r in engine.KnowledgeGraph(spark, f"{tmp_path}/kg").table("items").collect()) == ["Q3", "Q4", "Q5"]
    cli.main(["--root", f"{tmp_path}/kg", "build", f"{tmp_path}/dump.json", "20240102", "--add", "--skip-lines", "2"])
    assert sorted(r.entity for r in engine.KnowledgeGraph(spark, f"{tmp_path}/kg").table("items").collect()) == ["Q10", "Q3", "Q4", "Q5"]


def test_closure_takes_few_rounds(spark, rows, monkeypatch):
    """A chain of 40 edges, a cycle and a diamond with a short cut: least depths, in as many tables as a number of 6 bits needs."""
    edges = [(f"n{k:02}", f"n{k + 1:02}") for k in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "n38"), ("p", "q"), ("p", "r"), ("q", "s"), ("r", "s"), ("s", "t"), ("t", "u"), ("p", "t")]
    above = {x: {y for c, y in edges if c == x} for x, _ in edges}
    expected = []
    for x in above:
        seen, last, depth = {}, {x}, 0
        while last:
            depth, last = depth + 1, {z for y in last for z in above.get(y, ())} - set(seen)
            seen |= dict.fromkeys(last, depth)
        expected += [(x, y, k) for y, k in seen.items()]
    made = []
    monkeypatch.setattr(C, "written", lambda df, name, f=C.written: made.append(name) or f(df, name))
    table = spark.createDataFrame(edges, "child string, parent string")
    assert rows(C.closure(table)) == sorted(expected, key=repr) and len(made) <= 8
    for rounds, ends in ((40, False), (41, True)):
        if ends:
            assert C.closure(table, max_rounds=rounds).count() == len(expected)
        else:
            with pytest.raises(RuntimeError):
                C.closure(table, max_rounds=rounds)


def test_classes_of_items_are_not_shuffled_one_by_one(spark, rows):
    """Instances with classes that share ancestors, that have none or are null; each class once."""
    hierarchy = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "B")], "child string, parent string")
    pairs = C.closure(hierarchy)
    instances = spark.createDataFrame([("x", "A"), ("x", "D"), ("x", "A"), ("y", "Z"), ("z", None), ("B", "A")], "child string, parent string")
    found = C.of_instances(instances, hierarchy, pairs)
    assert rows(found) == sorted([("x", c) for c in "ABCD"] + [("y", "Z"), ("z", None), ("A", "B"), ("A", "C"), ("D", "B"), ("D", "C"), ("B", "A"), ("B", "B"), ("B", "C")], key=repr)
    types = C.extended_types(instances.toDF("entity", "type"), pairs)
    assert rows(types) == sorted([("x", c) for c in "ABCD"] + [("y", "Z"), ("z", None), ("B", "A"), ("B", "B"), ("B", "C")], key=repr)
    for table in (found, types):
        dealt = [x for x in table._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
        assert dealt and not any(f"{table.columns[1]}#" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt)


@pytest.mark.parametrize("name", ["summary_objects_asc", "summary_objects_desc", "kg_recognise"])
def test_groups_of_a_task_do_not_grow_with_the_input(spark, rows, monkeypatch, name):
    """However few shuffle partitions a session has, grouped rows are dealt by the size of the files, and nothing deals them anew."""
    import re

    from kgspark import catalog_queries
    from kgspark.plans import tables

    monkeypatch.setattr(tables, "GROUPED_AT_ONCE", 1 << 40)
    expected = rows(catalog_queries.queries()[name](spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(tables, "GROUPED_AT_ONCE", 1 << 13)
    found = catalog_queries.queries()[name](spark, "/root/testdata/sf0.001")
    dealt = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (\w+)", found._jdf.queryExecution().executedPlan().toString())
    assert len(dealt) >= 3 and all(int(n) > 8 and how == "REPARTITION_BY_NUM" for n, how in dealt)
    assert rows(found) == expected


@pytest.mark.parametrize("name", ["dump_literals", "dump_items", "dump_edges", "dump_type_edges"])
def test_lines_of_a_small_file_are_made_by_all_tasks(spark, name):
    """Tables of one row group each: their lines are made and parsed in more tasks than one a table."""
    from kgspark import catalog_queries

    found = catalog_queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 8


def test_a_line_is_parsed_once(spark):
    raw = spark.createDataFrame([(x,) for x in dump_lines()], "value string")
    for table in (dump.literals(dump.parsed(raw)), dump.items(dump.parsed(raw))):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
