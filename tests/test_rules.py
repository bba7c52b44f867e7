import json
import random
import re
import time

import pytest
from plumbline.functions import text as X
from plumbline.operators import annotations as A
from plumbline.operators import corpus as C
from plumbline.operators import responses as P
from plumbline.operators import rules as R
from plumbline.operators import sheets as H
from plumbline.plans import queries as Q
from plumbline.plans import workflow
from plumbline.sources import files, sinks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
UNITS = [("900mm", 900), ("0.9 m", 900), ("900", 900), ('36"', 914.4), ("90cm", 900), ("3'-0\"", 914.4000000000001), ("varies", None), ("", None), ("850-900mm", -900), ("1,100 mm", 100), ('36 1/2"', 50.8), ("3'-6 1/2\"", 1066.8), ("12 m²", 12000), ("3 ft", 3), (".9 m", 9000), ("2.03 m", 2029.9999999999998), ("7 feet 6 inches", 152.4), (None, None)]
SHEET = {
    "sheet_name": "A", "file_type": "pdf", "doors": [{"location": "Main exit", "width": "600 mm"}, {"location": "Bedroom 1", "width": "500 mm"}], "corridors": [{"location": "Hallway", "width": "700 mm", "length": "5 m"}],
    "stairs": [{"location": "Main stair", "width": "700 mm", "rise": "230 mm", "run": "210 mm"}], "egress_paths": [{"from": "Bedroom 1", "to": "Main exit", "width": "600 mm"}], "rooms": [],
    "dimensions": [{"element": "Ceiling height", "value": "1.9", "unit": "m"}], "occupancy_type": "single-detached dwelling", "building_type": "Part 9 residential, 2 storeys",
}


def sheets(spark, tmp_path, *docs):
    (tmp_path / "s.json").write_text("\n".join(json.dumps(d) for d in docs))
    return spark.read.schema(R.SHEET).json(str(tmp_path / "s.json"))


def test_units(spark):
    got = spark.createDataFrame([(r, None if v is None else float(v)) for r, v in UNITS], "raw string, mm double").select("raw", "mm", X.parse_to_mm(F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got) for r in got if (r.got is None) != (r.mm is None) or r.mm is not None and abs(r.got - r.mm) > 1e-9] == []


def test_sheet_end_to_end(spark, tmp_path):
    found = R.violations(R.flatten_sheets(sheets(spark, tmp_path, SHEET)), R.curated_rules(spark))
    assert sorted((r.location_hint, r.section_id) for r in found.collect()) == sorted([("Main stair", "9.8.4.1"), ("Main stair", "9.8.4.2"), ("Main stair", "9.8.2.1"), ("Main exit", "9.5.3"), ("Bedroom 1", "9.5.3"), ("Hallway", "9.9.3.3"), ("Bedroom 1→Main exit", "9.9.3.2"), ("Ceiling height", "9.5.3.1")])
    assert R.summary(found).first().asDict() == {"critical": 0, "major": 4, "minor": 4, "compliance": 8, "consistency": 0}


def test_stream_gives_the_same(spark, tmp_path):
    from plumbline.streaming import sheets as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.json").write_text(json.dumps(SHEET))
    q = S.write_violations(S.violations_of_stream(spark, str(tmp_path / "in"), R.curated_rules(spark)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


@pytest.mark.parametrize("few,join", [(10_000, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_rules_join(spark, monkeypatch, few, join):
    """Few rules are broadcast on type and attribute, whatever Spark knows of their size; many meet parts of the elements."""
    monkeypatch.setattr(R, "RULES", few)
    plan = Q.found(spark, SF)._jdf.queryExecution().executedPlan().toString()
    own = [x for x in plan.split("\n") if "element_type" in x and "Join" in x]
    assert own and all(join in x and "attribute" in x for x in own) and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("hashpartitioning(type") == 0
    # each unit's pattern stands once in the plan: measures are not parsed again by a filter
    assert sum("inch(?:es)?" in x for x in plan.split("\n")) == 1


def test_many_rules_give_the_same(spark, monkeypatch):
    want = sorted(map(str, Q.found(spark, SF).collect()))
    monkeypatch.setattr(R, "RULES", 0)
    assert sorted(map(str, Q.found(spark, SF).collect())) == want


def test_headings(spark):
    text = "intro\n9.9.3.3 Width of Corridors\nbody\n9.9.3.3. Not a heading\n1.5 m wide\nx\nArticle 123\ny"
    got = C.sections(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("ordinal").collect()
    assert [(r.section_id, r.section_title, r.content) for r in got] == [("preamble", "Preamble", "intro"), ("9.9.3.3", "Width of Corridors", "body\n9.9.3.3. Not a heading"), ("1.5", "m wide", "x"), ("1", "23", "y")]


def test_split_keeps_text(spark):
    text = "\n\n".join("p%d " % i * 30 for i in range(12))
    s = spark.createDataFrame([(1, "9.1", "t", text)], "k int, section_id string, section_title string, content string")
    got = C.split_oversized(s, 100).orderBy(F.length("section_id"), "section_id").collect()
    assert len(got) > 1 and got[0].section_id == "9.1#1"
    assert "".join("".join(r.content.split()) for r in got) == "".join(text.split())


@pytest.mark.parametrize("raw,n", [('[{"a":1},{"b":2},{"c', 2), ("```json\n[1]\n```", 1), ('x [{"a":"}"}] y', 1), ("none", 0), (None, 0)])
def test_repair(raw, n):
    assert len(P.repair(raw)) == n


def test_annotation_routes(spark):
    notes = spark.createDataFrame([(1, 0, "A Bedroom\nKitchen NPT = +0.15   Basement plan\n900 mm\n1.25 m\nP1 0.9 m\nkitchen NPT = +0.15")], "k int, pos int, text string")
    got = {(r.bucket, r.text) for r in A.categorize(notes, "k", "text").collect()}
    assert got == {("levels", "NPT = +0.15"), ("other", "Kitchen"), ("totals", "Basement plan"), ("other", "900 mm"), ("dimensions", "1.25 m"), ("doors", "P1 0.9 m")}


def blank(name, **parts):
    return {"sheet_name": name, "file_type": "pdf", "occupancy_type": "residential dwelling", **{c: [] for c in H.ARRAYS}, **parts}


# fixed values: the rules and sheets of the rule engine's own test, (section, element, attribute, operator, value, upper, severity)
TEST_RULES = [
    ("9.8.4.2", "stair", "run_depth_mm", "gte", 235, None, "major"), ("9.8.4.1", "stair", "rise_mm", "between", 125, 200, "major"), ("9.8.3.1", "stair", "width_mm", "gte", 860, None, "major"), ("9.6.3.1", "door", "width_mm", "gte", 810, None, "major"),
    ("9.9.3.3", "corridor", "width_mm", "gte", 860, None, "minor"), ("9.5.3.1", "room", "ceiling_height_mm", "gte", 2030, None, "major"), ("9.8.8.3", "guard", "height_mm", "gte", 900, None, "critical"),
]
VIOLATING = [
    blank("v1", stairs=[{"location": "S-1", "run": "220mm"}]), blank("v2", stairs=[{"location": "S-2", "rise": "210mm"}]), blank("v3", stairs=[{"location": "S-3", "rise": "110mm"}]), blank("v4", stairs=[{"location": "S-4", "width": "800mm"}]),
    blank("v5", doors=[{"location": "D-1", "width": "750mm"}]), blank("v6", doors=[{"location": "D-2", "width": '30"'}]), blank("v7", corridors=[{"location": "C-1", "width": "0.8 m"}]), blank("v8", dimensions=[{"element": "ceiling height", "value": "1.9", "unit": "m"}]),
    blank("v9", dimensions=[{"element": "guard height", "value": "850", "unit": "mm"}]), blank("v10", stairs=[{"location": "S-5", "run": "200mm", "width": "820mm"}]),
]
CLEAN = [
    blank("p1", stairs=[{"location": "S-1", "run": "255mm"}]), blank("p2", stairs=[{"location": "S-2", "rise": "180mm"}]), blank("p3", stairs=[{"location": "S-3", "width": "900mm"}]), blank("p4", doors=[{"location": "D-1", "width": "900mm"}]),
    blank("p5", doors=[{"location": "D-2", "width": '36"'}]), blank("p6", corridors=[{"location": "C-1", "width": "1.1 m"}]), blank("p7", dimensions=[{"element": "ceiling height", "value": "2.4", "unit": "m"}]),
    blank("p8", dimensions=[{"element": "guard height", "value": "1070", "unit": "mm"}]), blank("p9", stairs=[{"location": "S-5", "run": "280mm", "rise": "180mm", "width": "900mm"}]), blank("p10", rooms=[{"name": "Bedroom", "area": "12 m²"}]),
]


@pytest.mark.parametrize("curated", [False, True])
def test_violating_and_clean_sheets(spark, tmp_path, curated):
    """Eleven violations on ten sheets and none on ten others, under the test's rules and under the curated ones."""
    rows = [(f"t{i}", s, None, "9", None, e, a, op, float(v), None if m is None else float(m), None, sev, "{value}") for i, (s, e, a, op, v, m, sev) in enumerate(TEST_RULES)]
    rules = R.curated_rules(spark) if curated else R.with_defaults(spark.createDataFrame(rows, R.RULE))
    found = R.violations(R.flatten_sheets(sheets(spark, tmp_path, *VIOLATING, *CLEAN)), rules).collect()
    per = {s["sheet_name"]: sum(r.affected_sheets == [s["sheet_name"]] for r in found) for s in [*VIOLATING, *CLEAN]}
    assert per == {**{f"v{i}": 1 for i in range(1, 10)}, "v10": 2, **{f"p{i}": 0 for i in range(1, 11)}}
    if not curated:
        assert {r.description for r in found if r.affected_sheets == ["v6"]} == {"762"} and all("NBC_Alberta_2019 Part 9" in r.code_citation for r in found)


def test_planted_contradictions(spark, tmp_path):
    """Two sheets of a project: a door's width differs and a stair is on one of them only."""
    a = blank("A-1", doors=[{"location": "D-01", "width": "900mm"}, {"location": "D-02", "width": "800mm"}], corridors=[{"location": "Hall A-1", "width": "1100mm", "length": "6000mm"}], dimensions=[{"element": "Bedroom 1 ceiling", "value": "2500", "unit": "mm"}])
    b = blank("A-2", doors=[{"location": "D-01", "width": "850mm"}, {"location": "D-02", "width": "800mm"}], stairs=[{"location": "S-1", "width": "900mm", "rise": "180mm", "run": "250mm"}], dimensions=[{"element": "Bedroom 1 ceiling", "value": "2400", "unit": "mm"}])
    e = R.flatten_sheets(sheets(spark, tmp_path, a, b))
    got = {(r.type, r.id, r.sheet_a, r.value_a, r.sheet_b, r.value_b) for r in R.conflicts(e).collect()}
    assert got == {("door", "D-01", "A-1", 900.0, "A-2", 850.0), ("room", "Bedroom 1 ceiling", "A-1", 2500.0, "A-2", 2400.0)}
    lacks = {(r.type, r.id, r.sheet) for r in R.missing_elements(e.withColumn("project", F.lit(1)), "project").collect()}
    assert ("stair", "S-1", "A-1") in lacks and ("corridor", "Hall A-1", "A-2") in lacks and not any(i == "D-01" for _, i, _ in lacks)
    found = R.violations(e, R.curated_rules(spark))
    assert sorted((r.affected_sheets[0], r.location_hint, r.section_id) for r in found.collect()) == [("A-1", "D-02", "9.5.3"), ("A-2", "D-02", "9.5.3"), ("A-2", "S-1", "9.8.4.2")]


def test_rules_from_json(spark, tmp_path):
    """The curated rules, written as a JSON array, read back with their ids, messages and defaults; upsert validates."""
    rows = [{"id": i, "section": s, "title": t, "part": "9", "element_type": e, "attribute": a, "operator": op, "value": v, **({} if m is None else {"value_max": m}), "severity": sev, "message": msg} for i, s, t, e, a, op, v, m, sev, msg in R.CURATED]
    (tmp_path / "rules.json").write_text(json.dumps(rows, indent=2))
    got = files.read_rules(spark, str(tmp_path / "rules.json"))
    assert sorted(map(str, got.drop("conditions").collect())) == sorted(map(str, R.curated_rules(spark).drop("conditions").collect()))
    old = str(tmp_path / "old")
    got.where("element_type = 'stair'").withColumn("message", F.lit("old")).write.parquet(old)
    assert sinks.upsert_rules(spark, got, old, str(tmp_path / "new")) == 9
    new = spark.read.parquet(str(tmp_path / "new"))
    assert new.count() == 9 and new.where("message = 'old'").count() == 0
    with pytest.raises(ValueError, match="bad operator"):
        sinks.upsert_rules(spark, got.withColumn("operator", F.lit("near")), old, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_upsert_of_more_than_a_million_parts(spark, tmp_path, duck):
    """Ids of added rows that are ids of parts too: none of the parts is lost."""
    spark.range(999_990, 1_000_020).unionByName(spark.range(0, 30)).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = Q.QUERIES["rule_upsert"](spark, str(tmp_path)).collect()
    want = duck.execute(Q.SQL["rule_upsert"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall()
    assert sorted((r.id, r.version) for r in got) == sorted(want) and len(got) == 80
    old, new = spark.createDataFrame([("a", 1, "o"), ("b", 1, "o"), ("a", None, "o")], "k string, id int, v string"), spark.createDataFrame([("a", 1, "n"), ("c", 1, "n")], "k string, id int, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["k", "id"]).collect()), key=str) == [("a", 1, "n"), ("a", None, "o"), ("b", 1, "o"), ("c", 1, "n")]


def test_number_text(spark):
    want = {900.0: "900", 914.4000000000001: "914.4000000000001", 1e7: "10000000", 12345678.5: "12345678.5", 1.5e20: "150000000000000000000", 1e21: "1e+21", 0.0005: "0.0005", 1.5e-5: "0.000015", 1e-6: "0.000001", 1.5e-7: "1.5e-7", -2.5e-4: "-0.00025", 0.0: "0"}
    got = spark.createDataFrame([(v,) for v in want], "d double").select("d", X.number_text(F.col("d")).alias("t")).collect()
    assert {r.d: r.t for r in got} == want


def test_sql_functions(spark):
    X.register(spark)
    row = spark.sql("SELECT parse_to_mm('3 m') a, parse_to_mm(NULL) b, building_part('assembly', NULL) c, dimension_attribute('Stair RISE') d, dimension_attribute('x') e").first()
    assert tuple(row) == (3000.0, None, "Part3", "stair.rise_mm", None)
    spark.createDataFrame([("a", "9.1", "t", "c", [1.0, 0.0]), ("b", "9.2", "t", "c", [0.8, 0.6]), ("z", "9.3", "t", "c", [0.0, 0.0])], "id string, section_id string, section_title string, content string, embedding array<float>").createOrReplaceTempView("probe_chunks")
    C.register_match(spark, "probe_chunks")
    assert [r.id for r in spark.sql("SELECT * FROM match_code_chunks(array(1F, 0F)) ORDER BY similarity DESC").collect()] == ["a", "b"]
    assert spark.sql("SELECT * FROM match_code_chunks(array(0F, 0F), 0.0D, 1)").count() == 0  # similarity with nothing is null
    assert [r.id for r in spark.sql("SELECT * FROM match_code_chunks(array(1F, 0F), 0.0D, 1)").collect()] == ["a"]


def test_match_for_a_table_of_queries(spark):
    """The same as the SQL function called laterally, odd vectors and ties by id as text included; no join of each query with each chunk."""
    rows = [(i, f"9.{i % 3}", "t", f"c{i}", [float(i % 7) - 3, float(i % 5) - 2]) for i in range(60)] + [(100, None, None, None, None), (101, "9", "t", "c", [0.0, 0.0]), (102, "9", "t", "c", [1.0, None]), (103, "9", "t", "c", [])]
    pool = spark.createDataFrame(rows, "id long, section_id string, section_title string, content string, embedding array<float>")
    pool.createOrReplaceTempView("lateral_chunks")
    C.register_match(spark, "lateral_chunks")
    asked = pool.selectExpr("id AS query_id", "embedding AS q").where("id % 10 = 0 OR id > 100")
    got = C.match_chunks(asked, pool, 0.2, 4)
    want = spark.sql("SELECT query_id, m.* FROM {asked} a, LATERAL match_code_chunks(a.q, 0.2D, 4) m", asked=asked)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 15
    plan = workflow.vector_topk_lateral(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "row_number" in plan


def test_retrieve_branches(spark):
    """Prefix kept, prefix without a match, no vector above the threshold, no vector at all, and nothing found."""
    chunks = spark.createDataFrame([("a", "9.1", "Stairs", "rise and run", [1.0, 0.0]), ("b", "3.1", "Doors", "swing of the door", [0.9, 0.1]), ("c", "3.2", "Exits", "corridor width", [0.0, 1.0]), ("d", None, "Door", "door", None)], "id string, section_id string, section_title string, content string, embedding array<float>")
    queries = spark.createDataFrame([("own", "x", [1.0, 0.0], "3."), ("none", "x", [1.0, 0.0], "5."), ("free", "x", [1.0, 0.0], None), ("low", "door swing", [-1.0, 0.0], "3."), ("words", "the door", None, None), ("nothing", "zzzz", None, "9.")], "query_id string, query string, q array<float>, prefix string")
    got = {}
    for r in C.retrieve(queries, chunks, 8, 0.3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.path))
    assert {k: [i for _, i, _ in sorted(v)] for k, v in got.items()} == {"own": ["b"], "none": ["a", "b"], "free": ["a", "b"], "low": ["b"], "words": ["b", "d"]}
    assert {k for k, v in got.items() if v[0][2] == "keyword"} == {"low", "words"}
    one = C.retrieve(queries.where("query_id = 'free'"), chunks, 1, 0.3).collect()
    assert [r.id for r in one] == ["a"]


def test_category_queries(spark):
    s = spark.createDataFrame([(1, "dwelling", None), (2, "assembly", None), (3, None, None)], "k int, occupancy_type string, building_type string")
    got = C.category_queries(s, "k").withColumn("terms", X.keyword_terms(F.col("query"))).collect()
    assert {(r.k, r.prefix) for r in got} == {(1, "9."), (2, "3."), (3, None)} and len(got) == 15
    assert {tuple(r.terms) for r in got if r.k == 1} == {("part", "housing", "dwelling", "unit")} and {tuple(r.terms) for r in got if r.k == 2} == {("part", "fire", "protection", "major")}
    assert [r.terms for r in sorted(got, key=lambda r: r.place) if r.k == 3] == [["egress", "corridor", "exit", "access"], ["door", "swing", "direction", "fire"], ["corridor", "dead", "fire", "separation"], ["stair", "rise", "handrail", "guardrail"], ["occupancy", "classification", "group", "major"]]


@pytest.mark.parametrize("raw,want", [
    ("[" * 200000, []), ("{" * 3000, []), ("[NaN]", []), ('{"a": Infinity}', []), ('[{"a":{"x":"}{"}},{"b":"\\"}"},{"c":"uncl{}\\', [{"a": {"x": "}{"}}, {"b": '"}'}]), ('[ } {"a":1}, {', []), ('[{"a":1}} {"b":2}, {', [{"a": 1}]),
    ('{"a":1,"a":2}', {"a": 2}), ('{"a":1} [2]', []), ("```JSON\n{}\n```", {}), ("x ] [", []), ("", []),
])
def test_repair_odd(raw, want):
    assert P.repair(raw) == want


@pytest.mark.parametrize("raw", ["[" * 200_000, "{" * 200_000, "x" + "[" * 200_000 + "x", "```" + " " * 200_000, '["' + "\\\\" * 100_000, '[{"a":1},' * 50_000, "[" * 100_000 + "]" * 100_000, "`" * 200_000])
def test_repair_is_linear(raw):
    start = time.process_time()
    P.repair(raw)
    assert time.process_time() - start < 2


def test_repair_deep_and_long():
    deep = '{"description":"d","x":' + "[" * 60_000 + "]" * 60_000 + ', "n": [1, -2.5e3, true, null, "\\u00e9", {}]}'
    value = P.repair(deep)
    assert value["description"] == "d" and value["n"] == [1, -2500, True, None, "é", {}] and P.to_text(value).count("[") == 60_001
    for broken in (deep[:-1], deep + "]", deep.replace(':"d"', '"d"'), deep.replace("true,", "true"), deep.replace("{}", "{,}"), deep.replace("null", "nul"), deep.replace(', "n"', ", n")):
        assert not P._load(broken)[1]
    long = '[{"description":"a","n":' + "9" * 5000 + '},{"description":"b","n":12345678901234567890}]'
    assert P.to_text(P.repair(long)) == '[{"description":"a","n":null},{"description":"b","n":12345678901234567000}]'
    assert P.to_text(P.repair('[1.0,-0,1e21,1.5e-7,0.000001,"\\ud83d x","\\ud83d\\ude00","a\\"b"]')) == '[1,0,1e+21,1.5e-7,0.000001,"\\ud83d x","😀","a\\"b"]'


def test_half_pairs_dont_stop_the_job(spark):
    rows = spark.createDataFrame([(1, '[{"description":"\\ud83d","affected_sheets":["\\udc00",1],"section_id":"9\\ud800"}]')], "k int, raw string").withColumn("sheet", F.lit("s"))
    got = P.normalize(rows, "raw", "sheet").first()
    assert (got.description, got.affected_sheets, got.section_id) == ("\ufffd", ["\ufffd"], "9\ufffd")
    assert rows.select(P.repaired_json(F.col("raw")).alias("j")).first().j == rows.first().raw


def test_split_brute_force(spark):
    """Greedy packing of paragraphs, against a loop."""
    def packed(content, limit):
        if -(-len(content) // 4) <= limit // 4:
            return [content]
        parts, now = [], ""
        for p in re.split(r"\n\s*\n", content):
            if now and len(now) + len(p) + 2 > limit:
                parts.append(now.strip())
                now = ""
            now += p + "\n\n"
        return parts + [now.strip()] * bool(now.strip())

    whole = C.sections(Q.code_text(spark, SF), "doc_id", "body")
    got = {}
    for r in C.split_oversized(whole, 100).collect():
        got.setdefault((r.doc_id, r.ordinal), []).append((r.section_id, r.content))
    for r in whole.collect():
        parts = packed(r.content, 400)
        want = [(f"{r.section_id}#{k + 1}" if len(parts) > 1 else r.section_id, p) for k, p in enumerate(parts)]
        assert sorted(got[r.doc_id, r.ordinal]) == sorted(want)
    assert any(len(v) > 1 for v in got.values())


def test_stored_tables(spark, tmp_path):
    """Appends add up, the last state holds, ids repeat on reruns, drafts and counts read back."""
    up = spark.createDataFrame([(1, "House", "a.pdf"), (1, "House", "b.pdf"), (2, "", "c.dxf"), (3, "x", None)], "request int, project_name string, file_name string")
    made, path = sinks.plans(up), str(tmp_path / "plans")
    sinks.append(made, path)
    sinks.append(sinks.completed(made.where("project_name = 'House'")), path)
    now = sinks.current(spark.read.parquet(path)).collect()
    assert {(r.project_name, r.status) for r in now} == {("House", "complete"), ("Untitled Project", "processing")} and {r.id for r in now} == {r.id for r in sinks.plans(up).collect()}
    sheet = H.failed(spark.createDataFrame([("a.dwg", "dwg", files.DWG_ERROR)], "sheet_name string, file_type string, error string"))
    rows = sinks.plan_sheets(sheet.select(F.lit("p").alias("plan_id"), F.lit("p/a.dwg").alias("storage_path"), F.struct(*sheet.columns).alias("sheet")))
    sinks.append(rows, str(tmp_path / "sheets"))
    back = spark.read.parquet(str(tmp_path / "sheets")).first()
    assert back.extracted_data.annotations.other == ["PARSE_ERROR: " + files.DWG_ERROR] and back.extracted_data.doors == []
    assert json.loads(spark.read.parquet(str(tmp_path / "sheets")).select(H.as_json(F.col("extracted_data")).alias("j")).first().j)["sheet_name"] == "a.dwg"
    assert sinks.count_chunks(spark, str(tmp_path / "no such")) == -1 and sinks.count_chunks(spark, path) == 3
    sinks.write_drafts(C.rule_draft(spark.createDataFrame([(1, "See 9.8.2.1. Width shall be at least 0.9 m.")], "k int, t string"), "k", "t"), str(tmp_path / "drafts"))
    assert spark.read.json(str(tmp_path / "drafts")).first().asDict() == {"section": "9.8.2.1", "direction": "min", "value": 900.0, "unit": "mm", "snippet": "Width shall be at least 0.9 m."}
    bad = sinks.errors(spark.createDataFrame([(400, "no files uploaded", None)], "status int, error string, detail string")).first()
    assert (bad.status, json.loads(bad.result)) == (400, {"error": "no files uploaded"})


def test_files_and_sizes(spark, tmp_path):
    for name in ("a.PDF", "b.dwg", "c.tiff"):
        (tmp_path / name).write_bytes(b"x" * 5)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {k: r.file_type for k, r in got.items()} == {"a.PDF": "pdf", "b.dwg": "dwg", "c.tiff": "image"} and got["b.dwg"].error == files.DWG_ERROR and bytes(got["a.PDF"].content) == b"xxxxx"
    nums = [(1.005, "1.00"), (2.675, "2.67"), (0.125, "0.13"), (1e30, "1e+30"), (1.5e20, "150000000000000000000.00"), (-0.001, "-0.00"), (-0.0, "0.00"), (float("nan"), None), (float("-inf"), "-Infinity"), (99.995, "100.00"), (2.0**44 + 0.125, "17592186044416.13"), (float("inf"), "Infinity"), (None, None)]
    rows = spark.createDataFrame([(v, w) for v, w in nums], "v double, w string").select("w", files.fixed2(F.col("v")).alias("g")).collect()
    assert [(r.w, r.g) for r in rows if r.w != r.g] == []
    codes = spark.createDataFrame([(200,), (429,), (503,), (404,), (None,)], "s int").select("s", X.is_transient(F.col("s")).alias("t")).collect()
    assert [r.s for r in codes if r.t] == [429, 503]


def test_long_documents_in_blocks(spark):
    """Sections, drafts and drawings are the same however few lines a task reads; null keys too."""
    docs = Q.code_text(spark, SF).unionByName(spark.createDataFrame([(None, "9.1.1 First heading\n" + "\n".join(f"line {i}" for i in range(95)) + "\n\n9.2.3 Second heading\r\nmore.\nx"), (-1, None), (-2, "")], "doc_id long, body string"))
    docs = docs.withColumn("body", F.concat("body", F.lit(". See 9.8.2.1; at least 3 mm. And more: at most\n\nminimum 2 m")))
    want = sorted(map(str, C.sections(docs, "doc_id", "body").collect()))
    assert sorted(map(str, C.sections(docs, "doc_id", "body", 10).collect())) == want and len(want) > 700
    drafts = sorted(map(str, C.rule_draft(docs, "doc_id", "body").collect()))
    assert sorted(map(str, C.rule_draft(docs, "doc_id", "body", 3).collect())) == drafts and len(drafts) > 300
    lines = ["0", "SECTION", " 2", "HEADER", "9", "x", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", *[v for i in range(40) for v in ("0", "LINE", "8", f"layer {i}", "10", "1.5", "1", "SECTION", "2", "no section")], "0", "ENDSEC", "0", "EOF", "0"]
    drawn = spark.createDataFrame([(1, "\n".join(lines)), (None, "\r\n".join(lines)), (2, None), (3, "")], "k int, t string")
    found = sorted(map(str, files.dxf_entities(drawn, "k", "t").collect()))
    assert sorted(map(str, files.dxf_entities(drawn, "k", "t", 3).collect())) == found and len(found) == 80


def test_short_drawings_are_read_in_their_row(spark):
    """As in blocks: sections in sections, codes without values, entities before the first code 0; no drawing is shuffled."""
    rng = random.Random(5)
    lines = ["0", " 0 ", "2", "8", "10", "1", "42", "SECTION", "ENTITIES", "BLOCKS", "ENDSEC", "EOF", "LINE", "TEXT", "1.5", "", "x"]
    heads = [["0", "SECTION", "2", "ENTITIES"], ["0", "SECTION", "2", "BLOCKS"], ["0", "ENDSEC"], ["0", "LINE", "8", "a"], ["0", "SECTION"], ["0", "SECTION", "8", "ENTITIES"], ["2", "ENTITIES"], ["0"]]
    texts = [rng.choice(["\n", "\r\n"]).join(v for _ in range(rng.randint(0, 12)) for v in (rng.choice(heads) if rng.random() < 0.7 else rng.choices(lines, k=rng.randint(1, 4)))) for _ in range(600)]
    drawn = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (-1, None), (-2, "")], "k int, t string")
    got, want = files.dxf_entities(drawn, "k", "t"), files.dxf_entities(drawn, "k", "t", 1)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 60


def test_carried_brute_force(spark):
    from plumbline.operators import scan

    rows = [(k, i, None if (i * 7 + k) % 5 else f"v{i}", i % 3 == 0) for k in range(4) for i in range(k * 13)]
    df = spark.createDataFrame(rows, "k int, i int, v string, c boolean").repartition(3)
    got = {(r.k, r.i): (r.n, r.last) for r in scan.carried(df, "k", "i", F.col("k") > 1, {"n": F.col("c")}, {"last": F.col("v")}, 4).collect()}
    want, n, last = {}, 0, None
    for k, i, v, c in rows:
        n, last = (n if i else 0) + c, v or (last if i else None)
        want[k, i] = (n, last)
    assert got == want


def test_conflict_classes_count_their_pairs(spark):
    """Classes against all pairs: sheets with several values of an element, values of one sheet only, and no conflict."""
    import random

    rng = random.Random(3)
    rows = [("door", f"D{rng.randint(0, 9)}", "width_mm", f"S{rng.randint(0, 12)}", float(rng.randint(1, 3))) for _ in range(150)] + [("door", "X", "width_mm", "S1", v) for v in (1.0, 2.0)] + [("door", "Y", "width_mm", s, 1.0) for s in ("S1", "S2")]
    e = spark.createDataFrame(rows, "type string, id string, attribute string, sheet string, value_mm double")
    pairs = {}
    for r in R.conflicts(e).collect():
        pairs[r.id] = pairs.get(r.id, 0) + 1
    classes = R.conflict_classes(e).collect()
    assert {r.id: r.pairs for r in classes if r.pairs} == pairs and {r.id: r.pairs for r in classes}["X"] == 0 and not any(r.id == "Y" for r in classes)
    members = {(r.id, r.value_mm, r.sheet) for r in R.conflict_members(e).collect()}
    assert {(r.id, r.value_mm): (r.sheets, r.first_sheet) for r in classes} == {(i, v): (len(s := [x for j, w, x in members if (j, w) == (i, v)]), min(s)) for i, v, _ in members}


def test_conflict_classes_shuffle_few_elements(spark):
    """Of elements with one value, only a hash and numbers are shuffled; null beside a value is a class as before, and null keys are none."""
    rows = [("door", f"D{i // 2 if i < 20 else i}", "width_mm", f"S{i}", float(i % 3)) for i in range(4000)] + [("door", "N", "width_mm", s, v) for s, v in (("S1", None), ("S2", 1.0))] + [("door", None, "width_mm", s, v) for s, v in (("S1", 1.0), ("S2", 2.0))]
    e = spark.createDataFrame(rows, "type string, id string, attribute string, sheet string, value_mm double").localCheckpoint()
    out = R.conflict_classes(e)
    assert {(r.id, r.value_mm, r.n_values, r.pairs) for r in out.collect()} == {(f"D{i // 2}", float(i % 3), 2, 1) for i in range(20)} | {("N", v, 2, 1) for v in (None, 1.0)}
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_all_rule_errors_are_reported(spark, tmp_path):
    """1,001 errors: every one is stored, and the message names the first; without a path it has them all."""
    bad = spark.createDataFrame([tuple([f"r{i}", "9.1", "t", "9", None, "door", "a", "near", 1.0, None, None, "major", "m"]) for i in range(1001)], R.RULE)
    old, out = str(tmp_path / "old"), str(tmp_path / "new")
    R.curated_rules(spark).write.parquet(old)
    with pytest.raises(R.RuleErrors, match="100 of 1001 errors") as e:
        sinks.upsert_rules(spark, bad, old, out)
    stored = [r.value for r in spark.read.text(e.value.path).collect()]
    assert e.value.count == len(stored) == 1001 and all('bad operator "near"' in x for x in stored) and not (tmp_path / "new").exists()
    with pytest.raises(R.RuleErrors) as e:
        R.checked(bad.withColumn("i", F.substring("id", 2, 9).cast("int")))
    lines = str(e.value).split("\n")
    assert len(lines) == 1001 and lines[999].startswith("[999]")


def test_two_ingests_and_guarded_writes(spark, tmp_path):
    """Ids of runs and places; what fails a check goes to a folder of its own, counted while the rest is written."""
    chunks = spark.createDataFrame([(1, 0, "9.1", "t", "same", [1.0]), (1, 1, "9.1", "t", "same", [1.0]), (1, 2, "9.2", "t", "none", []), (2, 0, None, "t", "x", [2.0]), (2, 1, "9.3", "t", "y", None)], "doc int, ordinal int, section_id string, section_title string, content string, embedding array<double>")
    ids = [{r.id for r in sinks.chunk_rows(chunks, run=run, place=("doc", "ordinal")).collect()} for run in ("monday", "tuesday", "monday")]
    assert [len(x) for x in ids] == [3, 3, 3] and ids[0] == ids[2] and not ids[0] & ids[1]
    assert len({r.id for r in sinks.chunk_rows(chunks).collect()}) == 2
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    checks = {"embedding": sinks.embedded(), "section": F.col("section_id") != ""}
    counts = sinks.write_guarded(chunks, checks, good, bad)
    assert counts == {"rows": 5, "written": 2, "embedding": 2, "section": 1} and spark.read.parquet(good).count() == 2
    assert sorted((r.doc, r.ordinal, r.failed) for r in spark.read.parquet(bad).collect()) == [(1, 2, ["embedding"]), (2, 0, ["section"]), (2, 1, ["embedding"])]
    assert sinks.write_guarded(chunks.limit(1), checks, good, bad)["written"] == 1 and spark.read.parquet(good).count() == 3 and spark.read.parquet(bad).count() == 3
    assert sinks.ingest_counts(chunks).first() == (5, 3)


def test_streams_restart(spark, tmp_path):
    """A stream that stops between files, and one whose last batch is repeated, store each violation once; counts add up over restarts."""
    from plumbline.streaming import sheets as T

    source, out, sums = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "sums")
    source.mkdir()
    rules = R.curated_rules(spark)
    for i in range(3):
        (source / f"{i}.json").write_text(json.dumps({**SHEET, "sheet_name": f"S{i % 2}"}))
        T.write_batches(T.violations_of_stream(spark, str(source), rules), out, str(tmp_path / "c1")).awaitTermination()
        T.write_summaries(T.violations_of_stream(spark, str(source), rules), sums, str(tmp_path / "c2")).awaitTermination()
    once = R.violations(R.flatten_sheets(spark.read.schema(R.SHEET).json(str(source))), rules)
    stored = spark.read.parquet(out)
    assert sorted(map(str, stored.drop("batch").collect())) == sorted(map(str, once.collect()))
    (tmp_path / "c1" / "commits" / "2").unlink()  # the last batch was stored, and then the driver was lost
    (tmp_path / "c1" / "commits" / ".2.crc").unlink(missing_ok=True)
    T.write_batches(T.violations_of_stream(spark, str(source), rules), out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == once.count()
    want = R.summary(once.withColumn("sheet", F.element_at("affected_sheets", 1)), "sheet").collect()
    got = T.summaries(spark, sums).select("sheet", "critical", "major", "minor", "compliance", "consistency").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2


def test_fixed2_against_decimals(spark):
    """Random numbers and near ties of all sizes below 1e21, rounded from their exact binary value."""
    import random
    from decimal import ROUND_HALF_UP, Context, Decimal

    rng = random.Random(8)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 20) for _ in range(4000)] + [(rng.randint(0, 10 ** rng.randint(1, 14)) * 2 + 1) / 200 for _ in range(4000)] + [rng.randint(0, 10**9) / 2 ** rng.randint(0, 12) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", files.fixed2(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in got if r.t != str(Decimal(r.v).quantize(Decimal("0.01"), ROUND_HALF_UP, Context(prec=400)))] == []


def test_drawings_read_in_splits(spark, tmp_path):
    """Files of both line ends, cut every 64 bytes, against the same texts in one row each."""
    def drawing(n):
        return ["0", "SECTION", "2", "HEADER", "9", "x", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", *[v for i in range(n) for v in ("0", "LINE", "8", f"layer {i}", "10", f"{i}.5", "11", "2", "20", "0", "21", "7")], "0", "ENDSEC", "0", "EOF"]

    texts = {"a.dxf": "\n".join(drawing(60)), "b.dxf": "\r\n".join(drawing(25)), "c.dxf": "\n".join(drawing(0)), "d.dxf": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    whole = files.dxf_entities(spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, text string"), "path", "text")
    want = sorted(map(str, whole.collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("64", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = files.read_drawings(spark, str(tmp_path), 8)
            assert size != "64" or got.sparkSession.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
            assert sorted(map(str, got.withColumn("path", F.element_at(F.split("path", "/"), -1)).collect())) == want and len(want) == 85
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
