import re

import pytest

from mirepoix.catalog import QUERIES
from mirepoix.functions import suitability as S
from mirepoix.operators import declarations, graph
from mirepoix.sources import readers

HEAD = '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s">\n'
OBO = "http://purl.obolibrary.org/obo/"


def test_classes_of_an_ontology(spark, tmp_path):
    one = f"""{HEAD}<owl:Class rdf:about="{OBO}X_1"><rdfs:label xml:lang="en"> milk &amp; food </rdfs:label><rdfs:label>second</rdfs:label><rdfs:subClassOf rdf:resource="{OBO}X_2"/><rdfs:subClassOf rdf:resource="{OBO}X_2"/>
<rdfs:subClassOf><owl:Restriction><owl:onClass><owl:Class rdf:about="http://inner/1"/></owl:onClass></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="http://else.org/y"><rdfs:label> </rdfs:label><rdfs:subClassOf rdf:resource="{OBO}X_1"/></owl:Class><owl:Class><rdfs:label>anonymous</rdfs:label></owl:Class></rdf:RDF>"""
    many = HEAD + "".join(f'<owl:Class rdf:about="{OBO}N_{i}"><rdfs:label>n {i}</rdfs:label><rdfs:subClassOf rdf:resource="{OBO}N_{i // 2}"/></owl:Class>\n' for i in range(1, 4000)) + "</rdf:RDF>"
    (tmp_path / "a.owl").write_text(one)
    (tmp_path / "b.owl").write_text(many)
    nodes, edges = readers.ontology(spark, str(tmp_path))
    got, links = {r.uri: (r.id, r.label) for r in nodes.collect()}, [tuple(r) for r in edges.collect()]
    assert got == {f"{OBO}X_1": ("X_1", "milk & food"), f"{OBO}X_2": ("X_2", None), "http://else.org/y": ("http://else.org/y", None), f"{OBO}N_0": ("N_0", None)} | {f"{OBO}N_{i}": (f"N_{i}", f"n {i}") for i in range(1, 4000)}
    assert len(links) == 4001 and set(links) == {("X_1", "X_2"), ("http://else.org/y", "X_1")} | {(f"N_{i}", f"N_{i // 2}") for i in range(1, 4000)}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.owl").write_text(HEAD + "</rdf:RDF>")
    assert [t.count() for t in readers.ontology(spark, str(tmp_path / "none"))] == [0, 0]


def test_suitability_of_foods(spark):
    items = {1: "whey powder", 2: "coconut milk", 3: "brown lentils", 4: "wheat and gluten-free baking mix", 5: "*note: usually gluten-free; check the label", 6: "vegan sausages", 7: None, 8: "paneer", 9: "butternut squash", 10: "plant  based mince", 11: "fishes"}
    taxonomy = graph.reachable(spark.createDataFrame([("3", "pulses"), ("pulses", "FOODON_00001015"), ("8", "cheese"), ("cheese", "FOODON_00001256"), ("7", "FOODON_00002671")], "c string, p string"), "c", "p")
    evidence = spark.createDataFrame([("8", "milk", ["taxonomy"]), ("3", "gluten", ["keyword"]), ("9", "celery", ["label", "keyword"]), ("3", None, ["label"])], "item string, allergen string, sources array<string>")
    rows = declarations.suitability(spark.createDataFrame([(str(i), n) for i, n in items.items()], "item string, name string"), evidence, taxonomy, "item", "name").collect()
    got = {(int(r["item"]), r["group"]): (r.status, r.reasons, r.sources) for r in rows}
    meat = ("not_suitable", ["FOODON_00002671"], ["rules", "taxonomy"])
    assert got == {
        (1, "vegan"): ("not_suitable", ["whey"], ["rules"]), (3, "vegan"): ("suitable", ["FOODON_00001015"], ["taxonomy", "rules"]), (3, "vegetarian"): ("suitable", ["FOODON_00001015"], ["taxonomy", "rules"]),
        (4, "coeliac"): ("suitable", [S.EXPLICIT], ["rules"]), (6, "vegan"): ("suitable", [S.EXPLICIT], ["rules"]), (6, "vegetarian"): ("suitable", [S.EXPLICIT], ["rules"]),
        (7, "vegan"): meat, (7, "vegetarian"): meat, (8, "vegan"): ("not_suitable", ["milk", "FOODON_00001256"], ["rules", "taxonomy", "allergen_evidence"]),
        (10, "vegan"): ("suitable", [S.EXPLICIT], ["rules"]), (10, "vegetarian"): ("suitable", [S.EXPLICIT], ["rules"]), (11, "vegan"): ("not_suitable", ["fish"], ["rules"]), (11, "vegetarian"): ("not_suitable", ["fish"], ["rules"]),
    }


def test_declarations_follow_their_evidence(spark):
    schema = "declaration_id string, item int, allergen string, declaration_type string, classification_version string, presence string, evidence_status string, sources array<string>, classes array<string>, terms array<string>, created_at string, updated_at string, more int"
    id_ = lambda item, allergen, version="v1": f"ingredient:{item}:allergen:{allergen}:version:{version}"
    row = lambda item, allergen, kind=declarations.INFERRED, version="v1", terms=(): (id_(item, allergen, version), item, allergen, kind, version, "contains", "inferred", ["taxonomy"], ["c"], list(terms), "then", "then", 5)
    stored = spark.createDataFrame([row(1, "milk"), row(2, "milk", terms=["old"]), row(3, "egg"), row(4, "egg", kind="label"), row(1, "milk", version="v0")], schema)
    evidence = spark.createDataFrame([(1, "milk", ["taxonomy"], ["c"], None), (2, "milk", ["taxonomy"], ["c"], ["new"]), (9, "soy", None, None, None), (None, "soy", None, None, None)], "item int, allergen string, sources array<string>, classes array<string>, terms array<string>")
    got = {(r["item"], r.allergen, r.classification_version): (r.declaration_id, r.outcome, r.sources, r.terms, r.created_at, r.updated_at, r.more) for r in declarations.declared(stored, evidence, "item", "v1", "now").collect()}
    assert got == {
        (1, "milk", "v1"): (id_(1, "milk"), "unchanged", ["taxonomy"], [], "then", "then", 5), (2, "milk", "v1"): (id_(2, "milk"), "updated", ["taxonomy"], ["new"], "then", "now", 5), (3, "egg", "v1"): (id_(3, "egg"), "stale", ["taxonomy"], [], "then", "then", 5),
        (4, "egg", "v1"): (id_(4, "egg"), "kept", ["taxonomy"], [], "then", "then", 5), (1, "milk", "v0"): (id_(1, "milk", "v0"), "kept", ["taxonomy"], [], "then", "then", 5), (9, "soy", "v1"): (id_(9, "soy"), "created", ["legacy"], [], "now", "now", None),
    }


@pytest.mark.parametrize("query", ["group_suitability", "declaration_outcomes", "allergen_evidence_merged"])
def test_what_is_as_long_as_the_foods_is_not_broadcast(spark, query):
    found = QUERIES[query](spark, "/root/testdata/sf0.001")
    found.collect()
    joins = re.findall(r"(\w+Join) .*(LeftOuter|LeftSemi)", found._jdf.queryExecution().executedPlan().toString())  # as it ran
    assert joins and {kind for kind, _ in joins} == {"SortMergeJoin"}
