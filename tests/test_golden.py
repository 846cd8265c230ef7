"""Clinical ontology: golden rows of seven queries of up to twelve atoms, and a scenario of seventeen, over applied migrations."""

from itertools import product
from pathlib import Path

import pytest

from loomlog.operators import retrieval
from loomlog.operators.graph import Graph
from loomlog.plans import conjunction
from loomlog.plans import syntax as s
from loomlog.sources import migrations, text

DECLARED = """DefPred("onto/preferred_label", "1", "liquid/node", "0", "liquid/string").
DefCompound("ExternalMapping", "mapping/concept", "0", "liquid/node").
DefCompound("ExternalMapping", "mapping/vocabulary", "0", "liquid/node").
DefCompound("ExternalMapping", "mapping/code", "0", "liquid/string").
DefCompound("MedicationClassMembership", "clinical/medication", "0", "liquid/node").
DefCompound("MedicationClassMembership", "clinical/drug_class", "0", "liquid/node").
DefCompound("Indication", "clinical/medication", "0", "liquid/node").
DefCompound("Indication", "clinical/condition", "0", "liquid/node").
DefCompound("Contraindication", "clinical/medication", "0", "liquid/node").
DefCompound("Contraindication", "clinical/condition", "0", "liquid/node").
"""
# Labels, mappings (concept, vocabulary, code, label), members of drug classes, indications, contraindications.
LABELS = {
    "condition/hypertension": "Hypertension",
    "condition/pregnancy": "Pregnancy",
    "condition/type_2_diabetes": "Type 2 Diabetes Mellitus",
    "contraindication/lisinopril/pregnancy": "Lisinopril avoid/review in Pregnancy",
    "drug_class/ace_inhibitor": "ACE Inhibitor",
    "drug_class/factor_xa_inhibitor": "Factor Xa Inhibitor",
    "indication/lisinopril/hypertension": "Lisinopril indicated for Hypertension",
    "indication/metformin/type_2_diabetes": "Metformin indicated for Type 2 Diabetes",
    "medication/apixaban": "Apixaban",
    "medication/lisinopril": "Lisinopril",
    "medication/metformin": "Metformin",
}
MAPPINGS = [
    ("condition/hypertension", "snomedct", "38341003", "SNOMED CT 38341003"),
    ("condition/hypertension", "umls", "C0020538", "UMLS C0020538"),
    ("condition/pregnancy", "snomedct", "77386006", "SNOMED CT 77386006"),
    ("condition/type_2_diabetes", "snomedct", "44054006", "SNOMED CT 44054006"),
    ("condition/type_2_diabetes", "umls", "C0011860", "UMLS C0011860"),
    ("medication/lisinopril", "rxnorm", "29046", "RxNorm 29046"),
    ("medication/lisinopril", "umls", "C0065374", "UMLS C0065374"),
    ("medication/metformin", "drugbank", "DB00331", "DrugBank DB00331"),
    ("medication/metformin", "rxnorm", "6809", "RxNorm 6809"),
    ("medication/metformin", "umls", "C0025598", "UMLS C0025598"),
]
MEMBERS = [("apixaban", "factor_xa_inhibitor"), ("lisinopril", "ace_inhibitor")]
INDICATIONS = [("lisinopril", "hypertension"), ("metformin", "type_2_diabetes")]
CONTRAINDICATIONS = [("lisinopril", "pregnancy")]
TAGS = [
    ("tag/user-medication-lisinopril", "medication", "medication/lisinopril"),
    ("tag/user-condition-hypertension", "condition", "condition/hypertension"),
]
EPISODE, USER = "episode/synthetic-hypertension-visit", "user/synthetic-demo"


def mapping(vocabulary, code):
    return f"mapping/{vocabulary}_{code.lower()}"


def term(name):
    return f'"{name}"' if "/" in name else name


def edge(subject, predicate, object):
    """An atom; ends with a slash are constants, others are variables."""
    return f'Edge({term(subject)}, "{predicate}", {term(object)})'


def label(node, variable):
    return edge(node, "onto/preferred_label", variable)


def mapped(concept, *found):
    """Atoms that ask for mappings of a concept (node, variable of its label)."""
    return [atom for node, variable in found for atom in (edge(concept, "med/has_mapping", node), label(node, variable))]


def files():
    """Committed files, as the workspace reads them: declarations, concepts, relations, mappings."""
    concepts = [f'Edge("{node}", "onto/preferred_label", "{name}").' for node, name in LABELS.items()]
    relations = [f'MedicationClassMembership@(cid="membership/{m}/{d}", clinical/medication="medication/{m}", clinical/drug_class="drug_class/{d}").' for m, d in MEMBERS]
    for name, found in (("Indication", INDICATIONS), ("Contraindication", CONTRAINDICATIONS)):
        relations += [f'{name}@(cid="{name.lower()}/{m}/{d}", clinical/medication="medication/{m}", clinical/condition="condition/{d}").' for m, d in found]
    maps = []
    for concept, vocabulary, code, name in MAPPINGS:
        maps.append(f'ExternalMapping@(cid="{mapping(vocabulary, code)}", mapping/concept="{concept}", mapping/vocabulary="vocab/{vocabulary}", mapping/code="{code}").')
        maps.append(f'Edge("{mapping(vocabulary, code)}", "onto/preferred_label", "{name}").')
    bodies = {"foundation": DECLARED, "concepts": "\n".join(concepts), "relations": "\n".join(relations), "mappings": "\n".join(maps)}
    return [migrations.Migration(f"20260422.{i:04d}.{name}.dl", Path(name), None, "", body) for i, (name, body) in enumerate(bodies.items(), 1)]


def back_link(fact, compound, schemas):
    terms = {t.name: t.term.value for t in fact.atom.terms}
    if compound.name == "ExternalMapping":
        return s.Edge(terms["mapping/concept"], "med/has_mapping", terms["cid"])
    if compound.name == "MedicationClassMembership":
        return s.Edge(terms["clinical/medication"], "med/has_drug_class", terms["clinical/drug_class"])
    return None


@pytest.fixture(scope="module")
def ontology(spark, tmp_path_factory):
    done = migrations.apply(Graph.empty(spark), files(), expander=back_link, expand_compounds=True)
    folder = f"file://{tmp_path_factory.mktemp('ontology')}"
    done.graph.save(folder)
    return Graph.load(spark, folder)


def ask(graph, *atoms):
    found = conjunction.run_query(graph.catalog(), text.parse_query(", ".join(atoms)))
    return sorted((r.asDict() for r in found.collect()), key=lambda r: sorted(r.items()))


MEDICATION_CROSSWALK = [label("medication/metformin", "medication_label"), *mapped("medication/metformin", ("mapping/rxnorm_6809", "rxnorm_label"), ("mapping/umls_c0025598", "umls_label"), ("mapping/drugbank_db00331", "drugbank_label"))]


def test_labels(ontology):
    assert ask(ontology, 'Edge(id, "onto/preferred_label", "Metformin")') == [{"id": "medication/metformin"}]
    assert ask(ontology, label("condition/type_2_diabetes", "label")) == [{"label": "Type 2 Diabetes Mellitus"}]


def test_crosswalks(ontology):
    assert len(MEDICATION_CROSSWALK) == 7
    assert ask(ontology, *MEDICATION_CROSSWALK) == [{"medication_label": "Metformin", "rxnorm_label": "RxNorm 6809", "umls_label": "UMLS C0025598", "drugbank_label": "DrugBank DB00331"}]
    condition = [label("condition/type_2_diabetes", "condition_label"), *mapped("condition/type_2_diabetes", ("mapping/snomedct_44054006", "snomed_label"), ("mapping/umls_c0011860", "umls_label"))]
    assert ask(ontology, *condition) == [{"condition_label": "Type 2 Diabetes Mellitus", "snomed_label": "SNOMED CT 44054006", "umls_label": "UMLS C0011860"}]


def test_crosswalk_without_a_mapping_has_no_rows(ontology):
    less = ontology.delete([s.Edge("medication/metformin", "med/has_mapping", "mapping/rxnorm_6809")])
    assert ask(less, *MEDICATION_CROSSWALK) == []
    assert ask(less, label("mapping/rxnorm_6809", "label")) == [{"label": "RxNorm 6809"}]


def test_drug_class(ontology):
    atoms = [label("medication/apixaban", "medication_label"), edge("medication/apixaban", "med/has_drug_class", "drug_class/factor_xa_inhibitor"), label("drug_class/factor_xa_inhibitor", "drug_class_label")]
    assert ask(ontology, *atoms) == [{"medication_label": "Apixaban", "drug_class_label": "Factor Xa Inhibitor"}]


def test_user_tags_connect_medication_and_condition(ontology):
    seed = [s.Vertex(x) for x in (USER, EPISODE, *(t for t, _, _ in TAGS))]
    seed += [s.Edge(tag, name, value) for tag, kind, node in TAGS for name, value in (("user", USER), ("episode", EPISODE), (kind, node))]
    atoms = [edge(tag, name, value) for tag, kind, _ in TAGS for name, value in (("user", USER), ("episode", "episode"), (kind, kind))]
    atoms += [label("medication", "medication_label"), edge("medication", "med/has_drug_class", "drug_class/ace_inhibitor"), label("drug_class/ace_inhibitor", "drug_class_label")]
    atoms += [label("condition", "condition_label"), *(edge("condition", "med/has_mapping", m) for m in ("mapping/snomedct_38341003", "mapping/umls_c0020538"))]
    assert len(atoms) == 12
    assert ask(ontology, *atoms) == []
    want = {"episode": EPISODE, "medication": "medication/lisinopril", "condition": "condition/hypertension", "medication_label": "Lisinopril", "condition_label": "Hypertension", "drug_class_label": "ACE Inhibitor"}
    assert ask(ontology.overlay(seed), *atoms) == [want]


def test_scenario_of_seventeen_atoms(ontology):
    """Every combination of the mappings of a medication, its condition and a contraindicated one, with the evidence that the scenario requires."""
    indication, risk = "indication/lisinopril/hypertension", "contraindication/lisinopril/pregnancy"
    atoms = [edge(indication, "clinical/medication", "medication_id"), edge(indication, "clinical/condition", "condition_id"), label(indication, "indication_label")]
    atoms += [label("medication/lisinopril", "medication_label"), label("condition/hypertension", "hypertension_label")]
    atoms += [edge(risk, "clinical/medication", "medication/lisinopril"), edge(risk, "clinical/condition", "pregnancy_id"), label(risk, "risk_label"), label("condition/pregnancy", "pregnancy_label")]
    atoms += [edge("medication/lisinopril", "med/has_drug_class", "drug_class/ace_inhibitor"), label("drug_class/ace_inhibitor", "class_label")]
    concepts = {"a": "medication/lisinopril", "b": "condition/hypertension", "c": "condition/pregnancy"}
    for x, concept in concepts.items():
        atoms += mapped(concept, (f"{x}_mapping", f"{x}_label"))
    assert len(atoms) == 17
    found = ask(ontology, *atoms)
    of = {x: [(mapping(v, code), name) for node, v, code, name in MAPPINGS if node == concept] for x, concept in concepts.items()}
    fixed = {"medication_id": "medication/lisinopril", "condition_id": "condition/hypertension", "indication_label": LABELS[indication], "medication_label": "Lisinopril", "hypertension_label": "Hypertension", "pregnancy_id": "condition/pregnancy", "risk_label": LABELS[risk], "pregnancy_label": "Pregnancy", "class_label": "ACE Inhibitor"}
    want = [fixed | {f"{x}_{part}": value for x, pair in zip(of, row, strict=True) for part, value in zip(("mapping", "label"), pair, strict=True)} for row in product(*of.values())]
    assert len(found) == 4 and found == sorted(want, key=lambda r: sorted(r.items()))


def test_required_evidence_of_the_scenario(ontology):
    """Indication, contraindication and mappings are evidence by their ids; what is not stated is missing."""
    spec = {"evidence_id": "?e", "kind": "mapping", "subject": "?n", "predicate": "med/has_mapping", "object": "?e"}
    about = [retrieval.Source('edge(n, "med/has_mapping", e)', spec)]
    about += [retrieval.Source('edge(e, "clinical/medication", n), edge(e, "clinical/condition", c)', spec | {"kind": "relation", "predicate": "clinical/condition", "object": "?c"})]
    evidence = retrieval.retrieve(ontology.catalog(), about)
    ids = ["indication/lisinopril/hypertension", "contraindication/lisinopril/pregnancy", "mapping/rxnorm_29046", "mapping/umls_c0065374", "mapping/snomedct_38341003", "mapping/snomedct_77386006"]
    assert retrieval.missing_evidence(evidence, ids).collect() == []
    assert [r[0] for r in retrieval.missing_evidence(evidence, [*ids, "mapping/rxnorm_1"]).collect()] == ["mapping/rxnorm_1"]
    assert retrieval.missing_entities(evidence, ["medication/lisinopril", "condition/hypertension", "condition/pregnancy"]).collect() == []
