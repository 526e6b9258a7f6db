"""A small registry, written by hand, with the messy cases that the operators are for."""

import json

MESH = {"cancer": ("D001", "Lung Neoplasms", ["Neoplasms", "Respiratory Tract Diseases"]), "asthma": ("D002", "Asthma", ["Respiratory Tract Diseases", "Immune System Diseases"])}


def study(number, *, title="A study", status="RECRUITING", phases=("PHASE2",), kind="INTERVENTIONAL", lead=("Acme Pharmaceuticals, Inc.", "INDUSTRY"), updated="2024-05-01", done="2024-12", conditions=("Lung Cancer",),
          mesh=("cancer",), arms=(("Arm A", "EXPERIMENTAL"), ("Arm B", "ACTIVE_COMPARATOR")), treatments=(("DRUG", "Drug A", ("Arm A",), ()),), eligibility="Adults.\nSevere disease.", drug_mesh=None):
    doc = {
        "protocolSection": {
            "identificationModule": {"nctId": f"NCT{number:08d}", "briefTitle": title, "organization": {"fullName": "Org", "class": "INDUSTRY"}},
            "statusModule": {"overallStatus": status, "startDateStruct": {"date": "2022-03"}, "completionDateStruct": {"date": done} if done else None, "lastUpdatePostDateStruct": {"date": updated}},
            "sponsorCollaboratorsModule": {"leadSponsor": {"name": lead[0], "class": lead[1]}, "collaborators": [{"name": "Helper University", "class": "OTHER"}]} if lead else {},
            "conditionsModule": {"conditions": list(conditions), "keywords": ["kw"]},
            "designModule": {"studyType": kind, "phases": list(phases), "enrollmentInfo": {"count": 10, "type": "ESTIMATED"}, "unknownField": {"x": 1}},
            "armsInterventionsModule": {"armGroups": [{"label": n, "type": k} for n, k in arms], "interventions": [{"type": t, "name": n, "armGroupLabels": list(a), "otherNames": list(o)} for t, n, a, o in treatments]},
            "eligibilityModule": {"eligibilityCriteria": eligibility, "sex": "ALL", "stdAges": ["ADULT"]},
        },
        "derivedSection": {"conditionBrowseModule": {"meshes": [{"id": MESH[m][0], "term": MESH[m][1]} for m in mesh], "ancestors": [{"id": f"A{i}", "term": a} for m in mesh for i, a in enumerate(MESH[m][2])]},
                           "interventionBrowseModule": {"meshes": [{"id": "M1", "term": drug_mesh}] if drug_mesh else [], "ancestors": [{"id": "M2", "term": "Antineoplastic Agents"}] if drug_mesh else []}},
        "hasResults": False, "somethingElse": [1, 2],
    }
    return doc


def studies():
    both = (("Arm A", "EXPERIMENTAL"), ("Arm B", "ACTIVE_COMPARATOR"))
    combo = (("DRUG", "Zolumab + Petinib 5 mg", ("Arm A",), ()), ("DRUG", "Petinib", ("Arm A", "Arm B"), ("PX-1234", "Petinex®")), ("DRUG", "Placebo", ("Arm B",), ()))
    out = [
        study(1, title="Zolumab in HER2-positive patients", treatments=(("BIOLOGICAL", "Zolumab 100 mg/kg IV", ("Arm A",), ("ZM-777",)), ("DRUG", "Docetaxel hydrochloride", ("Arm A", "Arm B"), ())), arms=both, drug_mesh="Zolumab"),
        study(2, treatments=combo, arms=both, phases=("PHASE2", "PHASE3")),
        study(3, treatments=(("DRUG", "PX-1234", ("Arm A",), ("Petinib",)),), mesh=("asthma",), conditions=("Asthma",), lead=("Acme Pharma", "INDUSTRY")),
        study(4, treatments=(("DRUG", "Petinib", ("Arm A",), ("PX-1234",)),), mesh=("asthma",), conditions=("Asthma (severe)",), lead=("Genzyme, a Sanofi Company", "INDUSTRY")),
        study(5, status="COMPLETED", done=None, treatments=(("DRUG", "Zolumab", (), ()),), arms=(("Only", "EXPERIMENTAL"),), mesh=(), conditions=("Rare Thing Syndrome",)),
        study(6, status="COMPLETED", done="2015-01-01", phases=("NA",), treatments=(("DEVICE", "Device: Inhaler X", ("Arm A",), ()),), mesh=(), conditions=("Healthy volunteers",), lead=None),
        study(7, kind="OBSERVATIONAL", phases=(), treatments=(("DRUG", "Docetaxel", (), ()),), arms=(), lead=("Helper University", "OTHER")),
        study(8, treatments=(("DRUG", "Docetaxel Petinib", ("Arm A",), ()),), arms=both, mesh=("cancer", "asthma"), conditions=("Lung Cancer", "Asthma")),
    ]
    fallback = study(9, treatments=(("DRUG", "Zolumab", (), ()), ("DRUG", "Docetaxel", (), ())), arms=both)
    fallback["protocolSection"]["armsInterventionsModule"]["armGroups"][0]["interventionNames"] = ["Drug: Zolumab"]
    fallback["protocolSection"]["armsInterventionsModule"]["armGroups"][1]["interventionNames"] = ["docetaxel", "Drug: nothing"]
    bare = {"protocolSection": {"identificationModule": {"nctId": "NCT00000010"}}}
    return [*out, fallback, bare]


def members():
    docs = [(f"{d['protocolSection']['identificationModule']['nctId']}.json", json.dumps(d)) for d in studies()]
    return [*docs, ("broken.json", "{not json"), ("nameless.json", json.dumps({"protocolSection": {"identificationModule": {"briefTitle": "x"}}}))]
