"""Word lists that the normalisers use.

The library ships none but the areas.  `Lexicon.from_folder` reads a folder of YAML or JSON files (one for each field group) with a deployment's own lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

# fixed values: headings and their areas, by priority; headings that count for nothing
AREAS = [
    ("Neoplasms", "Oncology"),
    ("Cardiovascular Diseases", "Cardiovascular"),
    ("Nervous System Diseases", "Neurology"),
    ("Mental Disorders", "Psychiatry"),
    ("Respiratory Tract Diseases", "Respiratory"),
    ("Digestive System Diseases", "Gastroenterology & Hepatology"),
    ("Immune System Diseases", "Immunology"),
    ("Musculoskeletal Diseases", "Musculoskeletal & Rheumatology"),
    ("Skin and Connective Tissue Diseases", "Dermatology"),
    ("Endocrine System Diseases", "Endocrinology"),
    ("Nutritional and Metabolic Diseases", "Metabolic"),
    ("Hemic and Lymphatic Diseases", "Hematology"),
    ("Eye Diseases", "Ophthalmology"),
    ("Urogenital Diseases", "Urology, Nephrology & Women's Health"),
    ("Male Urogenital Diseases", "Urology, Nephrology & Women's Health"),
    ("Female Urogenital Diseases and Pregnancy Complications", "Urology, Nephrology & Women's Health"),
    ("Congenital, Hereditary, and Neonatal Diseases and Abnormalities", "Genetic & Congenital"),
    ("Otorhinolaryngologic Diseases", "ENT"),
    ("Stomatognathic Diseases", "Dental & Oral"),
    ("Infections", "Infectious Disease"),
    ("Wounds and Injuries", "Trauma"),
    ("Chemically-Induced Disorders", "Toxicology"),
    ("Occupational Diseases", "Environmental & Occupational"),
    ("Disorders of Environmental Origin", "Environmental & Occupational"),
    ("Pathological Conditions, Signs and Symptoms", "Signs & Symptoms (cross-cutting)"),
]
EXCLUDED_HEADINGS = ["Animal Diseases"]


@dataclass(frozen=True)
class Lexicon:
    noise_exact: list[str] = field(default_factory=list)
    noise_starts: list[str] = field(default_factory=list)
    noise_contains: list[str] = field(default_factory=list)
    noise_regex: list[str] = field(default_factory=list)
    salts: list[str] = field(default_factory=list)
    dose_forms: list[str] = field(default_factory=list)
    devices: list[str] = field(default_factory=list)
    cations: list[str] = field(default_factory=list)
    qualifiers: list[str] = field(default_factory=list)
    legal_forms: list[str] = field(default_factory=list)
    industry_words: list[str] = field(default_factory=list)
    lookup_words: list[str] = field(default_factory=list)
    parent_patterns: list[str] = field(default_factory=list)
    company_groups: dict[str, list[str]] = field(default_factory=dict)
    areas: list[tuple[str, str]] = field(default_factory=lambda: AREAS)
    excluded_headings: list[str] = field(default_factory=lambda: EXCLUDED_HEADINGS)
    populations: list[tuple[str, str, list[str]]] = field(default_factory=list)
    synonyms: list[list[str]] = field(default_factory=list)

    @classmethod
    def from_folder(cls, folder: str) -> Lexicon:
        """Fields that a folder's files give; empty lists for the rest."""
        from cohortlens.sources.records import load_lexicon

        files: dict[str, dict[str, Any]] = {p.stem: load_lexicon(str(p)) for p in sorted(Path(folder).iterdir()) if p.suffix in (".yaml", ".yml", ".json")}
        at = {  # field: (file, key)
            "noise_exact": ("noise_names", "exact"), "noise_starts": ("noise_names", "starts_with"), "noise_contains": ("noise_names", "contains"), "noise_regex": ("noise_names", "regex"),
            "salts": ("salt_dose_suffixes", "salts"), "dose_forms": ("salt_dose_suffixes", "dose_forms"), "devices": ("salt_dose_suffixes", "device_pack"), "cations": ("salt_dose_suffixes", "electrolyte_cations"),
            "qualifiers": ("qualifiers", "leading"), "legal_forms": ("company_suffixes", "legal_forms"), "industry_words": ("company_suffixes", "industry_words"), "lookup_words": ("company_suffixes", "alias_lookup_words"),
            "excluded_headings": ("mesh_areas", "excluded_headings"), "parent_patterns": ("company_suffixes", "declared_parent_patterns"),
        }
        found: dict[str, Any] = {f: files[name][key] for f, (name, key) in at.items() if key in files.get(name, {})}
        if labels := files.get("non_molecule", {}).get("class_labels"):
            found["noise_exact"] = [*found.get("noise_exact", []), *labels]
        shapes = {
            "company_groups": ("company_aliases", "groups", lambda v: {g["canonical"]: g["members"] for g in v}),
            "areas": ("mesh_areas", "areas", lambda v: [(a["heading"], a["area"]) for a in v]),
            "populations": ("populations", "entries", lambda v: [(e["term_id"], e["kind"], e["patterns"]) for e in v]),
            "synonyms": ("asset_synonyms", "groups", lambda v: [g["members"] for g in v]),
        }
        found |= {f: shape(files[name][key]) for f, (name, key, shape) in shapes.items() if key in files.get(name, {})}
        return replace(cls(), **found)
