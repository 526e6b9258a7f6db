"""Fixed values of the text rules: word lists and patterns that results depend on, as text.  No rule is written here."""

# fixed values: words that a folded condition leaves out
CONDITION_STOPS = ["the", "of", "and", "with", "due", "to", "a", "an", "in", "for", "or"]

# fixed values: dashes that separate words
DASHES = "‐‑‒–—―-"

# fixed values: stems of disease nouns
DISEASE = [
    "disease", "disorder", "syndrome", r"itis\b", r"osis\b", "opathy", r"emia\b", r"penia\b", r"oma\b", "deficiency", "failure", "cancer", "carcinoma",
    "tumou?r", "leukemia", "leukaemia", "lymphoma", "myeloma", "infection", "injury", "pain", "fibrosis", "sclerosis", "dystrophy", "atrophy",
    "malignan", "sarcoma", "glioma", "melanoma", "neoplasm", "metasta", "stenosis", "thrombo", "ischemi", "infarct", "stroke", "hypertension",
    "diabetes", "obesity", "asthma", "copd", "arthritis", "psoriasis", "dermatitis", "eczema", "lupus", "crohn", "colitis", "hepatitis", "cirrhosis",
    "epilepsy", "seizure", "migraine", "depress", "schizophren", "anxiety", "autism", "dementia", "alzheimer", "parkinson", "insomnia",
    "apnea", "apnoea", "anemia", "anaemia", "sepsis", "pneumonia", "covid", "hiv", "tuberculosis", "malaria", "fracture", "burn", "wound", "ulcer",
    "insufficiency", "dysfunction", "impairment", "abnormal", "defect", "lesion", "cyst", "polyp", "hernia", "aneurysm", "embol", "edema", "oedema",
]

# fixed values: reasons to drop a folded condition, in order; the third says whether a disease noun saves it
DENOISE = [
    ("mesh_id_artifact", r"^[cd]\d{5,9}$", False),
    ("healthy_volunteers", r"\bhealthy\b( (volunteers?|subjects?|participants?|adults?|people|individuals?|controls?|persons?|men|women|children|donors?))?$|^healthy$", False),
    ("behavior_qol_only", r"quality life|adherence|satisfaction|knowledge|attitude|behavio(u)?r|lifestyle|wellbeing|well being|education|awareness|compliance|self efficacy|perception", True),
    ("lab_biomarker_only", r"^[a-z0-9 ]*\b(positive|negative|mutation|amplification|overexpression|expression|wild ?type|status|levels?)$", True),
    ("device_procedure_only", r"catheter|implant|prosthes|surgical technique|anesthesia|anaesthesia|imaging|ultrasound|endoscop|intubation|ventilation|dialysis access|vaccination|immunization|screening|monitoring", True),
    ("too_short", r"^.{0,2}$", False),
]

# fixed values: words of a mechanism's text that name no target
MECHANISM_STOPS = [
    "inhibitor", "inhibitors", "inhibition", "antagonist", "antagonists", "agonist", "agonists", "modulator", "modulators", "blocker", "blockers", "blockade",
    "activator", "activators", "activation", "receptor", "receptors", "ligand", "ligands", "pathway", "signaling", "signalling", "antibody", "antibodies",
    "monoclonal", "mab", "anti", "the", "of", "and", "a", "an", "targeted", "targeting", "directed", "against", "selective", "small", "molecule", "oral", "human",
    "humanized", "humanised", "bispecific", "conjugate", "drug", "agent", "agents", "therapy", "class", "based", "specific", "dual", "pan", "type", "protein",
    "kinase", "kinases", "enzyme", "channel", "transporter", "degrader", "stimulator", "stabilizer", "stabiliser", "binding", "binder", "blocking",
    "neutralizing", "neutralising", "immune", "checkpoint", "cell", "cells", "engager", "t", "car", "vaccine", "gene", "rna", "sirna", "antisense",
    "oligonucleotide", "aso",
]

# fixed values: the patterns that intervention names are cleaned with, by name
TYPE_PREFIX = (
    r"^\s*(?:drug|biological|biologic|genetic|combination product|dietary supplement|device|procedure|other|"
    r"experimental|active comparator|placebo comparator|sham comparator|comparator|investigational|control|"
    r"treatment|active arm|active|arm|group|cohort|intervention|test|reference)"
    r"(?:\s+(?:arm|group|drug|product))?\s*[:\-–—]\s*"
)
ARM_PREFIX = r"^\s*(?:arm|group|cohort|part|stage)\s+[a-z0-9]{1,2}\s*[:\-–—]\s*"
PAREN = r"\s*[\(\[][^()\[\]]*[\)\]]"
PLACEBO_CLAUSE = r"\s*(?:\bor\b|\band\b|\+|/|,)\s*(?:its\s+|corresponding\s+|matching\s+|matched\s+)?(?:placebo|sham|vehicle)s?\b.*$"
OPEN_LABEL = r"\b(?:open[- ]label|double[- ]blind|single[- ]blind|blinded|unblinded)\b"
ROUTE_TAIL = (
    r"\b(?:administered|given|delivered|infused|injected)\s+(?:as\s+)?(?:an?\s+)?(?:intravenous(?:ly)?|iv|oral(?:ly)?|"
    r"subcutaneous(?:ly)?|sc|intramuscular(?:ly)?|im|topical(?:ly)?|infusion|injection|bolus)\b.*$"
)
PERCENT = r"\d+(?:[.,]\d+)?\s*%(?:\s*(?:w/w|w/v|v/v))?"
DOSE = (
    r"(?<![A-Za-z0-9\-])(?:\d+(?:[.,]\d+)?\s*(?:-|to|–|or|/)\s*)?\d+(?:[.,]\d+)?\s*(?:x\s*\d+\s*)?"
    r"(?:mg|mcg|µg|ug|g|kg|ml|mL|l|iu|units?|u|mmol|µmol|umol|meq|mci|mbq|gbq|gy|ppm|%|ng|pg|mg/kg|mg/m2|mg/m²|cells?/kg|"
    r"cells|copies|vg/kg|vg|pfu|tcid50|ccid50|cfu|spores|dose|doses|tablets?|capsules?|puffs?|drops?|sprays?|vials?|patches?|cycles?|courses?|infusions?|injections?)"
    r"(?:\s*/\s*(?:kg|m2|m²|ml|mL|l|day|d|dose|h|hr|hrs|hour|hours|week|wk|kg/day|kg/dose|min|\d+\s*(?:h|hr|hrs|hours?)))*\b"
)
FREQUENCY = (
    r"\b(?:bid|tid|qid|qd|qod|qw|q\d+[wdh]|q\d+\s*(?:weeks?|days?|hours?|h)|"
    r"once[- ]daily|twice[- ]daily|three times daily|once[- ]weekly|twice[- ]weekly|every\s+(?:\d+|other)\s+(?:weeks?|days?|hours?|months?)|"
    r"daily|weekly|monthly|per day|per week|(?:for|x)\s+\d+\s+(?:days?|weeks?|months?|cycles?)|"
    r"day\s*\d+(?:\s*(?:-|to|–)\s*\d+)?|days?\s+\d+(?:\s*(?:-|to|–)\s*\d+)?|cycles?\s*\d+|week\s*\d+)\b"
)
COMBINED = r"\s+(?:in combination with|combined with|combination with|plus|together with|co-administered with)\s+"
DANGLING = r"\s+(?:or|and|with|plus|in combination with|combined with|followed by)\s*$"
EDGES = r"[\s,;:\-–—/+&、，。]+$|^[\s,;:\-–—/+&、，。]+"

# fixed values: what marks a biologic's name
GREEK = ["alfa", "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "lambda", "theta", "kappa"]
BIOLOGIC_STEMS = ["mab", "cept", "kin", "kinra", "tide", "ase", "gene", "vec", "cel", "leucel", "parvovec", "cabtagene", "ciloleucel"]
BIOLOGIC_WORDS = [
    "antibody", "antibodies", "monoclonal", "immunoglobulin", "vaccine", "toxin", "toxoid", "interferon", "interleukin",
    "insulin", "albumin", r"factor\s+[ivx]+", "erythropoietin", "epoetin", "somatropin", "filgrastim", "heparin", "enoxaparin",
]
PAYLOADS = [
    "pegol", "vedotin", "mafodotin", "ravtansine", "ozogamicin", "emtansine", "mertansine", "tansine", "sudotin", "govitecan", "deruxtecan",
    "axotin", "tesirine", "tirumotecan", "ecteribulin", "rezetecan", "ciloleucel", "axicabtagene", "brexucabtagene", "lisocabtagene",
    "idecabtagene", "vicleucel", "autoleucel", "tecelra", "aglutamer", "bcma", "pegylated", "peg",
]

# fixed values: what a class term looks like
CLASS_HINT = (
    "(agents?|inhibitors?|antagonists?|agonists?|blockers?|modulators?|antibodies|antineoplastic|anti-|immunologic|"
    "analgesics|anesthetics|antibiotics|antiviral|antifungal|antibacterial|enzyme|hormones?|vaccines?|immunosuppressive|"
    "antidepressive|antipsychotic|anticonvulsants|hypoglycemic|antihypertensive|vasodilator|diuretics|anticoagulants|"
    "fibrinolytic|bronchodilator|cholinergic|adrenergic|dopamine|serotonin|gaba|opioid|steroid|corticosteroid|"
    "antirheumatic|immunomodulat|protein kinase|receptor|ligand|channel|reuptake|cytochrome|proteasome|topoisomerase|"
    "tubulin|angiogenesis|checkpoint|vegf|egfr|jak|tnf|interleukin|interferon|cytokine|complement)"
)
