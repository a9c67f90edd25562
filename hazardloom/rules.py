"""Rule tables: small constant dimension tables with an explicit order column.

A :class:`RuleBook` holds one set of tables.  ``RuleBook.default()`` carries the
built-in values below; ``with_patterns`` and ``dataclasses.replace`` swap parts of
it.  The tables are configuration and their size is checked when a book is built
(``MAX_RULES``), so turning one into literals or a broadcast side has a proven bound.
Rule tables that live in Spark and may be larger go through
``operators.match.match_rule_table`` and the joins in ``operators.lookups`` instead.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 1000

# --- fixed values: alerts ---------------------------------------------------------
# name | severity | severity label | probability boost | description | mechanism
ALERTS_TEXT = """
Benzene Ring | 2 | MODERATE | 0.15 | Aromatic benzene ring — associated with hematotoxicity | Metabolized to benzene oxide and muconaldehyde, causing bone marrow suppression
Nitro Group | 4 | HIGH | 0.25 | Nitro functional group — strong genotoxic and mutagenic alert | Reduced to nitroso and hydroxylamine intermediates that form DNA adducts
Aromatic Amine (Primary) | 4 | HIGH | 0.25 | Primary aromatic amine — carcinogenic structural alert | N-hydroxylation followed by esterification generates reactive nitrenium ions
Aromatic Amine (Secondary) | 4 | HIGH | 0.22 | Secondary aromatic amine — potential carcinogen | Oxidative activation forms electrophilic metabolites that bind to DNA
Aldehyde | 3 | MODERATE | 0.15 | Aldehyde group — reactive electrophile | Forms Schiff bases with proteins and DNA, causing cross-linking
Formaldehyde-like | 4 | HIGH | 0.25 | Formaldehyde-like structure — known carcinogen (IARC Group 1) | Highly reactive, forms DNA-protein cross-links in nasal epithelium
Halogenated Alkyl | 3 | HIGH | 0.20 | Halogenated alkyl group — associated with liver and CNS toxicity | Metabolic dehalogenation generates reactive free radicals and phosgene
Polyaromatic Hydrocarbon (3+ fused rings) | 4 | HIGH | 0.25 | Polyaromatic hydrocarbon (PAH) — strong carcinogenic alert | Metabolic activation by CYP enzymes forms diol-epoxides that intercalate DNA
Reactive α,β-Unsaturated Carbonyl | 3 | MODERATE | 0.18 | Michael acceptor — reactive electrophile causing protein alkylation | Undergoes 1,4-conjugate addition with cellular nucleophiles (GSH, proteins)
Epoxide | 5 | CRITICAL | 0.30 | Epoxide ring — highly reactive mutagen | Ring-opening by DNA nucleophiles creates covalent adducts; potent mutagen
Quinone | 4 | HIGH | 0.25 | Quinone — causes oxidative stress and redox cycling | One-electron reduction generates semiquinone radicals producing superoxide
Hydrazine | 4 | HIGH | 0.25 | Hydrazine moiety — hepatotoxic and carcinogenic | Oxidized to diazene intermediates; generates reactive acyl radicals in liver
Acyl Halide | 5 | CRITICAL | 0.30 | Acyl halide — extremely reactive, corrosive | Immediate acylation of proteins and nucleic acids; severe tissue damage
Nitroso Group | 4 | HIGH | 0.25 | Nitroso group — potent alkylating agent | Tautomerizes to diazo compounds that alkylate DNA bases
Azide | 4 | HIGH | 0.22 | Organic azide — cytochrome oxidase inhibitor | Binds to Fe³⁺ in cytochrome c oxidase, blocking mitochondrial respiration
Isocyanate | 4 | HIGH | 0.25 | Isocyanate — potent respiratory sensitizer | Reacts with NH/OH groups in proteins causing hapten formation and allergy
"""

# Text patterns (Java regex) for structure strings, one per alert in the order above.
# They look at the line notation as text; they are not a substructure search.
STRUCTURE_PATTERNS = [
    r"([cC])([1-9])(?:\([^()]*\))?(?:=?c(?:\([^()]*\))?){4}=?c\2|C1=CC=CC=C1|C1=CC=C\(C=C1\)",
    r"\[N\+\]\(=O\)\[O-\]|\[N\+\]\(\[O-\]\)=O|\[O-\]\[N\+\]\(=O\)",
    r"(?<![A-Za-z0-9)\]=])Nc|c\(N\)|c[0-9]*N(?![A-Za-z0-9(\[=])|C=C1\)N$",
    r"c[0-9]*Nc",
    r"(?<=[A-Za-z0-9)])C=O(?![A-Za-z0-9(])|^O=C[A-Zc](?!\()",
    r"^C=O$|\[CH2\]=O",
    r"C(?:Cl|Br|F|I)|C\((?:Cl|Br|F|I)\)|(?<![a-z])(?:Cl|Br|F|I)C(?![=1-9])",
    r"c1ccc2cc3ccccc3cc2c1",
    r"C=CC=O|C=CC\(=O\)|O=CC=C",
    r"C1OC1|C1CO1|O1CC1",
    r"O=C1C=CC\(=O\)C=C1",
    r"N\(?N(?!=)",
    r"C\(=O\)(?:Cl|Br|F|I)|(?:Cl|Br|F|I)C\(=O\)",
    r"(?<!\])N=O",
    r"\[N-\]=\[N\+\]=N|N=\[N\+\]=\[N-\]",
    r"N=C=O|O=C=N",
]

# --- fixed values: alert weights for mixtures, with the weight of an unlisted alert ----
DEFAULT_WEIGHT = 0.15
WEIGHTS_TEXT = """
Benzene Ring | 0.20
Nitro Group | 0.25
Aromatic Amine (Primary) | 0.22
Aromatic Amine (Secondary) | 0.20
Aldehyde | 0.18
Formaldehyde-like | 0.25
Halogenated Alkyl | 0.18
Polyaromatic Hydrocarbon (3+ fused rings) | 0.25
Reactive α,β-Unsaturated Carbonyl | 0.15
Epoxide | 0.30
Quinone | 0.25
Hydrazine | 0.24
Acyl Halide | 0.30
Nitroso Group | 0.24
Azide | 0.22
Isocyanate | 0.23
"""

# --- fixed values: diseases per alert ---------------------------------------------
# alert | disease | base probability | severity | description
DISEASES_TEXT = """
Benzene Ring | Leukemia (AML) | 0.45 | HIGH | Chronic benzene exposure is an established cause of acute myeloid leukemia
Benzene Ring | Aplastic Anemia | 0.35 | HIGH | Benzene metabolites suppress bone marrow function
Benzene Ring | Myelodysplastic Syndrome | 0.30 | MODERATE | Benzene-induced clonal hematopoietic disorder
Nitro Group | Methemoglobinemia | 0.55 | HIGH | Nitro reduction products oxidize hemoglobin iron to Fe³⁺
Nitro Group | Liver Cancer (HCC) | 0.40 | HIGH | Nitroreduction generates DNA-reactive hydroxylamine metabolites
Nitro Group | Contact Dermatitis | 0.25 | MODERATE | Nitroaromatic compounds are common skin sensitizers
Aromatic Amine (Primary) | Bladder Cancer | 0.55 | CRITICAL | Aromatic amines are classic bladder carcinogens (established since 1954)
Aromatic Amine (Primary) | Hemolytic Anemia | 0.30 | HIGH | N-hydroxylamine metabolites damage red blood cell membranes
Aromatic Amine (Primary) | Liver Cancer | 0.35 | HIGH | Hepatic N-oxidation generates DNA-reactive electrophiles
Aromatic Amine (Secondary) | Bladder Cancer | 0.45 | HIGH | Secondary aromatic amines share carcinogenic activation pathways
Aromatic Amine (Secondary) | Hemolytic Anemia | 0.25 | MODERATE | Oxidative metabolites damage erythrocyte hemoglobin
Aldehyde | Respiratory Irritation | 0.50 | MODERATE | Aldehydes react with airway epithelial proteins
Aldehyde | Skin Sensitization | 0.40 | MODERATE | Protein-aldehyde hapten formation triggers immune response
Aldehyde | Asthma (occupational) | 0.30 | MODERATE | Airway inflammation from aldehyde-protein conjugates
Formaldehyde-like | Nasopharyngeal Cancer | 0.50 | CRITICAL | IARC Group 1 carcinogen — causes nasal squamous cell carcinoma
Formaldehyde-like | Respiratory Toxicity | 0.60 | HIGH | Severe irritation and DNA-protein cross-links in respiratory tract
Formaldehyde-like | Leukemia | 0.30 | HIGH | Epidemiological evidence links formaldehyde to myeloid leukemia
Halogenated Alkyl | CNS Depression | 0.50 | HIGH | Halogenated solvents are potent central nervous system depressants
Halogenated Alkyl | Liver Necrosis | 0.45 | HIGH | CYP2E1 metabolism generates hepatotoxic trichloromethyl radicals
Halogenated Alkyl | Kidney Toxicity | 0.35 | MODERATE | Renal proximal tubule damage from glutathione conjugate metabolites
Halogenated Alkyl | Cardiac Arrhythmia | 0.25 | HIGH | Myocardial sensitization to catecholamines
Polyaromatic Hydrocarbon (3+ fused rings) | Lung Cancer | 0.55 | CRITICAL | PAH diol-epoxides form bulky DNA adducts in lung epithelium
Polyaromatic Hydrocarbon (3+ fused rings) | Skin Cancer | 0.45 | HIGH | Topical PAH exposure induces squamous cell carcinoma
Polyaromatic Hydrocarbon (3+ fused rings) | Bladder Cancer | 0.30 | HIGH | Urinary excretion of PAH metabolites damages urothelium
Reactive α,β-Unsaturated Carbonyl | Allergic Contact Dermatitis | 0.45 | MODERATE | Michael acceptors haptenize skin proteins triggering T-cell response
Reactive α,β-Unsaturated Carbonyl | Hepatotoxicity | 0.35 | MODERATE | GSH depletion and mitochondrial dysfunction in hepatocytes
Epoxide | Mutagenicity | 0.65 | CRITICAL | Epoxide ring opens to alkylate DNA bases, especially guanine N7
Epoxide | Carcinogenicity | 0.55 | CRITICAL | Covalent DNA adducts cause point mutations and chromosomal aberrations
Epoxide | Skin Sensitization | 0.40 | MODERATE | Protein hapten formation via epoxide ring-opening
Quinone | Oxidative Hemolysis | 0.45 | HIGH | Redox cycling depletes erythrocyte GSH and damages membranes
Quinone | Hepatotoxicity | 0.40 | HIGH | Oxidative stress and protein arylation in hepatocytes
Quinone | Nephrotoxicity | 0.30 | MODERATE | Renal tubular damage from quinone-thioether conjugates
Hydrazine | Hepatotoxicity | 0.55 | HIGH | Acyl radical generation causes centrilobular hepatic necrosis
Hydrazine | Lupus-like Syndrome | 0.35 | MODERATE | Drug-induced lupus via hydrazine metabolites (e.g., isoniazid)
Hydrazine | Liver Cancer | 0.35 | HIGH | Methylation of DNA by diazomethane metabolites
Acyl Halide | Severe Chemical Burns | 0.70 | CRITICAL | Immediate acylation of tissue proteins causes necrosis
Acyl Halide | Respiratory Failure | 0.55 | CRITICAL | Inhalation causes pulmonary edema and chemical pneumonitis
Nitroso Group | Liver Cancer | 0.50 | HIGH | N-nitroso compounds are potent hepatocarcinogens
Nitroso Group | Esophageal Cancer | 0.35 | HIGH | GI tract exposure to nitrosamines linked to esophageal SCC
Azide | Metabolic Acidosis | 0.50 | HIGH | Cytochrome oxidase inhibition shifts metabolism to anaerobic glycolysis
Azide | Cardiovascular Collapse | 0.40 | CRITICAL | Profound hypotension from mitochondrial ATP depletion
Isocyanate | Occupational Asthma | 0.60 | HIGH | Isocyanates are the leading cause of occupational asthma worldwide
Isocyanate | Hypersensitivity Pneumonitis | 0.40 | HIGH | IgG-mediated lung inflammation from inhaled isocyanate-protein conjugates
"""

# --- fixed values: organ scores per alert, and the tracked organs in their order ----
# alert | organ | score
ORGANS_TEXT = """
Benzene Ring | Blood | 70
Benzene Ring | Bone Marrow | 75
Benzene Ring | Liver | 30
Benzene Ring | Immune System | 40
Nitro Group | Blood | 60
Nitro Group | Liver | 65
Nitro Group | Skin | 35
Nitro Group | Kidneys | 30
Aromatic Amine (Primary) | Bladder | 75
Aromatic Amine (Primary) | Blood | 55
Aromatic Amine (Primary) | Liver | 60
Aromatic Amine (Secondary) | Bladder | 60
Aromatic Amine (Secondary) | Blood | 45
Aromatic Amine (Secondary) | Liver | 50
Aldehyde | Lungs | 55
Aldehyde | Skin | 50
Aldehyde | Eyes | 45
Formaldehyde-like | Lungs | 75
Formaldehyde-like | Nasal Cavity | 70
Formaldehyde-like | Blood | 40
Halogenated Alkyl | Liver | 70
Halogenated Alkyl | Brain | 65
Halogenated Alkyl | Kidneys | 50
Halogenated Alkyl | Heart | 40
Polyaromatic Hydrocarbon (3+ fused rings) | Lungs | 70
Polyaromatic Hydrocarbon (3+ fused rings) | Skin | 60
Polyaromatic Hydrocarbon (3+ fused rings) | Bladder | 45
Reactive α,β-Unsaturated Carbonyl | Skin | 55
Reactive α,β-Unsaturated Carbonyl | Liver | 45
Reactive α,β-Unsaturated Carbonyl | GI Tract | 35
Epoxide | DNA/Genome | 80
Epoxide | Liver | 50
Epoxide | Skin | 45
Epoxide | Lungs | 40
Quinone | Blood | 60
Quinone | Liver | 55
Quinone | Kidneys | 45
Hydrazine | Liver | 75
Hydrazine | Immune System | 45
Hydrazine | Blood | 35
Acyl Halide | Skin | 80
Acyl Halide | Lungs | 75
Acyl Halide | Eyes | 70
Acyl Halide | GI Tract | 60
Nitroso Group | Liver | 70
Nitroso Group | GI Tract | 55
Azide | Heart | 65
Azide | Brain | 60
Azide | Mitochondria | 70
Isocyanate | Lungs | 75
Isocyanate | Skin | 50
Isocyanate | Immune System | 55
"""
TRACKED_ORGANS = [
    "Liver", "Kidneys", "Heart", "Brain", "Lungs", "Blood", "Skin", "GI Tract", "Bladder",
    "Bone Marrow", "Eyes", "Immune System", "Nasal Cavity", "DNA/Genome", "Mitochondria",
]

# --- fixed values: pair rules ------------------------------------------------------
# name | alert a | alert b | modifier | explanation
PAIR_RULES_TEXT = """
Aromatic + Nitro → Carcinogenic amplification | Benzene Ring | Nitro Group | 1.35 | Aromatic compounds combined with nitro groups amplify carcinogenic risk through enhanced metabolic activation of nitroaromatics.
Halogenated solvent + Aldehyde → Liver/CNS synergy | Halogenated Alkyl | Aldehyde | 1.30 | Halogenated solvents impair hepatic detoxification, increasing aldehyde-mediated liver damage and CNS depression.
Multiple Aromatic Amines → Blood cancer risk | Aromatic Amine (Primary) | Aromatic Amine (Secondary) | 1.40 | Multiple aromatic amines overwhelm N-acetylation detoxification, dramatically increasing bladder and blood cancer risk.
Epoxide + Quinone → Extreme reactivity | Epoxide | Quinone | 1.50 | Epoxide alkylation combined with quinone-mediated oxidative stress creates extreme genotoxic and cytotoxic synergy.
Aromatic Amine + Nitro → Enhanced mutagenesis | Aromatic Amine (Primary) | Nitro Group | 1.35 | Both share nitroreduction activation pathways, competing for detoxification enzymes and amplifying DNA damage.
Hydrazine + Aldehyde → Hepatotoxic synergy | Hydrazine | Aldehyde | 1.30 | Hydrazine-induced glutathione depletion removes the primary defense against aldehyde reactivity in hepatocytes.
PAH + Benzene → Hematotoxic amplification | Polyaromatic Hydrocarbon (3+ fused rings) | Benzene Ring | 1.25 | Combined PAH and benzene exposure overwhelms CYP-mediated detoxification, amplifying bone marrow toxicity.
"""

# --- fixed values: explanations of the interaction branches without a fired pair rule --
NO_INTERACTION = (
    "Components appear to act independently with no significant pharmacological interaction detected."
)
CONTRAST_INTERACTION = (
    "Components have contrasting toxicity profiles, resulting in additive (averaged) risk."
)
MODERATE_INTERACTION = (
    "Multiple compounds with moderate toxicity combine additively, slightly increasing overall risk."
)
MANY_ALERTS_INTERACTION = (
    "High total structural alert count across components suggests potential synergistic toxicity "
    "through enzyme competition."
)

# --- fixed values: class labels ----------------------------------------------------
CLASS_LABELS = ["NON-TOXIC", "MODERATE", "TOXIC", "HIGH RISK", "CRITICAL"]

# --- fixed values: compound names --------------------------------------------------
NAMES_TEXT = r"""
benzene | c1ccccc1
toluene | Cc1ccccc1
ethanol | CCO
methanol | CO
acetone | CC(C)=O
formaldehyde | C=O
acetaldehyde | CC=O
chloroform | ClC(Cl)Cl
acetic acid | CC(O)=O
phenol | Oc1ccccc1
aniline | Nc1ccccc1
naphthalene | c1ccc2ccccc2c1
anthracene | c1ccc2cc3ccccc3cc2c1
pyrene | c1cc2ccc3cccc4ccc(c1)c2c34
nitrobenzene | [O-][N+](=O)c1ccccc1
tnt | Cc1c([N+]([O-])=O)cc([N+]([O-])=O)cc1[N+]([O-])=O
aspirin | CC(=O)Oc1ccccc1C(O)=O
caffeine | Cn1c(=O)c2c(ncn2C)n(C)c1=O
paracetamol | CC(=O)Nc1ccc(O)cc1
acetaminophen | CC(=O)Nc1ccc(O)cc1
ibuprofen | CC(C)Cc1ccc(C(C)C(O)=O)cc1
nicotine | CN1CCC[C@H]1c1cccnc1
morphine | CN1CC[C@]23c4c5ccc(O)c4O[C@H]2[C@@H](O)C=C[C@H]3[C@@H]1C5
glucose | OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O
water | O
ethylene oxide | C1CO1
vinyl chloride | C=CCl
carbon tetrachloride | ClC(Cl)(Cl)Cl
dichloromethane | ClCCl
dimethylformamide | CN(C)C=O
dmso | CS(C)=O
hydrogen peroxide | OO
ammonia | N
hydrazine | NN
cyclohexane | C1CCCCC1
diethyl ether | CCOCC
thf | C1CCOC1
pyridine | c1ccncc1
acrolein | C=CC=O
styrene | C=Cc1ccccc1
bisphenol a | CC(C)(c1ccc(O)cc1)c1ccc(O)cc1
ddt | ClC(Cl)=C(c1ccc(Cl)cc1)c1ccc(Cl)cc1
metformin | CN(C)C(=N)NC(=N)N
amoxicillin | CC1(C)S[C@@H]2[C@H](NC(=O)[C@@H](N)c3ccc(O)cc3)C(=O)N2[C@@H]1C(O)=O
ciprofloxacin | O=C(O)c1cn(C2CC2)c2cc(N3CCNCC3)c(F)cc2c1=O
doxorubicin | COc1cccc2c1C(=O)c1c(O)c3c(c(O)c1C2=O)C[C@@](O)(C(=O)CO)C[C@@H]3O[C@H]1C[C@H](N)[C@H](O)[C@H](C)O1
warfarin | CC(=O)C[C@@H](c1ccccc1)c1c(O)c2ccccc2oc1=O
diazepam | CN1C(=O)CN=C(c2ccccc2)c2cc(Cl)ccc21
penicillin | CC1(C)S[C@@H]2[C@H](NC(=O)Cc3ccccc3)C(=O)N2[C@@H]1C(O)=O
erythromycin | CC[C@@H]1OC(=O)[C@H](C)[C@@H](O[C@H]2C[C@@](C)(OC)[C@@H](O)[C@H](C)O2)[C@H](C)[C@@H](O[C@@H]2O[C@H](C)C[C@@H](N(C)C)[C@@H]2O)[C@](C)(O)C[C@@H](C)C(=O)[C@H](C)[C@@H](O)[C@]1(C)O
methotrexate | CN(Cc1cnc2nc(N)nc(N)c2n1)c1ccc(C(=O)N[C@@H](CCC(O)=O)C(O)=O)cc1
tamoxifen | CCC(/=C(\c1ccccc1)c1ccc(OCCN(C)C)cc1)c1ccccc1
omeprazole | COc1ccc2[nH]c(S(=O)Cc3ncc(C)c(OC)c3C)nc2c1
losartan | CCCCc1nc(Cl)c(CO)n1Cc1ccc(-c2ccccc2-c2nn[nH]n2)cc1
"""


def _rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in text.strip().splitlines()]


def _default_alerts() -> list[tuple]:
    return [
        (i + 1, name, pattern, int(sev), label, float(boost), description, mechanism)
        for i, ((name, sev, label, boost, description, mechanism), pattern) in enumerate(
            zip(_rows(ALERTS_TEXT), STRUCTURE_PATTERNS, strict=True)
        )
    ]


def _default_diseases() -> list[tuple]:
    return [
        (i + 1, alert, disease, float(p), sev, description)
        for i, (alert, disease, p, sev, description) in enumerate(_rows(DISEASES_TEXT))
    ]


def _default_organs() -> list[tuple]:
    return [(i + 1, alert, organ, float(score)) for i, (alert, organ, score) in enumerate(_rows(ORGANS_TEXT))]


def _default_pair_rules() -> list[tuple]:
    return [
        (i + 1, name, a, b, float(modifier), text)
        for i, (name, a, b, modifier, text) in enumerate(_rows(PAIR_RULES_TEXT))
    ]


ALERT_SCHEMA = (
    "ord int, alert string, pattern string, severity int, severity_label string, "
    "boost double, description string, mechanism string"
)
DISEASE_SCHEMA = "ord int, alert string, disease string, base_prob double, severity string, description string"
ORGAN_SCORE_SCHEMA = "ord int, alert string, organ string, score double"
PAIR_SCHEMA = "ord int, rule string, alert_a string, alert_b string, modifier double, explanation string"


@dataclass(frozen=True)
class RuleBook:
    """One consistent set of rule tables; every list is ordered and bounded."""

    alerts: list[tuple] = field(default_factory=_default_alerts)
    weights: dict[str, float] = field(
        default_factory=lambda: {name: float(w) for name, w in _rows(WEIGHTS_TEXT)}
    )
    default_weight: float = DEFAULT_WEIGHT
    diseases: list[tuple] = field(default_factory=_default_diseases)
    organ_scores: list[tuple] = field(default_factory=_default_organs)
    organs: list[str] = field(default_factory=lambda: list(TRACKED_ORGANS))
    pair_rules: list[tuple] = field(default_factory=_default_pair_rules)
    labels: list[str] = field(default_factory=lambda: list(CLASS_LABELS))
    names: dict[str, str] = field(default_factory=lambda: dict(_rows(NAMES_TEXT)))

    def __post_init__(self) -> None:
        if [a[0] for a in self.alerts] != list(range(1, len(self.alerts) + 1)):
            raise ValueError("alerts must be numbered from 1 in order")
        for table in ("alerts", "weights", "diseases", "organ_scores", "organs", "pair_rules", "names"):
            if len(getattr(self, table)) > MAX_RULES:
                raise ValueError(f"rule table {table} exceeds {MAX_RULES} rows; keep it as a DataFrame")

    @classmethod
    def default(cls) -> RuleBook:
        return cls()

    def with_patterns(self, patterns: list[str]) -> RuleBook:
        """Same alerts, other text patterns (one per alert, in order)."""
        alerts = [(a[0], a[1], p, *a[3:]) for a, p in zip(self.alerts, patterns, strict=True)]
        return replace(self, alerts=alerts)

    # --- as DataFrames ---------------------------------------------------------------
    def alerts_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.alerts, ALERT_SCHEMA)

    def weights_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, alert, w) for i, (alert, w) in enumerate(self.weights.items())]
        return spark.createDataFrame(rows, "ord int, alert string, weight double")

    def diseases_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.diseases, DISEASE_SCHEMA)

    def organ_scores_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.organ_scores, ORGAN_SCORE_SCHEMA)

    def organs_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, organ) for i, organ in enumerate(self.organs)]
        return spark.createDataFrame(rows, "ord int, organ string")

    def pair_rules_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pair_rules, PAIR_SCHEMA)

    def labels_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.labels)), "class int, label string")

    def names_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, name, s) for i, (name, s) in enumerate(self.names.items())]
        return spark.createDataFrame(rows, "ord int, name string, structure string")

    # --- as literals inside expressions ----------------------------------------------
    def alert_attribute(self, ord_: Column, attribute: str) -> Column:
        """Attribute of an alert by its number, from a constant array."""
        index = {"severity_label": 4, "description": 6, "mechanism": 7}[attribute]
        return F.get(constant([a[index] for a in self.alerts], "array<string>"), ord_ - 1)

    def weight_of(self, ord_: Column) -> Column:
        """Mixture weight of an alert by its number, the default for an unlisted one."""
        weights = [self.weights.get(a[1], self.default_weight) for a in self.alerts]
        return F.get(constant(weights, "array<double>"), ord_ - 1)


def constant(value: object, kind: str) -> Column:
    """Constant of a nested type; one literal that Catalyst folds when it plans."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))
