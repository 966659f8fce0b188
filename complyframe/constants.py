"""Values fixed by the domain: dictionaries, enumerations, factors and thresholds."""

from __future__ import annotations

from decimal import Decimal

# --- Fixed values -----------------------------------------------------------
# Spelling to canonical substance. The list is literal on purpose; a spelling
# that is not here stays unrecognised and flagged.
SUBSTANCE_SYNONYMS = {
    "sodium benzoate": "sodium_benzoate",
    "natrium benzoat": "sodium_benzoate",
    "natrium benzoate": "sodium_benzoate",
    "e211": "sodium_benzoate",
    "e 211": "sodium_benzoate",
    "ins 211": "sodium_benzoate",
    "benzoate of soda": "sodium_benzoate",
    "benzoic acid": "benzoic_acid",
    "asam benzoat": "benzoic_acid",
    "e210": "benzoic_acid",
    "e 210": "benzoic_acid",
    "ins 210": "benzoic_acid",
    "potassium benzoate": "potassium_benzoate",
    "kalium benzoat": "potassium_benzoate",
    "e212": "potassium_benzoate",
    "ins 212": "potassium_benzoate",
    "calcium benzoate": "calcium_benzoate",
    "kalsium benzoat": "calcium_benzoate",
    "e213": "calcium_benzoate",
    "ins 213": "calcium_benzoate",
    "sorbic acid": "sorbic_acid",
    "asam sorbat": "sorbic_acid",
    "e200": "sorbic_acid",
    "ins 200": "sorbic_acid",
    "potassium sorbate": "potassium_sorbate",
    "kalium sorbat": "potassium_sorbate",
    "e202": "potassium_sorbate",
    "ins 202": "potassium_sorbate",
    "sulphur dioxide": "sulphur_dioxide",
    "sulfur dioxide": "sulphur_dioxide",
    "sulfur dioksida": "sulphur_dioxide",
    "e220": "sulphur_dioxide",
    "ins 220": "sulphur_dioxide",
    "citric acid": "citric_acid",
    "asam sitrat": "citric_acid",
    "e330": "citric_acid",
    "ins 330": "citric_acid",
    "ascorbic acid": "ascorbic_acid",
    "asam askorbat": "ascorbic_acid",
    "vitamin c": "ascorbic_acid",
    "e300": "ascorbic_acid",
    "ins 300": "ascorbic_acid",
    "ginger": "ginger",
    "jahe": "ginger",
    "zingiber officinale": "ginger",
    "turmeric": "turmeric",
    "kunyit": "turmeric",
    "curcuma longa": "turmeric",
    "honey powder": "honey_powder",
    "bubuk madu": "honey_powder",
    "madu bubuk": "honey_powder",
    "cinnamon": "cinnamon",
    "kayu manis": "cinnamon",
    "sucrose": "sucrose",
    "sugar": "sucrose",
    "gula": "sucrose",
    "sukrosa": "sucrose",
    "salt": "salt",
    "garam": "salt",
    "sodium chloride": "salt",
    "maltodextrin": "maltodextrin",
    "maltodekstrin": "maltodextrin",
    "stevia": "stevia",
    "steviol glycosides": "stevia",
    "e960": "stevia",
    "ins 960": "stevia",
    "aspartame": "aspartame",
    "aspartam": "aspartame",
    "e951": "aspartame",
    "ins 951": "aspartame",
    "tartrazine": "tartrazine",
    "tartrazin": "tartrazine",
    "e102": "tartrazine",
    "ins 102": "tartrazine",
    "carmine": "carmine",
    "karmin": "carmine",
    "cochineal": "carmine",
    "e120": "carmine",
    "ins 120": "carmine",
}

# Spelling to unit.
UNIT_SYNONYMS = {
    "%": "percent_w_w",
    "percent": "percent_w_w",
    "percent_w_w": "percent_w_w",
    "% w/w": "percent_w_w",
    "w/w": "percent_w_w",
    "mg/kg": "mg_per_kg",
    "mg per kg": "mg_per_kg",
    "mg_per_kg": "mg_per_kg",
    "ppm": "ppm",
    "parts per million": "ppm",
}

# From unit, to unit: factor. Nothing else converts.
UNIT_FACTORS = {
    ("percent_w_w", "percent_w_w"): Decimal("1"),
    ("percent_w_w", "mg_per_kg"): Decimal("10000"),
    ("percent_w_w", "ppm"): Decimal("10000"),
    ("mg_per_kg", "percent_w_w"): Decimal("0.0001"),
    ("mg_per_kg", "mg_per_kg"): Decimal("1"),
    ("mg_per_kg", "ppm"): Decimal("1"),
    ("ppm", "percent_w_w"): Decimal("0.0001"),
    ("ppm", "mg_per_kg"): Decimal("1"),
    ("ppm", "ppm"): Decimal("1"),
}

PRODUCT_TYPES = ("food_beverage_powder", "food_beverage_liquid", "food_solid", "supplement", "cosmetic")
CLAUSE_TYPES = ("numeric_limit", "documentation", "labeling", "certification", "other")
EVENT_TYPES = (
    "document_ingested",
    "clause_created",
    "clause_superseded",
    "clause_flagged_review",
    "conflict_opened",
    "requirement_created",
    "requirement_changed",
    "product_created",
    "product_updated",
    "product_status_changed",
)

SEED_MARKETS = (
    ("market_de", "Germany", "DE", ["EU"], "European Union — Germany", "European Commission"),
    ("market_id", "Indonesia", "ID", ["ID_BPOM"], "Indonesia — BPOM", "Badan Pengawas Obat dan Makanan"),
)

# Source text, register id, pages, checksum prefix, in force from, in force to.
SOURCE_CATALOGUE = (
    ("eu_1333_2008_original", "32008R1333", 18, "e5c612ae", None, None),
    ("eu_1129_2011_annex_ii", "32011R1129", 177, "abd470f7", None, None),
    ("eu_1333_2008_feb_2026", "02008R1333-20260218", 366, "e5fa1966", "2026-02-18", "2026-08-17"),
    ("eu_1333_2008_aug_2026", "02008R1333-20260818", 366, "f7dc3221", "2026-08-18", None),
    ("bpom_11_2019", "bpom-11-2019", 1156, "1b9f67b5", None, None),
)

WORKSPACE_ID = "ws_demo"
NAME_MAX = 200
ORIGIN_LENGTH = 2
PACKAGING_MAX = 200
MAX_PAGES = 100
MAX_BYTES = 20 * 1024 * 1024
SIMILAR_K = 10
LIST_LIMIT = 50
MAX_ATTEMPTS = 5
EXTRACT_P95_SECONDS = 120
PROPAGATION_SECONDS = 90
REVIEW_CONFIDENCE = Decimal("0.5")
WEIGHT_PARSE = Decimal("0.3")
WEIGHT_CONSISTENCY = Decimal("0.4")
WEIGHT_AUTHORITY = Decimal("0.3")
# --- End of fixed values ----------------------------------------------------

# Ours: only the order of the tiers is given, so the lower two values and the
# floor under which a source may not change state are choices made here.
AUTHORITY_TIERS = {
    "official_regulation": Decimal("1.0"),
    "industry_article": Decimal("0.6"),
    "social": Decimal("0.2"),
}
AUTHORITY_FLOOR = Decimal("0.5")

ANY_PRODUCT_TYPE = "*"
BASE_UNIT = "mg_per_kg"

# Worse states have the larger ordinal.
STATUS_ORDINALS = {"unknown": 0, "compliant": 1, "attention_required": 2, "non_compliant": 3}

DOCUMENT_MOVES = (
    ("uploaded", "extracting"),
    ("extracting", "extracted"),
    ("extracted", "reconciling"),
    ("reconciling", "reconciled"),
    ("extracting", "failed"),
    ("extracted", "failed"),
    ("reconciling", "failed"),
    ("failed", "extracting"),
    ("failed", "reconciling"),
)
CLAUSE_MOVES = (
    ("pending_reconciliation", "active"),
    ("pending_reconciliation", "superseded"),
    ("pending_reconciliation", "needs_review"),
    ("active", "superseded"),
    ("active", "conflicted"),
    ("active", "needs_review"),
    ("needs_review", "active"),
)
CONFLICT_MOVES = (("open", "resolved"),)
