"""Controlled vocabularies and their rules, as data: rendered to Spark columns and to oracle SQL from one definition."""

# Classes, codes, patterns and rule names that records and reports hold.
STRUCTURE_CLASSES = ("101", "102", "103", "104", "105", "1-4")
BUNDLE = r"1 *, *2 *, *3 *famil|one.?two.?three famil|one/two famil|single ?family ?/ ?duplex|sf ?/ ?duplex"
STRUCTURE_RULES = (
    (r"five or more|5\+ *(unit|famil)|multi[- ]?family|apartment|apt\b", "105", "kw:multifamily"),
    (r"three *(&|and) *four|3 *(&|and|-) *4 *famil|triplex|fourplex|quadplex", "104", "kw:three-four"),
    (r"two *famil|duplex|2 *famil", "103", "kw:two-family"),
    (r"secondary apartment|accessory dwelling|\badu\b|townhou?se|row ?house", "102", "kw:attached"),
    (r"single ?famil|one ?famil|\bsfr\b|\bsfd\b|detached dwelling", "101", "kw:single-family"),
)
WORK_RULES = (
    (r"\bdemoli|\bdemo\b|\braze\b", "DEMOLITION", "kw:demolition"),
    (r"\bnew\b|new structure|new construction", "NEW", "kw:new"),
    (r"\baddition\b|\baddn\b", "ADDITION", "kw:addition"),
    (r"remodel|renovat|alterat|rehab|repair|replace|upfit|finish ?out|tenant|change ?out|upgrade", "ALTERATION", "kw:alteration"),
    (r"\bother\b|unspecified", "OTHER", "kw:other"),
)
KIND_RULES = (
    (r"electric", "ELECTRICAL", "kw:electrical"),
    (r"mechanical|\bhvac\b", "MECHANICAL", "kw:mechanical"),
    (r"plumb", "PLUMBING", "kw:plumbing"),
    (r"\bbuilding\b|\bbldg\b|\bbp\b", "BUILDING", "kw:building"),
    (r"\bsign\b|graphics|tree removal|driveway|sidewalk|irrigation|fence|tent|festival|\bpool\b|roofing|siding", "OTHER", "kw:not-a-building"),
)
KIND_CODES = {"BP": "BUILDING", "EP": "ELECTRICAL", "MP": "MECHANICAL", "PP": "PLUMBING"}
IMPLY_RULES = ("bps-code", "kw:single-family", "kw:attached", "kw:two-family")
IMPLIED_UNITS = {"101": 1, "102": 1, "103": 2}
BPS_COLUMNS = {"101": "u1", "102": "u1", "103": "u2", "104": "u34", "105": "u5p", "1-4": "low_bundle"}
MILESTONES = ("applied", "issued", "finaled", "terminated")
UNIT_SOURCES = ("field", "parsed_from_text", "implied_by_structure_code", "absent")
ALARM_LEVELS = {"permit_kind": 0.90, "work_class": 0.90, "structure_type": 0.99, "unit_count": 0.95}
#: A published legend of codes: code, label, structure class, work, kind, units that the code names, why it is no unit.
CODES = (
    ("101", "1 SINGLE FAMILY(DETACHED).", "101", "NEW", "BUILDING", 1, None),
    ("101M", "SINGLE FAMILY (MODULAR)", "101", "NEW", "BUILDING", 1, None),
    ("102", "1 SINGLE FAMILY (ATTACHED)", "102", "NEW", "BUILDING", 1, None),
    ("103", "2 FAMILIES", "103", "NEW", "BUILDING", 2, None),
    ("104", "3 & 4 FAMILIES.", "104", "NEW", "BUILDING", None, None),
    ("105", "5 OR MORE FAMILIES", "105", "NEW", "BUILDING", None, None),
    ("601", "SINGLE FAMILY W/ATTACHED COMMERCIAL", "101", "NEW", "BUILDING", 1, None),
    ("602", "TOWNHOUSE W/ ATTACHED COMMERCIAL", "102", "NEW", "BUILDING", 1, None),
    ("603", "DUPLEX W/ ATTACHED COMMERCIAL", "103", "NEW", "BUILDING", 2, None),
    ("604", "3 & 4 FAMILIES W/ ATTACHED COMMERCIAL", "104", "NEW", "BUILDING", None, None),
    ("605", "5 OR MORE FAMILIES W/ATTACHED COMM.", "105", "NEW", "BUILDING", None, None),
    ("700", "MOBILE HOME", None, "NEW", "BUILDING", None, "mobile-home: outside the Census building permit survey"),
    ("660", "RESIDENTIAL COMPLETION", None, "OTHER", "BUILDING", None, "completion record, not an issuance"),
    ("665", "COMMERCIAL COMPLETION", None, "OTHER", "BUILDING", None, "completion record, not an issuance"),
    ("328D", "RESIDENTIAL ACCESSORY DWELLINGS", None, "NEW", "BUILDING", None, "ADU: new-unit vs alteration not determined by the code"),
    ("213", "HOTEL/MOTEL", None, "NEW", "BUILDING", None, None),
    ("214", "NONHOUSEKEEPING SHELTER", None, "NEW", "BUILDING", None, None),
    ("318", "AMUSEMENT", None, "NEW", "BUILDING", None, None),
    ("319", "CHURCH", None, "NEW", "BUILDING", None, None),
    ("320", "INDUSTRIAL/FACTORY", None, "NEW", "BUILDING", None, None),
    ("320S", "INDUSTRIAL/FACTORY SHELL", None, "NEW", "BUILDING", None, None),
    ("321", "PARKING GARAGES", None, "NEW", "BUILDING", None, None),
    ("322", "SERV.STATION & REPAIR GAR.", None, "NEW", "BUILDING", None, None),
    ("323", "HOSPITAL", None, "NEW", "BUILDING", None, None),
    ("324", "OFFICE BANKS PROFESSIONAL", None, "NEW", "BUILDING", None, None),
    ("324M", "OFFICE, BANKS, PROFESSIONAL, MODULAR", None, "NEW", "BUILDING", None, None),
    ("324S", "OFFICE, BANKS, PROFESSIONAL, SHELL", None, "NEW", "BUILDING", None, None),
    ("325", "PUBLIC WKS.&UTILITIES", None, "NEW", "BUILDING", None, None),
    ("326", "SCHOOLS & OTHER EDUC.", None, "NEW", "BUILDING", None, None),
    ("326M", "SCHOOLS/EDUCATION MODULAR", None, "NEW", "BUILDING", None, None),
    ("327", "STORES/CUSTOMER SERVICES", None, "NEW", "BUILDING", None, None),
    ("327S", "STORES, RESTAURANTS, MALL, SHELL", None, "NEW", "BUILDING", None, None),
    ("328", "RESIDENTIAL ACCESSORY STRUCTURE SHED,CARPORT,", None, "ADDITION", "BUILDING", None, None),
    ("328C", "COMMERCIAL SHED, ACCESSORY STRUCTURE, CARPORT,", None, "ADDITION", "BUILDING", None, None),
    ("330", "SUMMER KITCHEN", None, "ADDITION", "BUILDING", None, None),
    ("335", "RESIDENTIAL PORCH, SCREEN ROOM/LANAI, GLASS ROOMS", None, "ADDITION", "BUILDING", None, None),
    ("434", "RESIDENTIAL/ADDITION", None, "ADDITION", "BUILDING", None, None),
    ("434E", "RESIDENTIAL EXTERIOR REPAIRS (WINDOW/DOOR, SIDING)", None, "ALTERATION", "BUILDING", None, None),
    ("434R", "RESIDENTIAL RENOVATION/REPAIRS (INTERIOR)", None, "ALTERATION", "BUILDING", None, None),
    ("435", "RESIDENTIAL ROOF (REPAIR, REPLACEMENT, NEW)", None, "ALTERATION", "BUILDING", None, None),
    ("435C", "COMMERCIAL ROOF(REPAIR, REPLACEMENT, NEW)", None, "ALTERATION", "BUILDING", None, None),
    ("437", "COMMERCIAL ADDITION", None, "ADDITION", "BUILDING", None, None),
    ("437B", "COMMERCIAL BUILD-OUT (PREVIOUS USE SHELL)", None, "ALTERATION", "BUILDING", None, None),
    ("437R", "COMMERCIAL RENOVATION", None, "ALTERATION", "BUILDING", None, None),
    ("438", "RESIDENTIAL GARAGES/CARPORT (DETACHED)", None, "ADDITION", "BUILDING", None, None),
    ("650", "CHANGE OF OCCUPANCY/USE CLASSIFICATION", None, "ALTERATION", "BUILDING", None, None),
    ("645", "DEMOLITION/RESIDENTIAL", None, "DEMOLITION", "BUILDING", None, None),
    ("649", "DEMOLITION/ALL OTHER BLDGS", None, "DEMOLITION", "BUILDING", None, None),
    ("329", "RESIDENTIAL SWIMMING POOL", None, "NEW", "OTHER", None, None),
    ("329A", "ABOVE GROUND POOL", None, "NEW", "OTHER", None, None),
    ("329C", "COMMERCIAL PUBLIC POOL", None, "NEW", "OTHER", None, None),
    ("329E", "POOL ENCLOSURE", None, "ADDITION", "OTHER", None, None),
    ("329H", "HARDSCAPE", None, "OTHER", "OTHER", None, None),
    ("329R", "SWIMMING POOL REPAIR", None, "ALTERATION", "OTHER", None, None),
    ("329S", "SPA", None, "NEW", "OTHER", None, None),
    ("500", "MISC", None, "OTHER", "OTHER", None, None),
    ("500C", "COMMERCIAL MISC (DECKS, ENTRY FEATURE, HARDSCAPE)", None, "OTHER", "OTHER", None, None),
    ("500S", "SPRINKLER SYSTEM", None, "OTHER", "OTHER", None, None),
    ("501", "COMMUNICATION TOWERS", None, "NEW", "OTHER", None, None),
    ("502", "SIGN", None, "OTHER", "OTHER", None, None),
    ("503", "RETAINING WALL/BULKHEAD", None, "OTHER", "OTHER", None, None),
    ("504", "Dock,Bulkhead, Boathouse, Bulkhead (Treasure Beach", None, "OTHER", "OTHER", None, None),
    ("505", "TEMPORARY COASTAL ARMORING", None, "OTHER", "OTHER", None, None),
    ("670", "SOLAR (PANELS, PHOTOVOLTAIC, WATER/POOL HEATER)", None, "OTHER", "OTHER", None, None),
    ("670C", "COMMERCIAL SOLAR", None, "OTHER", "OTHER", None, None),
    ("800", "Storm Damage (Property Owner )", None, "ALTERATION", "OTHER", None, None),
    ("801", "Storm Damage (Field Inspection)", None, "ALTERATION", "OTHER", None, None),
)
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def case_sql(rules, text: str, default: str = "NULL") -> tuple[str, str]:
    """The rules as two DuckDB expressions, value and rule name, of the lower-cased text expression."""
    value = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{v}'" for p, v, _ in rules)
    rule = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{r}'" for p, _, r in rules)
    return f"CASE {value} ELSE {default} END", f"CASE {rule} END"
