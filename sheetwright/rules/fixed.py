"""Fixed values.

The lists, tables, patterns and thresholds below define results and must stay
as they are. Order counts where the first match wins.
"""

# -- fixed values: field patterns, labels and title block words ----------------

FIELD_PATTERNS = {
    "sheet_number": r"\b[A-Z]{1,2}[-]?\d{1,3}(?:\.\d{1,2})?\b",
    "project_number": r"[A-Z]?\d{4,}[-.]?\d*",
    "date": r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    "scale": r"""\d+['"/]?\s*[=:]\s*\d+['"/-]*\d*""",
}
TITLE_BLOCK_KEYWORDS = [
    "SHEET", "PROJECT", "DRAWING", "SCALE", "DATE", "REVISION", "TITLE", "DRAWN", "CHECKED",
    "APPROVED", "DWG", "NO.", "ARCHITECT", "ENGINEER", "CLIENT", "ISSUE", "REV", "BY",
]
DISCIPLINE_CODES = {
    "A": "Architectural", "M": "Mechanical", "S": "Structural", "E": "Electrical",
    "P": "Plumbing", "C": "Civil", "L": "Landscape", "G": "General",
}

# -- fixed values: categories ---------------------------------------------------

SHEET_CATEGORIES = {
    "floor_plans": {
        "folder": "floor_plans",
        "title": [
            r"\bfloor\s*plan", r"\boverall\s*plan", r"\bbuilding\s*plan", r"\barea\s*plan", r"\blevel\s*\d+\s*plan",
            r"\b(first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th)\s*(floor|level)\s*plan", r"\bbasement\s*plan",
            r"\bmezzanine\s*plan", r"\bground\s*(floor|level)\s*plan", r"\bpenthouse\s*plan", r"\broof\s*plan", r"\bunit\s*plans?\b",
        ],
        "number": [r"^A[1-9]0[1-9]", r"^A[1-9]1\d"],
    },
    "reflected_ceiling_plans": {
        "folder": "reflected_ceiling_plans",
        "title": [r"\breflected\s*ceiling", r"\bRCP\b", r"\bceiling\s*plan", r"\bceiling\s*layout"],
        "number": [r"^A[1-9]2\d"],
    },
    "room_finish_schedules": {
        "folder": "room_finish_schedules",
        "title": [r"\broom\s*finish", r"\bfinish\s*schedule", r"\bfinish\s*plan", r"\binterior\s*finish", r"\bmaterial\s*schedule", r"\bcolor\s*schedule"],
        "number": [],
    },
    "interior_elevations": {
        "folder": "interior_elevations",
        "title": [
            r"\binterior\s*elevation", r"\bint\.?\s*elevation", r"\broom\s*elevation", r"\bwall\s*elevation",
            r"\bcasework\s*elevation", r"\bcabinet\s*elevation", r"\bmillwork\s*elevation", r"\belevation.*\binterior",
        ],
        "number": [r"^A[1-9]3\d"],
    },
    "exterior_elevations": {
        "folder": "exterior_elevations",
        "title": [
            r"\bexterior\s*elevation", r"\bext\.?\s*elevation", r"\bbuilding\s*elevation", r"\bfront\s*elevation", r"\brear\s*elevation",
            r"\bside\s*elevation", r"\b(north|south|east|west)\s*elevation", r"\belevation.*\bexterior", r"^elevations?$",
        ],
        "number": [r"^A[2-3]0\d"],
    },
    "cover_sheets": {
        "folder": "cover_sheets",
        "title": [
            r"\bcover\s*sheet", r"\btitle\s*sheet", r"\bsheet\s*index", r"\bdrawing\s*index", r"\bgeneral\s*notes", r"\bcode\s*analysis",
            r"\bcode\s*compliance", r"\bproject\s*data", r"\blife\s*safety", r"\bada\s*", r"\baccessibility", r"\babbreviations", r"\bsymbols?\s*legend",
        ],
        "number": [r"^[AG]0", r"^A-0"],
    },
}
NOT_NEEDED = "properly_classified_not_needed"
NOT_NEEDED_TITLE = [
    r"\bstructural", r"\bframing\s*plan", r"\bfoundation\s*plan", r"\bmechanical", r"\belectrical", r"\bplumbing", r"\bhvac",
    r"\bfire\s*(protection|alarm|sprinkler)", r"\bpower\s*plan", r"\blighting\s*plan", r"\bcivil", r"\bsite\s*plan", r"\bgrading\s*plan",
    r"\butility\s*plan", r"\blandscape", r"\birrigation", r"\bwall\s*section", r"\bbuilding\s*section", r"\bdetail", r"\benlarged", r"\bstair",
    r"\belevator", r"\bdoor\s*schedule", r"\bwindow\s*schedule", r"\bhardware\s*schedule", r"^schedules?$", r"\bloading\s*plan",
    r"\bdemolition\s*elevation", r"\bsignage", r"\bsign\s*plan",
]
NOT_NEEDED_NUMBER = [r"^S\d", r"^M\d", r"^E\d", r"^P\d", r"^C\d", r"^L\d"]
EXPANDED_CATEGORIES = {
    "finish_plans": {"title": [r"\bfinish\s*plan", r"\blower\s*level\s*finish", r"\bupper\s*level\s*finish", r"\bfinish\s*floor\s*plan", r"\bfinish\s*layout"], "number": []},
    "partition_plans": {"title": [r"\bpartition\s*plan", r"\bpartition\s*layout", r"\bwall\s*layout\s*plan", r"\bwall\s*type\s*plan"], "number": []},
    "door_schedules": {"title": [r"\bdoor\s*schedule", r"\bdoor\s*&\s*frame\s*schedule", r"\bdoor\s*type", r"\bhardware\s*schedule", r"\bhardware\s*set"], "number": []},
    "window_schedules": {"title": [r"\bwindow\s*schedule", r"\bwindow\s*type", r"\bglazing\s*schedule", r"\bstorefront\s*schedule"], "number": []},
    "building_sections": {"title": [r"\bbuilding\s*section", r"\bcross\s*section", r"\blongitudinal\s*section", r"\btransverse\s*section", r"\btypical\s*section"], "number": [r"^A[3-4]0\d"]},
    "wall_sections": {"title": [r"\bwall\s*section", r"\bexterior\s*wall\s*section", r"\binterior\s*wall\s*section", r"\btypical\s*wall"], "number": []},
    "enlarged_plans": {
        "title": [
            r"\benlarged\s*plan", r"\benlarged\s*floor\s*plan", r"\btoilet\s*room\s*plan", r"\brestroom\s*plan", r"\bbathroom\s*plan",
            r"\blobby\s*plan", r"\bstair\s*plan", r"\belevator\s*lobby", r"\bentry\s*plan", r"\bvestibule\s*plan",
        ],
        "number": [r"^A[4-5]0\d"],
    },
    "demolition_plans": {"title": [r"\bdemolition\s*plan", r"\bdemo\s*plan", r"\bexisting\s*plan", r"\bexisting\s*conditions", r"\bexisting\s*to\s*remain"], "number": []},
}
PAINTING_RELEVANCE = {
    "floor_plans": "PRIMARY", "reflected_ceiling_plans": "PRIMARY", "room_finish_schedules": "PRIMARY", "interior_elevations": "PRIMARY",
    "finish_plans": "PRIMARY", "paint_schedules": "PRIMARY", "color_schedules": "PRIMARY", "partition_plans": "PRIMARY",
    "exterior_elevations": "SECONDARY", "building_sections": "SECONDARY", "enlarged_plans": "SECONDARY", "door_schedules": "SECONDARY",
    "window_schedules": "SECONDARY", "wall_sections": "SECONDARY", "details": "SECONDARY",
    "cover_sheets": "REFERENCE", "general_notes": "REFERENCE", "code_analysis": "REFERENCE", "life_safety": "REFERENCE", "accessibility": "REFERENCE",
    "structural": "IRRELEVANT", "mechanical": "IRRELEVANT", "electrical": "IRRELEVANT", "plumbing": "IRRELEVANT", "fire_protection": "IRRELEVANT",
    "civil": "IRRELEVANT", "landscape": "IRRELEVANT", "site_plans": "IRRELEVANT", "properly_classified_not_needed": "IRRELEVANT",
}
SIGNAL_WEIGHTS = {"drawing_index": 0.50, "title_pattern": 0.40, "vision_api": 0.35, "content_analysis": 0.30, "sheet_number": 0.25}
DEFAULT_WEIGHT = 0.25

# -- fixed values: sheet number standard ----------------------------------------

DISCIPLINE_NAMES = {
    "A": "Architectural", "I": "Interiors", "S": "Structural", "M": "Mechanical", "E": "Electrical", "P": "Plumbing",
    "C": "Civil", "L": "Landscape", "G": "General", "Q": "Equipment", "F": "Fire Protection", "T": "Telecommunications",
}
SHEET_TYPE_NAMES = {
    0: "General", 1: "Plans", 2: "Elevations", 3: "Sections", 4: "Large-Scale Views",
    5: "Details", 6: "Schedules", 7: "User-Defined", 8: "User-Defined", 9: "3D Representations",
}
#: (discipline, sheet type or None for any): relevance
NCS_RELEVANCE = {
    ("S", None): "IRRELEVANT", ("M", None): "IRRELEVANT", ("E", None): "IRRELEVANT", ("P", None): "IRRELEVANT", ("C", None): "IRRELEVANT",
    ("L", None): "IRRELEVANT", ("F", None): "IRRELEVANT", ("T", None): "IRRELEVANT", ("Q", None): "IRRELEVANT",
    ("A", 1): "PRIMARY", ("A", 6): "PRIMARY", ("I", 1): "PRIMARY", ("I", 2): "PRIMARY", ("I", 6): "PRIMARY",
    ("A", 2): "SECONDARY", ("A", 3): "SECONDARY", ("A", 4): "SECONDARY", ("I", 3): "SECONDARY", ("I", 4): "SECONDARY", ("I", 5): "SECONDARY",
    ("A", 0): "REFERENCE", ("A", 5): "REFERENCE", ("G", 0): "REFERENCE", ("G", None): "REFERENCE", ("I", 0): "REFERENCE",
}

# -- fixed values: titles of several drawings -----------------------------------

COMBO_SEPARATORS = [r"\n", r"\s+AND\s+", r"\s+&\s+", r"\s+/\s+", r"\s+-\s+-\s+"]
NOT_COMBO = [
    r"FLOOR\s+PLAN\s*[-/]\s*LEVEL\s+\d+", r"LEVEL\s+\d+\s*[-/]\s*FLOOR\s+PLAN", r"\d+(ST|ND|RD|TH)\s+FLOOR\s*[-/]\s*",
    r"[-/]\s*\d+(ST|ND|RD|TH)\s+FLOOR", r"BASEMENT\s*[-/]\s*LEVEL", r"OPTION\s+[A-Z]\s*[-/]", r"[-/]\s*OPTION\s+[A-Z]", r"ALTERNATE\s*[-/]",
    r"ALT\s*[-/]", r"PHASE\s+\d+\s*[-/]", r"[-/]\s*PHASE\s+\d+", r"BUILDING\s+[A-Z0-9]+\s*[-/]", r"[-/]\s*BUILDING\s+[A-Z0-9]+",
    r"WING\s+[A-Z0-9]+\s*[-/]", r"NORTH\s*[-/]\s*SOUTH", r"EAST\s*[-/]\s*WEST", r"""\d+['"]\s*[-=]\s*\d+""", r"\d+\s*[-/]\s*\d+\s*[-/]\s*\d+",
]
DRAWING_TYPES = {
    "floor_plan": [
        r"\bfloor\s*plan\b", r"\bfloor\s+\d+\s*plan\b", r"\b(first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th)\s+(floor|level)\s*plan\b",
        r"\bbasement\s*plan\b", r"\bmezzanine\s*plan\b", r"\bpenthouse\s*plan\b", r"\bground\s*(floor|level)\s*plan\b", r"\blevel\s+\d+\s*plan\b",
        r"\boverall\s*plan\b", r"\bfinish\s*plan\b", r"\bdemolition\s*plan\b", r"\bpartition\s*plan\b", r"\bfurniture\s*plan\b",
        r"\bpower\s*\&?\s*comm(unications?)?\s*plan\b",
    ],
    "reflected_ceiling_plan": [r"\breflected\s*ceiling\s*plan\b", r"\bRCP\b", r"\bceiling\s*plan\b", r"\bceiling\s*layout\b"],
    "roof_plan": [r"\broof\s*plan\b", r"\broofing\s*plan\b"],
    "interior_elevation": [
        r"\binterior\s*elevation\b", r"\bint\.?\s*elevation\b", r"\broom\s*elevation\b", r"\bwall\s*elevation\b",
        r"\bcasework\s*elevation\b", r"\bcabinet\s*elevation\b", r"\bmillwork\s*elevation\b",
    ],
    "exterior_elevation": [
        r"\bexterior\s*elevation\b", r"\bext\.?\s*elevation\b", r"\bbuilding\s*elevation\b", r"\b(north|south|east|west)\s*elevation\b",
        r"\bfront\s*elevation\b", r"\brear\s*elevation\b", r"\bside\s*elevation\b",
    ],
    "section": [r"\bbuilding\s*section\b", r"\bwall\s*section\b", r"\bcross\s*section\b", r"\blongitudinal\s*section\b", r"\btransverse\s*section\b"],
    "schedule": [
        r"\bfinish\s*schedule\b", r"\broom\s*finish\b", r"\bdoor\s*schedule\b", r"\bwindow\s*schedule\b",
        r"\bhardware\s*schedule\b", r"\bcolor\s*schedule\b", r"\bpaint\s*schedule\b",
    ],
    "detail": [r"\bdetail\b", r"\bdetails\b", r"\benlarged\b"],
    "cover_sheet": [r"\bcover\s*sheet\b", r"\btitle\s*sheet\b", r"\bsheet\s*index\b", r"\bdrawing\s*index\b", r"\bgeneral\s*notes\b"],
}

# -- fixed values: title rules ---------------------------------------------------

#: (pattern, whether case is ignored)
TITLE_GARBAGE = [
    (r"PROJECT\s*NO\.?", True), (r"sheet\s*number", True), (r"date\s*description", True), (r"PRELIMINARY", True), (r"NOT\s+FOR\s+CONSTRUCTION", True),
    (r"This\s+drawing", True), (r"design\s+concepts", True), (r"\d{3}[-.\s]\d{3}[-.\s]\d{4}", False), (r"^\d{5}$", False),
    (r"\bLLC\b|\bINC\b|\bCORP\b|\bLTD\b", True), (r"www\.", True), (r"@", False), (r"Gmp[/\s]?permit", True), (r"permit\s*set", True),
    (r"^Part\s+\d+", True), (r"End\s+of\s+Section", True), (r"Contract,?\s+apply", True), (r"^\d{3,5}$", False),
    (r"^[A-Z]{1,2}[-.]?\d{1,3}(\.\d{1,2})?$", True), (r"^\d+\s+[NSEW]\.?\s+\w+", True),
    (r"\b(Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr)\b", True), (r"Larrabee", True), (r"Woodward", True), (r"Frontage\s*Rd", True),
    (r"Loop\s+\d+", True), (r"""^\d+['"]?\s*[-=]\s*\d+""", True), (r"^C\.?c\.?d\.?$", True), (r"manufacturers?\s+specified", True),
    (r"site/platform", True), (r"^knowledge,?$", True), (r"^equipment[,.]?$", True), (r"^urban$", True), (r"^in\s+this\s+section", True),
    (r"^(North|South|East|West)\s+Corridor$", True), (r"^Germantown$", True), (r"^Graceland\s+Avenue$", True),
]
SINGLE_KEYWORD_REJECTS = ["PLAN", "SECTION", "DETAIL", "DIAGRAM", "NOTES", "LEGEND", "INDEX", "FLOOR", "GENERAL"]
VALID_SINGLE_WORDS = [
    "APARTMENTS", "ELEVATIONS", "ELEVATION", "DETAILS", "SECTIONS", "PLANS", "SCHEDULES", "SCHEDULE", "SPECIFICATIONS", "SPECIFICATION",
    "DEMOLITION", "MECHANICAL", "ELECTRICAL", "PLUMBING", "STRUCTURAL", "CIVIL", "LANDSCAPE", "INTERIOR", "EXTERIOR", "FOUNDATION",
    "HVAC", "FRAMING", "PARTITIONS", "CEILINGS", "FINISHES",
]
VALID_TITLE_KEYWORDS = [
    "PLAN", "ELEVATION", "SECTION", "DETAIL", "SCHEDULE", "NOTES", "DIAGRAM", "LAYOUT", "VIEW", "SPECIFICATIONS",
    "FLOOR", "CEILING", "ROOF", "SITE", "FOUNDATION", "FRAMING", "REFLECTED", "ENLARGED", "DEMOLITION",
    "NORTH", "SOUTH", "EAST", "WEST", "FRONT", "REAR", "SIDE", "INTERIOR", "EXTERIOR", "BUILDING", "WALL", "DOOR", "WINDOW",
    "ELECTRICAL", "MECHANICAL", "PLUMBING", "HVAC", "FIRE", "LIFE SAFETY", "STRUCTURAL", "CIVIL", "LANDSCAPE",
    "GENERAL", "CODE", "ADA", "ACCESSIBILITY", "INDEX", "COVER", "PARTITION", "FINISH", "FIXTURE", "EQUIPMENT",
]
TITLE_ACRONYMS = ["ADA", "HVAC", "MEP", "RCP", "VIF", "NIC", "TYP", "GWB", "CMU", "ACT", "NTS", "EQ", "CLR", "OC", "ID", "OD", "FF", "TOS", "TOC", "BOC"]
TITLE_MIN, TITLE_SOFT_MAX, TITLE_MAX = 3, 60, 120
METHOD_CONFIDENCE = {"drawing_index": 0.95, "vision_api": 0.90, "spatial": 0.80, "pattern": 0.70}
REVIEW_THRESHOLD = 0.70
TITLE_LABELS = [
    "PROJECT NUMBER", "PROJECT NO", "PROJECT #", "PROJECT", "PLOT DATE", "DATE", "ISSUE DATE", "REVISION DATE", "SCALE", "DRAWING SCALE",
    "SHEET SCALE", "SHEET NUMBER", "SHEET NO", "SHEET #", "SHEET", "DRAWING NUMBER", "DRAWING NO", "DWG NO", "DWG", "REVISION", "REV",
    "REVISION NO", "DRAWN BY", "DRAWN", "DRAFTED BY", "CHECKED BY", "CHECKED", "CHECKER", "APPROVED BY", "APPROVED", "APPROVAL", "DESIGNED BY",
    "DESIGNER", "NAME AND TITLE", "NAME SIGNATURE", "SIGNATURE", "ADDRESS", "LOCATION", "SITE", "CLIENT", "OWNER", "ARCHITECT", "ENGINEER",
    "PHONE", "FAX", "EMAIL", "COPYRIGHT", "CONFIDENTIAL", "NOT FOR CONSTRUCTION", "PRELIMINARY", "DRAFT", "TITLE BLOCK", "TITLE:",
]
DRAWING_INDEX_KEYWORDS = ["DRAWING INDEX", "SHEET INDEX", "INDEX OF DRAWINGS", "LIST OF DRAWINGS", "DRAWING LIST", "SHEET LIST"]
DISCIPLINE_HEADERS = [
    "ARCHITECTURAL", "STRUCTURAL", "MECHANICAL", "ELECTRICAL", "PLUMBING", "CIVIL", "LANDSCAPE", "GENERAL", "FIRE PROTECTION",
    "INTERIOR", "SITE", "LIGHTING", "HVAC", "SPECIFICATIONS",
]
INDEX_PAGES, FUZZY_RATIO = 5, 0.80

# -- fixed values: sheet number rules --------------------------------------------

STRICT_NUMBER = r"(?i)^[A-Z]{1,2}[-.]?\d{1,4}(?:\.\d{1,2})?$"
NUMBER_BLACKLIST = [
    "TO", "NO", "SO", "RO", "CO", "FO", "DO", "GO", "PO", "MO", "LO", "WO", "BO", "HO", "OO", "YO", "IO", "UO", "EO", "AO",
    "AT", "AS", "BY", "IF", "IN", "IS", "IT", "OF", "ON", "OR", "UP", "AN", "BE", "HE", "ME", "MY", "OK", "OX", "US", "WE",
    "T.O", "N.O", "F.O", "R.O", "P.O", "B.O", "C.O", "D.O", "S.O", "T.O.", "N.O.", "F.O.", "R.O.", "P.O.", "B.O.", "C.O.", "D.O.", "S.O.",
    "TA4", "NO.", "SH", "DW", "DWG", "REV", "REF", "ADD", "ALL", "AND", "ARE", "BUT", "CAN", "FOR", "HAD", "HAS", "HER", "HIM", "HIS",
    "HOW", "ITS", "LET", "MAY", "NEW", "NOT", "NOW", "OLD", "OUR", "OUT", "OWN", "SAY", "SHE", "THE", "TOO", "TRY", "TWO", "USE", "WAY",
    "WHO", "WHY", "YET", "YOU",
]

# -- fixed values: learning and templates ------------------------------------------

QUALITY_KEYWORDS = [
    "PLAN", "ELEVATION", "SECTION", "DETAIL", "SCHEDULE", "DIAGRAM", "LAYOUT", "VIEW", "FLOOR", "CEILING", "ROOF", "SITE", "FOUNDATION",
    "FRAMING", "REFLECTED", "ENLARGED", "DEMOLITION", "INTERIOR", "EXTERIOR", "NORTH", "SOUTH", "EAST", "WEST", "FRONT", "REAR", "WALL",
    "DOOR", "WINDOW", "STAIR", "PARTITION", "ELECTRICAL", "MECHANICAL", "PLUMBING", "HVAC", "FIRE", "STRUCTURAL", "CIVIL", "LANDSCAPE",
    "NOTES", "SPECIFICATIONS", "CODE", "ADA", "FINISH", "FIXTURE", "EQUIPMENT", "RISER", "ISOMETRIC", "SCHEMATIC",
]
GARBAGE_PATTERNS = [
    r"^Part\s+\d+", r"^\d+$", r"^[A-Z]\d+(\.\d+)?$", r"^[A-Z]{1,2}-\d+$", r"Permit\s*Set", r"Gmp[/\s]",
    r"^(Project|Sheet)\s*(Number|No|#)", r"^(Date|Scale|Drawn|Checked|Approved)\b",
]
LEARN_MIN_LENGTH, LEARN_MIN_WORDS, LEARN_ONE_WORD, LEARN_REPETITION, LEARN_MIN_ROWS = 5, 2, 15, 0.20, 5
STANDARD_EXCLUSIONS = [
    r"PROJECT\s*(NUMBER|NO\.?|#)", r"SHEET\s*(NUMBER|NO\.?|#)", r"DATE\s*:?", r"SCALE\s*:?", r"DRAWN\s*BY",
    r"CHECKED\s*BY", r"APPROVED\s*BY", r"REVISION", r"REV\s*:?",
]

# -- fixed values: decisions and triggers --------------------------------------------

DECISION_THRESHOLD, CONFLICT_RATIO, CONFLICT_PENALTY, COMBO_PENALTY, SCORE_SCALE = 0.85, 0.50, 0.15, 0.10, 0.25
AMBIGUOUS_TITLES = [r"^plan$", r"^elevation$", r"^schedule$", r"^section$", r"^details?$", r"^(level|floor)\s*\d+$"]
TRIGGER_CONFIDENCE = 0.65

# -- fixed values: titles in text, indicators, project names ---------------------------

TITLE_KEYWORD_ORDER = [
    r"REFLECTED\s+CEILING\s+PLAN", r"DEMOLITION\s+FLOOR\s+PLAN", r"ENLARGED\s+FLOOR\s+PLAN", r"LIFE\s+SAFETY\s+PLAN", r"DEMOLITION\s+PLAN",
    r"(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|GROUND|BASEMENT|MAIN|UPPER|LOWER|MEZZANINE|PARTIAL)\s+FLOOR\s+PLAN", r"FLOOR\s+PLAN", r"MECHANICAL\s+PLAN",
    r"ELECTRICAL\s+PLAN", r"PLUMBING\s+PLAN", r"CEILING\s+PLAN", r"ROOF\s+PLAN", r"SITE\s+PLAN", r"FOUNDATION\s+PLAN",
    r"(?:NORTH|SOUTH|EAST|WEST|FRONT|REAR|SIDE|INTERIOR|EXTERIOR|BUILDING)\s+ELEVATIONS?", r"ELEVATIONS?", r"(?:BUILDING|WALL|TYPICAL|DETAIL)\s+SECTIONS?",
    r"SECTIONS?", r"(?:WALL|DOOR|WINDOW|STAIR|MILLWORK|CABINET|CEILING|FLOOR|ROOF)\s+DETAILS?", r"DETAILS?",
    r"(?:DOOR|WINDOW|ROOM|FINISH|HARDWARE|FIXTURE|EQUIPMENT)\s+SCHEDULES?", r"MECHANICAL\s+SCHEDULES?", r"SCHEDULES?", r"GENERAL\s+NOTES", r"SPECIFICATIONS?",
    r"COVER\s+SHEET", r"TITLE\s+SHEET",
]
TITLE_TEXT_LABELS = [r"SHEET\s*TITLE[:\s]+", r"DRAWING\s*TITLE[:\s]+", r"TITLE[:\s]+"]
TITLE_TERMINATORS = [
    r"(?:\n|\s{2,})PROJECT\s*(?:NO|#|NUMBER)?[:\s=]", r"(?:\n|\s{2,})SHEET\s*(?:NO|#|NUMBER)?[:\s=]", r"(?:\n|\s{2,})DWG\s*(?:NO|#|NUMBER)?[:\s=]",
    r"(?:\n|\s{2,})SCALE[:\s=]", r"(?:\n|\s{2,})DATE[:\s=]", r"(?:\n|\s{2,})(?:DRAWN|CHECKED|APPROVED|REVISED)[:\s]", r"(?:\n|\s{2,})(?:IL|ILLINOIS)\s+\d{5}",
    r"(?:\n|\s{2,})U\.?L\.?\s+(?:PARTITION|DESIGN)", r"(?:\n|\s{2,})(?:PHONE|FAX|TEL)[:\s]", r"\n{2,}", r"$",
]
TITLE_PART_LABELS = [
    r"^(?:PROJECT|SHEET|SCALE|DATE|DRAWN|CHECKED|APPROVED|REVISED)[:\s]*$", r"^(?:NO|#|NUMBER)[:\s]*$", r"^\d+[:\s]*$", r"^[A-Z]\d+\.\d+$", r"^(?:PHONE|FAX|TEL)",
    r"^U\.?L\.?\s+", r"^IL\s+DESIGN\s+FIRM", r"^#?\d{6,}", r"^\d+-\d+-\d+$", r"^(?:NORTH|SOUTH|EAST|WEST)$",
]
COVER_LABELS = ["SHEET NO", "SHEET:", "SHEET NUMBER", "SHEET #", "DWG NO", "DWG:", "DRAWING NO", "DRAWING:"]
COVER_WORDS = ["COVER SHEET", "COVERSHEET", "TITLE SHEET", "TITLE PAGE"]
#: (name, relevance, patterns)
PAINTING_INDICATORS = [
    ("room_numbers", "PRIMARY", [r"\b\d{3}\b", r"\bROOM\s*\d+\b", r"\bRM\s*\d+\b"]),
    ("finish_callouts", "PRIMARY", [r"\bPT[-\s]?\d+\b", r"\bFIN[-\s]?\d+\b", r"\bPAINT\s+TYPE\b"]),
    ("ceiling_grid", "PRIMARY", [r"\bACT\b", r"\bGWB\b", r"\bCEILING\b", r"\b2['x]4\b"]),
    ("wall_tags", "SECONDARY", [r"\bWALL\s+TYPE\b", r"\bWT[-\s]?\d+\b"]),
    ("elevation_markers", "SECONDARY", [r"\bINT\.?\s*ELEV\b", r"\bSEE\s+ELEV\b"]),
    ("door_tags", "SECONDARY", [r"\bD\d{2,3}\b", r"\bDOOR\s*\d+\b"]),
]
NON_PROJECT_PATTERNS = [
    r"^B\d+-\d+\s+Build-out", r"^\d+\s+sf\s+", r"^New Tenant Improvement$", r"^\d{4,}\s+\w+\s+(Road|Street|Ave|Blvd)", r"^(N|S|E|W)\d+\w*\d+\s+",
]

#: Drawing indexes: lines to skip, separators and the form of an entry, titles that are looked for in running text, repairs of numbers.
INDEX_PREAMBLE = ["THE FOLLOWING SHEETS", "COMPLETE SET", "CONSTRUCTION DOCUMENTS", "COVERSHEET", "COVER SHEET", "THIS SET", "THIS DOCUMENT", "ALL DRAWINGS"]
INDEX_SEPARATORS = ["\t", "    ", "   ", "  ", " - ", " – ", " — "]
INDEX_RAW_NUMBER = r"[A-Za-z]{1,2}[-.]?[0-9OoIlzZ\}\]\|]{1,3}(?:[-.]?[0-9OoIlzZ\}\]\|]{1,2})?"
INDEX_NUMBER = r"^[A-Z]{1,2}[-.]?\d{1,3}(?:[-.]\d{1,2})?$"
INDEX_TITLES = [
    r"CODE\s+REVIEW[,\s]+SCHEDULES?\s+AND\s+ADA\s+REQUIREMENTS?", r"REFLECTED\s+CEILING\s+PLAN", r"DEMOLITION\s+FLOOR\s+PLAN", r"ENLARGED\s+FLOOR\s+PLAN",
    r"LIFE\s+SAFETY\s+PLAN", r"FLOOR\s+PLAN", r"CEILING\s+PLAN", r"ROOF\s+PLAN", r"SITE\s+PLAN", r"FOUNDATION\s+PLAN",
    r"ELEVATION[S]?", r"SECTION[S]?", r"DETAIL[S]?", r"SCHEDULE[S]?", r"NOTES?", r"SPECIFICATIONS?", r"PLAN",
]
INDEX_PREFIX_FIXES = {"AZ": "A2.", "DZ": "D2.", "SZ": "S2.", "MZ": "M2."}
INDEX_CHAR_FIXES = {"O": "0", "I": "1", "|": "1", "Z": "2", "}": "1", "]": "1", "{": "1", "[": "1", "S": "5", "B": "8"}

#: Sheet numbers in text: their form, labels on the same line, cut labels, labels at a line's end, numbers of title sheets.
NUMBER_VALUE = r"([A-Z]{1,2}[-.]?\d{1,3}(?:\.\d{1,2})?)"
NUMBER_LABELS = [
    r"SHEET\s*NUMBER\s*[:\s]*", r"SHEET\s*NO\.?\s*[:\s]*", r"SHEET\s*#\s*[:\s]*", r"DWG\s*NO\.?\s*[:\s]*", r"DRAWING\s*NO\.?\s*[:\s]*", r"SHEET\s*[:\s]+",
    r"EET\s*NO\.?\s*[:\s]*", r"(?<![A-Z])NO\.?\s*[:\s]+",
]
NUMBER_LINE_ENDS = [r"(?:SHEET|DWG|DRAWING)\s*(?:NO\.?|NUMBER|#)?\s*:?\s*$", r"(?:EET|NO\.?)\s*:?\s*$"]
TITLE_SHEET_NUMBER = r"\b(T[-.]?\d{1,2}(?:\.\d{1,2})?)\b"

#: Words that stay lower within titles; labels that are no titles; a cover's title.
SMALL_WORDS = ["and", "or", "the", "a", "an", "of", "for", "to", "in", "on", "at", "by", "with"]
BARE_TITLE_LABELS = ["TITLE", "SHEET TITLE", "DRAWING TITLE"]
COVER_TITLE = "TITLE SHEET"

#: Numbers that only look like project numbers: years, and what stands around street, phone and postal numbers.
YEARS = ["2018", "2019", "2020", "2021", "2022", "2023", "2024", "2025", "2026", "2027", "2028", "2029", "2030"]
STREETS = [r"S\.?\s+WOLF", r"N\.?\s+\w+", r"ARMOU?R", r"LINCOLN", r"\s+(?:ROAD|RD|STREET|ST|AVENUE|AVE|BLVD|BOULEVARD|DRIVE|DR|WAY|LANE|LN|HIGHWAY|HWY)"]
STREET_ADDRESS = r"\s+[NSEW]?\.?\s*\w+\s+(ROAD|RD|STREET|ST|AVE|AVENUE|BLVD|DR|DRIVE|WAY|LN|LANE|HWY|HIGHWAY)"

#: Prefixes of sheet numbers that are kept when what follows is repaired, and signs of a number in text read from a page's edges.
NUMBER_PREFIXES = ["A", "M", "E", "S", "D", "T", "P", "C", "G", "L", "R", "AD", "ST", "AS", "EL", "RC", "FP", "SP", "MP", "EP"]
EDGE_SIGNS = [r"(SHEET|EET|NO\.?:?)\s*\n*\s*[A-Z]\d", r"\b[A-Z]\d+\.\d+\b"]

#: Calls of a model: a minute, seconds to wait after a refusal, and after a second one.
CALLS_A_MINUTE, CALL_BACKOFF = 10, (60, 120)
