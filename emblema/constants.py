"""Fixed values. Results depend on them, so they are stated as they are and nowhere else."""

# --- domains of the register ------------------------------------------------------------------
STATUSES = ("application", "published", "registered", "opposed", "refused", "withdrawn", "expired", "surrendered")
MARK_TYPES = ("word", "figurative", "combination", "shape", "sound", "pattern", "color")
NICE_MIN, NICE_MAX = 1, 45

# --- status wording on a page -> status; the first entry contained in the wording wins --------------
STATUS_WORDING = (
    ("registered", "registered"),
    ("application", "application"),
    ("published", "published"),
    ("opposed", "opposed"),
    ("refused", "refused"),
    ("withdrawn", "withdrawn"),
    ("expired", "expired"),
    ("surrendered", "surrendered"),
    ("registration", "registered"),
    ("filed", "application"),
)

# --- labelled fields of a detail page: label alternatives and the form of the value -----------------
DETAIL_FIELDS = {
    "mark_name": r"(?:Mark name|Trade mark|Mark):[^\S\n]*(\S.*)",
    "application_number": r"(?:Application number|App\.?\s*No\.?):[^\S\n]*(\d+)",
    "registration_number": r"(?:Registration number|Reg\.?\s*No\.?):[^\S\n]*(\d+)",
    "filing_date": r"Filing date:[^\S\n]*(\d{2}/\d{2}/\d{4})",
    "registration_date": r"Registration date:[^\S\n]*(\d{2}/\d{2}/\d{4})",
    "nice_classes": r"Nice classes?:?[^\S\n]*(\S.*)",
    "applicant_name": r"(?:Applicant|Holder|Proprietor):[^\S\n]*(\S.*)",
    "applicant_country": r"(?:Country|Origin):[^\S\n]*([A-Z]{2})",
    "status": r"Status:[^\S\n]*(\S.*)",
    "goods_services": r"(?:Goods|Services|List of goods):[^\S\n]*(\S.*)",
}

# --- labelled fields of an office-action letter ----------------------------------------------------
LETTER_FIELDS = {
    "application_number": r"Application Number:[^\S\n]*(\d+)",
    "mark_name": r"Trade Mark:[^\S\n]*(\S.*)",
    "applicant_name": r"Applicant:[^\S\n]*(\S.*)",
    "filing_date": r"Filing Date:[^\S\n]*(\d{2}/\d{2}/\d{4})",
    "response_deadline": r"Deadline for Response:[^\S\n]*(\d{2}/\d{2}/\d{4})",
}

# --- references in legal text ----------------------------------------------------------------------
# one reference, such as 5, 94(1) or 7 (1) (b); a word before it, and after the plural more of them
REFERENCE = r"\d+(?:\s*\(\d+\))?(?:\s*\([a-z]\))?"
CITING_PATTERN = (
    rf"\bArticles\s*{REFERENCE}(?:\s*(?:,\s*and|,\s*or|,|and|or|&)\s*{REFERENCE})*|\b(?:Article|Art\.?)\s*{REFERENCE}"
)
OBJECTION_PATTERN = r"^[78]\(\d+\)"
GUIDELINE_PATTERN = r"(Part\s+[A-Z],\s*Section\s+\d+)"
DECISION_PATTERN = r"\b(R\s\d{1,4}/\d{4}-\d)\b"
HEADING_STARTS = ("Article", "Art.", "Section")
HEADING_MAX_CHARS = 100

# --- bulletin pages ----------------------------------------------------------------------------------
# item selectors in order of preference: (tag or "", class or "", attribute or "", attribute value)
ITEM_SELECTORS = (
    ("", "bulletin-item", "", ""),
    ("", "search-result-item", "", ""),
    ("", "result-item", "", ""),
    ("", "", "data-testid", "bulletin-item"),
    ("li", "bulletin-entry", "", ""),
    ("tr", "bulletin-row", "", ""),
)
# date selectors in order of preference, same form
DATE_SELECTORS = (
    ("", "date", "", ""),
    ("", "published-date", "", ""),
    ("", "bulletin-date", "", ""),
    ("time", "", "", ""),
    ("", "", "data-date", None),
)
DATE_TEXT_MAX_CHARS = 30
TITLE_NUMBER_PATTERN = r"(?:Application\s*No\.?|App\.?\s*No\.?)\s*:?\s*(\d{6,12})"
BARE_NUMBER_PATTERN = r"(\d{6,12})\s+([^\d]+)"
URL_NUMBER_PATTERN = r"/trademarks/(\d{6,12})"
UNKNOWN_MARK = "Unknown Mark"
BULLETIN_SOURCE = "euipo_bulletin"
LINKS_PER_PAGE = 20
ITEMS_SHOWN = 20

# --- sound of a name: replacements applied in this order -----------------------------------------------
TRANSLITERATION = (
    ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"),
    ("é", "e"), ("è", "e"), ("ê", "e"), ("ë", "e"),
    ("à", "a"), ("â", "a"), ("ç", "c"), ("ñ", "n"),
)

# --- risk ------------------------------------------------------------------------------------------------
PAIR_BANDS = (0.80, 0.65)
DEMO_BANDS = (0.85, 0.6)
DESCRIPTIVE_TERMS = ("solar", "eco", "green", "smart", "digital", "cloud", "fast")
SHORT_MARK_CHARS = 3
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
NOT_SEARCHED = "NOT SEARCHED"

# --- search defaults ---------------------------------------------------------------------------------------
SEARCH_LIMIT = 20
CLEARANCE_TOP = 10
INDEX_FROM_ROWS = 10_000
MAX_CELLS = 256
ROWS_PER_CELL = 100

# --- published constants of ranking formulas -----------------------------------------------------------------
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60

# --- encoder -----------------------------------------------------------------------------------------------
QUERY_PREFIX, PASSAGE_PREFIX = "query", "passage"

# --- grounds for refusal, worded after the public regulation text (EU) 2017/1001 -------------------------------
OBJECTIONS = (
    ("7(1)(a)", "Sign does not conform to Article 4"),
    ("7(1)(b)", "Devoid of distinctive character"),
    ("7(1)(c)", "Descriptive sign"),
    ("7(1)(d)", "Customary in the trade"),
    ("7(1)(e)", "Shape or characteristic given by nature, function or value"),
    ("7(1)(f)", "Contrary to public policy or morality"),
    ("7(1)(g)", "Deceptive sign"),
    ("7(1)(h)", "Protected state emblem"),
    ("7(1)(i)", "Badge or emblem of public interest"),
    ("7(1)(j)", "Designation of origin or geographical indication"),
    ("7(1)(k)", "Traditional term for wine"),
    ("7(1)(l)", "Traditional speciality guaranteed"),
    ("7(1)(m)", "Plant variety denomination"),
    ("7(2)", "Ground present in only part of the Union"),
    ("7(3)", "Acquired distinctiveness"),
    ("8(1)(a)", "Identical mark for identical goods or services"),
    ("8(1)(b)", "Likelihood of confusion"),
    ("8(3)", "Filing by an agent without consent"),
    ("8(4)", "Earlier sign used in the course of trade"),
    ("8(5)", "Earlier mark with a reputation"),
    ("8(6)", "Earlier designation of origin or geographical indication"),
)
