"""Word lists, patterns and limits that decide results.

They are data, not logic: results only agree with other implementations of the same rules when
these values are equal, so they are spelled out here in one place.
"""

# Canonical fields of a unified record, in output order.
UNIFIED_FIELDS = ("company", "contactName", "email", "phone", "state")

# Source tags in load order, and their authority (1 = wins ties).
SOURCES = ("A", "B", "C")
SOURCE_PRIORITY = {"B": 1, "A": 2, "C": 3}

# Raw column of each source -> canonical field.
DEFAULT_MAPPINGS = {
    "A": {
        "Company Name": "company",
        "contact": "contactName",
        "Phone": "phone",
        "State": "state",
        "Email": "email",
    },
    "B": {
        "organization": "company",
        "contactPerson": "contactName",
        "primaryEmail": "email",
        "tel": "phone",
        "hqState": "state",
    },
    "C": {
        "Company": "company",
        "Rep": "contactName",
        "Telephone": "phone",
        "Location": "state",
        "Contact Email": "email",
    },
}

# USPS code -> accepted spellings besides the code itself.
STATE_SPELLINGS = {
    "AL": ["alabama"],
    "AK": ["alaska"],
    "AZ": ["arizona", "ariz"],
    "AR": ["arkansas"],
    "CA": ["california", "calif", "cal"],
    "CO": ["colorado", "colo"],
    "CT": ["connecticut", "conn"],
    "DE": ["delaware"],
    "FL": ["florida", "fla"],
    "GA": ["georgia"],
    "HI": ["hawaii"],
    "ID": ["idaho"],
    "IL": ["illinois", "ill"],
    "IN": ["indiana"],
    "IA": ["iowa"],
    "KS": ["kansas"],
    "KY": ["kentucky"],
    "LA": ["louisiana"],
    "ME": ["maine"],
    "MD": ["maryland"],
    "MA": ["massachusetts", "mass"],
    "MI": ["michigan", "mich"],
    "MN": ["minnesota", "minn"],
    "MS": ["mississippi"],
    "MO": ["missouri"],
    "MT": ["montana"],
    "NE": ["nebraska", "neb"],
    "NV": ["nevada"],
    "NH": ["new hampshire"],
    "NJ": ["new jersey"],
    "NM": ["new mexico"],
    "NY": ["new york"],
    "NC": ["north carolina"],
    "ND": ["north dakota"],
    "OH": ["ohio"],
    "OK": ["oklahoma", "okla"],
    "OR": ["oregon", "ore"],
    "PA": ["pennsylvania", "penn"],
    "RI": ["rhode island"],
    "SC": ["south carolina"],
    "SD": ["south dakota"],
    "TN": ["tennessee", "tenn"],
    "TX": ["texas", "tex"],
    "UT": ["utah"],
    "VT": ["vermont"],
    "VA": ["virginia"],
    "WA": ["washington", "wash"],
    "WV": ["west virginia"],
    "WI": ["wisconsin", "wis"],
    "WY": ["wyoming"],
    "DC": ["district of columbia"],
}

# Legal and generic words that do not identify a company.
COMPANY_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company",
    "group", "systems", "labs", "laboratories", "partners", "holdings", "plc", "llp",
)

# Fixed value: block key of a record with neither a company nor an email domain.
UNBLOCKED = "__unblocked__"

# The markup of a table (first table, rows, cells, tags) and the character
# references decoded in cell text, in decoding order.
TABLE_PATTERN = r"(?is)<table[^>]*>(.*?)</table>"
ROW_PATTERN = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL_PATTERN = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
TAG_PATTERN = r"<[^>]*>"
CHARACTER_REFERENCES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))

# What a query spec may mention, and its limits.
QUERY_COLUMNS = ("company", "contactName", "email", "phone", "state", "confidence")
QUERY_OPERATORS = ("=", "!=", "LIKE", ">", "<", ">=", "<=")
DEFAULT_LIMIT = 100
MAX_LIMIT = 500

# Blocks per batch, sample rows per source.
BLOCKS_PER_BATCH = 8
SAMPLE_ROWS = 3

# Shapes of well-formed values, used for linking, completeness and profiling.
EMAIL_SHAPE = r"^[^@ ]+@[^@ ]+\.[^@ ]+$"
PHONE_SHAPE = r"^\+1[0-9]{10}$"

# Words that hint at a canonical field in a raw column name.
NAME_TOKENS = {
    "company": ("company", "organization", "organisation", "org", "account"),
    "contactName": ("contact", "person", "rep", "representative"),
    "email": ("email", "mail"),
    "phone": ("phone", "tel", "telephone", "mobile"),
    "state": ("state", "location", "region"),
}

# Type and description of each field in the proposed schema.
FIELD_NOTES = {
    "company": ("string", "Company as its records spell it most fully"),
    "contactName": ("string", "Whom to ask for, first and last name"),
    "email": ("string", "Mailbox of the contact, lower case"),
    "phone": ("string", "Number to dial, +1 and ten digits"),
    "state": ("string", "Two capital letters of the home state"),
}


def state_codes() -> dict[str, str]:
    """Every accepted lower-case spelling -> USPS code."""
    return {
        spelling: code
        for code, names in STATE_SPELLINGS.items()
        for spelling in (code.lower(), *names)
    }
