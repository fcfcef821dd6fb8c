"""Fixed values the results depend on.

Codes, labels, thresholds and patterns are stated here as they must be for results
to be right.  Every job takes them as arguments with these as defaults.
"""

from __future__ import annotations

# --- fraud rule -------------------------------------------------------------
FRAUD_RESIGN_TYPE = "K"
FRAUD_EXCLUDED_CODES = (42, 112, 1025)
FRAUD_SECONDS = 604800  # 7 days
DISABLED_LOGINS = (1, 2)

# --- billing codes ----------------------------------------------------------
STATUS_SUCCESS = 1
STATUS_FAILED = 2
TYPE_RENEWAL = 2
NEW_SALE_TYPES = (1, 8, 12)  # new, delayed capture, gift
SALE_CATEGORIES = (1, 4)  # sale, gift transfer
CASH_CATEGORIES = (0, 1, 2, 4)  # everything but authorisations

# --- packages ---------------------------------------------------------------
PACKAGE_MONTHS = (3, 6, 12)
UPSELL_PRODUCTS = {3: 5158, 6: 5159, 12: 5160}
PACKAGE_DAY_EDGES = (30, 100, 200)
PACKAGE_DAY_MONTHS = (1, 3, 6, 12)

# --- onboarding limits ------------------------------------------------------
PROFILE_MINUTES = 90
PHOTO_MINUTES = 60

# --- score groups: upper edge (included) and label ---------------------------
SCORE_EDGES = ("0.4", "0.8", "1.5", "18")
SCORE_GROUPS = ("Group 05", "Group 04", "Group 03", "Group 02", "Group 01")

# --- cohorts inside a score group: digits of the 4th GUID place ---------------
SCORE_COHORTS = {
    "Group 01": {
        "01 - Control (25% lvl)": "0123",
        "02 - 5.0% Up (25% lvl)": "4567",
        "03 - 7.5% Up (25% lvl)": "89AB",
        "04 - 10.0% Up (25% lvl)": "CDEF",
    },
    "Group 02": {
        "05 - Control (50% lvl)": "01234567",
        "06 - 2.5% Up (25% lvl)": "89AB",
        "07 - 5.0% Up (25% lvl)": "CDEF",
    },
    "Group 03": {"08 - Control": "0123456789ABCDEF"},
    "Group 04": {
        "09 - Control (50% lvl)": "01234567",
        "10 - 25% Down (50% lvl)": "89ABCDEF",
    },
    "Group 05": {
        "11 - Control (50% lvl)": "01234567",
        "12 - 50% Down (50% lvl)": "89ABCDEF",
    },
}

# --- price points by the 7th GUID digit ---------------------------------------
PRICE_POINTS = {
    "$1.99 for 15 Mins": "01",
    "$1.99 for 30 Mins": "23",
    "$2.99 for 30 Mins": "45",
    "$2.99 for 60 Mins": "67",
    "$3.00 for 30 Mins": "89",
    "$3.00 for 60 Mins": "AB",
    "$3.99 for 60 Mins": "CD",
    "$4.99 for 60 Mins": "EF",
}

# --- labels -------------------------------------------------------------------
CONVERSATION_STATUS = {0: "Initiation", 1: "Displayed", 2: "Accepted", 3: "Marked Busy", 4: "Closed"}
SEEKING = {
    1: "Man seeking Men",
    2: "Man seeking Women",
    3: "Woman seeking Women",
    4: "Woman seeking Men",
}
SEGMENT_OF_SEEKING = {1: "Men", 2: "Men", 3: "Women", 4: "Women"}
CARD_RESPONSES = {"A": "New Card Number", "E": "Upd Expiration Date"}
CARD_COMPLETION = {
    0: "Update Successful",
    1: "Invalid New Card Length (16)",
    2: "Cannot Identify Record To Update",
    3: "Too Many Records To Update",
    4: "Nothing To Update - Already Processed",
}
CARD_EXCEPTION = "AcctPymtMethUV0 Exception"  # any negative completion code

# --- hosts ----------------------------------------------------------------------
SITE_PREFIX = "DA"
SITE_LABELS = ("ClearView", "DuPont")  # host starts with the prefix, or not
EXCLUDED_HOSTS = (
    *[f"%{n}" for n in range(141, 155)],
    *[f"%{n}" for n in range(211, 215)],
    "%500",
    "DA0%",
    "%MIWS%",
    "%NEW",
    "DA3%",
    "EC3%",
)
MOBILE_HOSTS = tuple(str(n) for n in range(141, 158))
THIRD_HOSTS = tuple(str(n) for n in range(211, 215))
EXCLUDED_OBJECTS = ("Repl%", "csa_%", "sp_%")

# --- message noise --------------------------------------------------------------
NOISE_PATTERNS = (
    "Message Deleted%",
    "Message Destroyed%",
    "Unable to translate bytes%",
    "No map for object%",
    "Page render threshold%",
    "The view 'Error' or its master was not found%",
    "A potentially dangerous Request.Cookies value was detected from the client%",
    "%is not a valid virtual path%",
)
NOISE_VALUES = ("Path 'OPTIONS' is forbidden",)
MESSAGE_PREFIX = (0, 200)  # start and length, so 199 characters
PAGE_TEXT = (45, 300)
SEVERITY_PREFIXES = {
    "Page render threshold (00:00:03)": "3 sec",
    "Page render threshold (00:00:05)": "5 sec",
}

# --- alert thresholds -------------------------------------------------------------
SLOW_MS = 5000
VERY_SLOW_SHARE = 0.75  # database share of the page time
TRACE_SECONDS = 300

# Classes of data sources by their alias; the first rule that fits counts, `%` stands
# for any letters, case doesn't matter, and other aliases are classes of their own.
SOURCE_CLASSES = (
    ("%mass%", "Session"),
    ("MASESS", "Session"),
    ("DAL16", "Read"),
    ("%masr%", "Read"),
    ("DAL17\\MAWRITE01", "Write"),
    ("MAREG", "Reg"),
    ("MAREGWRITE", "Reg"),
    ("%masa85%", "Reg"),
    ("MAOSDB\\MAOSDB01", "OSDB"),
    ("MASchEng", "Search Engine"),
    ("MasCache", "Cache"),
    ("MAPHOTO", "Photo"),
    ("%masp%", "Photo"),
    ("CHINT", "Chem Int"),
)

# Fixed value: hosts by name that slow-page jobs leave out beside EXCLUDED_HOSTS.
EXCLUDED_HOST_NAMES = ("DA1MAWS057",)
