"""Fixed values of the observation protocol.

Every constant here must equal the coding scheme of the field logs for results
to be right: behaviour labels, marker patterns, size words, emitted labels and
output headings.  Patterns are unanchored, case-sensitive regular expressions
unless they start with ``^``; the dots in the scan-marker pattern are wildcards.
"""

# --- fixed values: session and identity -------------------------------------
SESSION_START = "Start focal"
PLACES = ("Burrow", "Forage")
CLOCK_PREFIX = "1899-12-31 "
DATE_SUFFIX = " 12:00:00 AM"
SECONDS_PER_DAY = 86400

# --- fixed values: digs and scan markers ------------------------------------
SCAN_MARKER = "Nearest neigh.|Other vig."
DIG = "Dig"
DIG_END = "Dig; End"
REDIG_END = "Re-Dig; End"
LOOSE_MARKER = "End (+Modifiers)"
REMOVABLE_DIG_ENDS = ("Dig; End (+Modifiers)", "Re-Dig; End (+Modifiers)")
ACCEPTED_DIG_ENDS = (
    "Dig; End (+Modifiers)",
    "Re-Dig; End (+Modifiers)",
    "Other vig.; Dig; End (+Modifiers)",
    "Other vig.; Re-Dig; End (+Modifiers)",
)
DEFAULT_OUTCOME = "success"
DIG_STOPS = "End|Dig"

# --- fixed values: sizes -----------------------------------------------------
ANY_SIZE = "Tiny|Small|Medium|Large"
LARGER_SIZES = "Small|Medium|Large"
TINY_FEW = "1; Tiny|2; Tiny|Tiny; <5"
TINY_MANY = "Tiny; >5"
# A size's name in a cell, the label ending it gives, and its name when a list is split.
NAMED_SIZES = {"Small": "small", "Medium": "medium", "Large": "large"}
TINY, TINY_ENDING = "Tiny", "tiny"
FEW_NAME, FEW_ENDING = "TinyFew", "tiny.few"
MANY_NAME, MANY_ENDING = "TinyMany", "tiny.many"
DIG_PREFIX = "d."
FOUND_PREFIX = "fa."

# --- fixed values: tags ------------------------------------------------------
CATEGORIES = ("Aggr./Sub.", "Play", "Olfactory")
COMPETITION = "Fcomp"
OUTCOMES = ("Lose", "Win", "Unclear winner")
DIRECTION_MAP = {"Initiate;": "Initiate", "Receive;": "Receive"}
DIRECTED = "Initiate; |Receive; "
INITIATED = "Initiate"
LEADING_RECEIVE = "^Receive; "
LIST_MARK, SPREAD_MARK = ";", "; Receive"
WRESTLE_MAP = {
    "Wrestle; Bottom": "Wrestle Bottom",
    "Wrestle; Top": "Wrestle Top",
}
APPROACH = "^Approach|^Receive approach"

# --- fixed values: partner mirroring ----------------------------------------
RECEIVED = "Receive|Recieve"
RECEIVED_ITEM = "Receive;|Recieve;"
MUTUAL = ("Reciprocate", "Initiate")
MIRRORED = "Receive"
# As written, the second character of the prefix may be any.
OWN_PREFIX, OTHER_PREFIX = "i.", "r."

# --- fixed values: output headings, in report order --------------------------
REPORT_HEADINGS = {
    "focal_id": "Focal.ID",
    "location": "Location",
    "date_text": "Date",
    "st_time": "St.Time",
    "end_time": "End.Time",
    "duration": "Duration",
    "s_duration": "S.Duration",
    "observer": "Observer",
    "groups": "Groups",
    "kmp_id": "KMP.ID",
    "focal_individual": "Focal individual",
    "behavior": "Behavior",
    "partner": "Partner(s)",
    "agg_sub": "Aggression/Submission",
    "olfactory": "Olfactory",
    "play": "Play",
    "pup_care": "Pup care",
    "sex": "Sex",
    "modifiers": "Modifiers",
    "life_history": "Life History",
    "time_2": "Time",
    "time_spent_running": "Time spent running",
    "comments": "Comments",
    "check": "CHECK",
}
