"""Patterns, word lists and constants that decide the results."""

# --- Fixed values: text -------------------------------------------------------------
# White space as a general-purpose scripting language strips and splits it.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
SPACE_CHARACTERS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NOT_TOKEN = "[^a-z0-9]+"
CITATION = r"\[Doc: (.*?), Clause: (.*?)\]"

# --- Fixed values: chunking ---------------------------------------------------------
MAX_CLAUSE_WORDS = 50
OVERLAP_WORDS = 3
HEADING_LEVELS = 5
CLAUSE_REF_LIMIT = 100

# --- Fixed values: retrieval --------------------------------------------------------
TOP_K_RETRIEVAL = 20
TOP_K_FINAL = 3
RRF_K = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# --- Fixed values: entity patterns --------------------------------------------------
THRESHOLD = r"((?:NGN|USD|EUR|GBP|₦|\$|€|£)\s*[\d,]+(?:\.\d{2})?)"
APPROVAL = r"((?:Manager|Director|CFO|CEO|VP|Head of|Lead)\s+(?:approval|authorization|consent))"
DEADLINE = r"(?:every|within|after|before)\s+(\d+)\s+(?:days|weeks|months|hours|minutes)"
REQUIREMENT = r"(?:must|required|mandatory|shall)\s+(\w+(?:\s+\w+)?)"
REQUIREMENTS_PER_DOCUMENT = 5

# --- Fixed values: intents, in order of precedence ----------------------------------
INTENTS = [
    ("approval", 0.9, [
        "who can approve", "approval authority", "who approves", "needs approval",
        "requires approval", "approval required", "who authorizes", "authorization",
        "can approve", "who signs off", "sign-off", "approval matrix", "approval chain",
        "approval limit",
    ]),
    ("conflict", 0.85, [
        "conflict", "contradict", "inconsisten", "versus", "vs", "differs from",
        "contrary to", "overrides", "supersedes", "version change", "updated version",
        "old version", "new version",
    ]),
    ("compliance", 0.85, [
        "compliance", "violation", "breach", "regulation", "regulatory", "gdpr", "ndpa",
        "iso 27001", "nist", "hipaa", "sox", "are we compliant", "compliant with",
        "non-compliant", "legal", "law", "standard", "requirement", "mandatory",
        "must we", "do we need",
    ]),
    ("procedure", 0.8, [
        "how to", "how do i", "what is the process", "procedure", "steps", "workflow",
        "what should", "how often", "when should", "what happens if", "what do i do",
        "process for", "steps to",
    ]),
]
OTHER_INTENT = ("general", 0.6)

# --- Fixed values: process named by a question word, first hit wins -----------------
PROCESS_WORDS = [
    ("purchase", "Purchase"), ("procurement", "Procurement"), ("leave", "Leave"),
    ("vacation", "Leave"), ("travel", "Travel"), ("travel approval", "Travel"),
    ("expense", "Expense"), ("reimbursement", "Reimbursement"), ("access", "Access Grant"),
    ("permission", "Access Grant"), ("hire", "Hiring"), ("recruit", "Hiring"),
    ("onboard", "Onboarding"), ("offboard", "Offboarding"), ("contract", "Contract"),
    ("vendor", "Vendor"), ("incident", "Incident Response"), ("change", "Change Management"),
    ("deployment", "Deployment"), ("release", "Release"), ("data", "Data Handling"),
    ("security", "Security"),
]
FALLBACK_PROCESS = "Approval"
DEFAULT_PROCESS = "General Compliance"

# --- Fixed values: amount patterns of a question, tried in order ---------------------
AMOUNTS = [
    r"\$\s*([\d,]+(?:\.\d{2})?)",
    r"([\d,]+(?:\.\d{2})?)\s*(?:dollars|usd)",
    r"amount\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d{2})?)",
    r"(?:over|above|exceed|more than)\s+\$?\s*([\d,]+(?:\.\d{2})?)",
]

# --- Fixed values: confidence weights ------------------------------------------------
WEIGHT_SCORE, WEIGHT_COVERAGE, WEIGHT_CHUNKS = 0.40, 0.35, 0.25
ABSTAIN_WORD = "Insufficient"

# --- Fixed values: sentences of a risk assessment -------------------------------------
REVIEW_VIOLATION = "Review the identified violation against applicable regulations"
VERIFY_CONDITIONS = "Verify all conditions are met before proceeding"
NO_CONCERNS = "No immediate compliance concerns detected"
ENSURE_COMPLIANCE = "Ensure compliance with: "
CHECK_APPROVALS = "Check approval requirements in the knowledge graph"
OBLIGATIONS_APPLY = " mandatory obligation(s) apply to retrieved clauses"
NO_CLAUSES = "No relevant policy clauses found"
