"""Word lists and patterns."""

# fixed values: words that carry no meaning when texts are matched
STOPWORDS = (
    "the and for with you our are will who your this that have from was were has had not but all any can job role team work working "
    "years year experience including such into per via using use used able well new high across within their them they its a an to of in on at as is be or we us by"
).split()
TOKEN = r"[a-z0-9][a-z0-9+#.\-]{1,}"
BETWEEN_TOKENS = r"[^a-z0-9+#.\-]+[+#.\-]*"
TOKEN_CHARS = r"a-z0-9+#.\-"
MIN_TOKEN = 3

# fixed values: verbs that start statements of outcomes and of work
OUTCOME_VERBS = "reduced cut increased improved decreased lowered grew boosted saved accelerated shortened eliminated doubled halved".split()
WORK_VERBS = (
    "built build fixed fix implemented implement added add created create engineered engineer migrated migrate refactored refactor designed design wrote write "
    "developed develop integrated integrate parallelized parallelize automated automate diagnosed diagnose resolved resolve owned architected spearheaded "
    "reconstructed reverse-engineered mapped deployed deploy instrumented rewrote rebuilt rebuild backfilled reworked replaced introduced extracted structured"
).split()
QUALITATIVE = ["no longer", "eliminated", "without manual", "unblocked"]

# fixed value: a number that measures something
METRIC = (
    r"(\bfrom\s+\S+(?:\s+\S+){0,4}?\s+to\s+\S+)|(\d+(?:\.\d+)?\s*%)|(\$[\d,.]+\s*[kKmMbB]?)|(\bby\s+~?\d)|(\b\d[\d,.]*[kKmMbB]\+?)"
    r"|(\b(?:two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|dozen)\b)"
)
# fixed values: kinds of results, the first that fits counts
RESULT_TYPES = [
    ("coverage", r"\b(?:restor\w*|recover\w*|regain\w*)\b"),
    ("reliability", r"\b(?:prevented|stabiliz\w+|hardened)\b"),
    ("automation", r"\b(?:automat\w+|eliminat\w+)\b.*\bmanual"),
    ("operational", r"\benabl\w+\b.*\b(?:daily|hourly|nightly|scheduled|refresh\w*)\b"),
    ("delivery", r"\b(?:delivered|shipped|launched|released)\b.*\b(?:dataset\w*|production|pipeline\w*|report\w*|model\w*)\b"),
    ("analytics", r"\benabl\w+\b.*\b(?:analytics|ai|ml|dashboard\w*|insight\w*|reporting)\b"),
    ("decision_enabling", r"\benabl\w+\b.*\b(?:validated|auditable|decision\w*|adjustment\w*)\b"),
    ("quantitative", r"\b(?:removed|corrected|reduced|cut|increased|decreased|lowered|saved|raised)\b"),
]
# fixed values: one of these pieces stands in every text that any of the patterns fits
RESULT_PIECES = "restor recover regain prevented stabiliz hardened manual enabl delivered shipped launched released removed corrected reduced cut increased decreased lowered saved raised".split()

# fixed values: tools that statements name
TOOLS = [
    "Python", "Pandas", "NumPy", "SQL", "Bash", "React", "TypeScript", "JavaScript", "Git", "GitHub Actions", "Kafka", "Docker", "Kubernetes", "Terraform", "AWS", "Lambda", "S3",
    "DynamoDB", "Oracle", "Postgres", "PostgreSQL", "MySQL", "Redis", "Airflow", "dbt", "Spark", "Snowflake", "Databricks", "FastAPI", "Django", "Flask", "aiohttp", "REST", "GraphQL",
    "Excel", "Go", "Rust", "Java", "Jenkins", "Grafana", "Prometheus",
]

# fixed values: words that point to what a problem costs, and to why something is inefficient
COSTS = [
    ("money", ["$", "cost", "budget", "spend", "expensive", "saving"]),
    ("time", ["hour", "hrs", "minute", "week", "day", "time", "latency"]),
    ("risk", ["risk", "outage", "incident", "breach", "compliance", "downtime"]),
    ("quality", ["failure", "error", "defect", "duplicate", "inaccura", "unreliab", "hallucinat", "bug"]),
    ("revenue", ["revenue", "sales", "churn", "conversion"]),
]
INEFFICIENCIES = [
    ("manual", ["manual", "by hand", "spreadsheet", "excel workflow"]),
    ("slow", ["slow", "bottleneck", "took", "taking"]),
    ("not_working", ["broken", "failing", "not working", "crash", "does not work"]),
    ("integration_difficulty", ["integration", "incompatib", "siloed", "undocumented"]),
    ("not_user_friendly", ["confusing", "unusable", "hard to use", "unintuitive"]),
]

# fixed values: numbers as digits and as words
DIGITS = r"\$?\d[\d,]*(?:\.\d+)?(?:[KkMmBb](?![a-zA-Z]))?%?"
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve dozen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "half halved twice double doubled triple tripled"
).split()

# fixed values: shapes of contact lines, links, files and job headers
ARTIFACTS = [
    r"\S+@\S+\.\w+",
    r"\b\d{3}[-.\s]\d{3}[-.\s]?\d{4}\b",
    r"(?i)\b(?:https?://|www\.|linkedin\.com/|github\.com/)",
    r"(?i)\.(?:pdf|docx?)\b",
    r"(?i)\b(?:19|20)\d{2}\s*[–—-]\s*(?:(?:19|20)\d{2}|present)\b",
]
MID_CLAUSE = "and or with to of for by in on the a an".split()
ABSENCE_CODES = ["problem_missing", "problem_not_pain_point"]
STRUCTURAL_CODES = ["problem_not_specific", "action_fragment"]

# fixed values: phrases of invitations and of refusals, and places of titles
INVITES = ["interview", "phone screen", "schedule a call", "meet the team", "next round"]
REFUSALS = ["other candidates", "not to move forward", "unfortunately"]
TITLES = [r"(?i)for the ([^.\n]+?) role", r"(?i)application for ([^.\n]+?) at "]

# fixed values: query parameters that only track
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "src", "source"]
TRACKING_PREFIX = "utm_"
READ_FAILED = r"^\[(?:Could not|Unable to|No text)\b[^\[\]]*\]$"

# fixed values: legal steps of each kind of record
TRANSITIONS = {
    "claim": [("extracted", "pending_review"), ("pending_review", "approved"), ("pending_review", "rejected")],
    "experience": [("proposed", "confirmed"), ("proposed", "discarded"), ("confirmed", "discarded")],
    "application": [("drafted", "applied"), ("drafted", "ignored"), ("applied", "interviewing"), ("applied", "rejected"), ("applied", "offer"), ("interviewing", "rejected"), ("interviewing", "offer")],
    "outreach": [("drafted", "approved"), ("drafted", "discarded"), ("approved", "sent")],
    "interview": [("detected", "confirmed"), ("detected", "cancelled"), ("confirmed", "scheduled"), ("confirmed", "cancelled"), ("scheduled", "completed"), ("scheduled", "cancelled")],
    "story": [("draft", "pending_review"), ("pending_review", "approved"), ("pending_review", "excluded")],
}
NOTE_REQUIRED = [("claim", "rejected"), ("story", "excluded")]
