"""Word lists, years, thresholds and sizes that decide results."""

# Industries that count as IT (whole words, any case).
IT_WORDS = ("IT", "SOFTWARE", "TECHNOLOGY", "INTELLIGENCE", "RESEARCH")

# Seniority words removed from job titles, in matching order.
LEVEL_WORDS = ("junior", "jr", "mid", "middle", "mid-level", "senior", "sr", "lead", "principal", "staff")

# Topics containing one of these are too general to link to.
STOP_KEYWORDS = (
    "computer_science", "internet", "computer", "software", "engineering",
    "engineers", "information", "technology", "teaching", "system",
)

# Years of posts that are kept, and years of the trend question.
POST_YEARS = (2012, 2022, 2023, 2024, 2025)
TREND_YEARS = (2012, 2023, 2024, 2025)

# Post type of an answer; answers are left out.
ANSWER_POST_TYPE = 2

# Cosine thresholds and links kept per entity.
ROLE_THRESHOLD = 0.4
POST_THRESHOLD = 0.35
LINKS_PER_ENTITY = 3

# Root and depth of the topic scope, vector width, topics per paper, and
# neighbours kept by node similarity.
ROOT_TOPIC = "computer_science"
SCOPE_DEPTH = 3
EMBEDDING_DIM = 384
TOPICS_PER_PAPER = 5
SIMILARITY_TOP_K = 10

# Patterns of the source formats.
TOPIC_URI_PATTERN = r'/topics/([^>"]+)'
AUTHOR_PATTERN = r"^([^,]+)"
AFFILIATION_PATTERN = r"^[^,]+,\s*(.*)"
URL_PATTERN = r"https?://\S+"
STRANGE_CHARS_PATTERN = r"""[{}\[\]<>"'*_`]"""

# Ontology predicates, told apart by a part of their address; the first hit wins.
PREDICATE_KINDS = ("superTopicOf", "relatedEquivalent", "preferentialEquivalent")

# Graph labels with their key, relationship types with their ends.
NODE_KEYS = {
    "Paper": "eid",
    "Author": "author",
    "Affiliation": "affiliation",
    "Job": "job_id",
    "JobRole": "name",
    "Company": "company_id",
    "StackOverflowPost": "id",
    "Topic": "name",
}
EDGE_ENDS = {
    "AUTHORED": ("Author", "Paper"),
    "AFFILIATED_WITH": ("Author", "Affiliation"),
    "HAS_ROLE": ("Job", "JobRole"),
    "POST": ("Company", "Job"),
    "ADDRESSES_TOPIC": ("Paper", "Topic"),
    "REQUIRES_KNOWLEDGE_OF": ("JobRole", "Topic"),
    "IS_TAGGED_WITH": ("StackOverflowPost", "Topic"),
    "SUBTOPIC_OF": ("Topic", "Topic"),
}

# The three domains of the usage questions and the edge that ties each to topics.
DOMAIN_EDGES = {
    "Paper": "ADDRESSES_TOPIC",
    "JobRole": "REQUIRES_KNOWLEDGE_OF",
    "StackOverflowPost": "IS_TAGGED_WITH",
}

# Labels and types of the full graph. "Job" is added to the label list so
# that POST and HAS_ROLE have both ends; HUB_LABELS_WITHOUT_JOB is the list without it.
HUB_LABELS_WITHOUT_JOB = ("Topic", "Paper", "JobRole", "StackOverflowPost", "Author", "Company")
HUB_LABELS = HUB_LABELS_WITHOUT_JOB + ("Job",)
HUB_TYPES = ("ADDRESSES_TOPIC", "REQUIRES_KNOWLEDGE_OF", "IS_TAGGED_WITH", "AUTHORED", "POST", "HAS_ROLE")
