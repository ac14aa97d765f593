"""Spellings, limits and word lists that results depend on."""

# ---- Fixed values: job types -------------------------------------------------------------------
JOB_TYPES = ("full_time", "part_time", "contract", "internship", "freelance")

JOB_TYPE_OF_SPELLING = {
    "full_time": "full_time",
    "full-time": "full_time",
    "fulltime": "full_time",
    "permanent": "full_time",
    "full time": "full_time",
    "part_time": "part_time",
    "part-time": "part_time",
    "parttime": "part_time",
    "part time": "part_time",
    "contract": "contract",
    "contractor": "contract",
    "contract-to-hire": "contract",
    "contract to hire": "contract",
    "intern": "internship",
    "internship": "internship",
    "freelance": "freelance",
    "freelancer": "freelance",
}

# ---- Fixed values: salaries ----------------------------------------------------------------------
ANNUAL_FACTOR_OF_PERIOD = {
    "hourly": 2080,
    "hour": 2080,
    "monthly": 12,
    "month": 12,
    "weekly": 52,
    "week": 52,
    "yearly": 1,
    "year": 1,
    "annual": 1,
    "annually": 1,
}
# Checked in this order; the first that occurs in the text decides.
SALARY_TEXT_PERIODS = (
    (2080, r"(?i)per\s*hour|/\s*hour|/\s*hr(?![A-Za-z0-9_])|hourly"),
    (12, r"(?i)per\s*month|/\s*month|monthly"),
    (52, r"(?i)per\s*week|/\s*week|weekly"),
)
SALARY_NUMBER = r"(?i)\$?([\d,]+\.?\d*k?)"
MIN_ANNUAL_SALARY = 1_000
MAX_ANNUAL_SALARY = 2_147_483_647

# ---- Fixed values: keywords that are not tool names ------------------------------------------------
KEYWORD_STOPWORDS = (
    "ai", "ml", "api", "qa", "ux", "ui", "cloud", "crm", "erp", "cms", "seo", "ads", "agents",
    "analytics", "coverage", "ancestry", "prompting", "remote", "saas", "paas", "iaas",
)

# ---- Fixed values: HTML entities, decoded in this order --------------------------------------------
HTML_ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
)

# ---- Fixed values: white space as the web platform defines it --------------------------------------
WHITESPACE = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

# ---- Fixed values: chunking ----------------------------------------------------------------------
WINDOW_CHARS = 800
WINDOW_OVERLAP = 200

# ---- Fixed values: retrieval ---------------------------------------------------------------------
EMBEDDING_DIM = 768
EMBEDDING_VERSION = 1
EMBEDDING_CACHE_DAYS = 7
RETRIEVAL_CHUNKS = 15
RETRIEVAL_JOBS = 5
SIMILARITY_THRESHOLD = 0.5
JOB_CONTEXT_CHARS = 2_400

# Question word prefixes that ask for a posting field, in output order.
FIELD_PREFIXES = (
    ("salary", r"salary|pay|compensation|wage|earning"),
    ("benefits", r"benefit|perk|pto|vacation|insurance|401"),
    ("requirements", r"requirement|qualification|experience|degree|background"),
    ("skills", r"skill|tech stack|language|framework|tool"),
    ("responsibilities", r"responsibilit|dut"),
)
APPENDIX_FIELDS = ("requirements", "responsibilities", "benefits", "skills")

# ---- Fixed values: routing -----------------------------------------------------------------------
AGGREGATION_WORDS = (
    r"how many|count|total|average|avg|salary|types? of|what .{0,30}(?:available|exist)|list all"
)
RETRIEVAL_WORDS = r"find|looking for|jobs? (?:with|for|that)|roles? (?:for|with)|hiring"
ROUTES = ("retrieval", "aggregation", "hybrid")

# ---- Fixed values: evaluation --------------------------------------------------------------------
VERDICTS = ("relevant", "marginal", "not_relevant")
CATEGORIES = ("exact", "semantic", "filtering", "aggregation", "noisy")
EVAL_KS = (1, 3, 5, 10)
EVAL_DEFAULT_K = 5
EVAL_MAX_K = 10
JUDGE_DESCRIPTION_CHARS = 300
LABEL_CAP = 40
SAMPLES_PER_TIER = 2
TIERS = ("top", "bottom", "cross")

# ---- Fixed values: prompt texts ------------------------------------------------------------------
NO_POSTINGS_ANSWER = (
    "No relevant job postings found for your query. Try different keywords or broaden your search."
)
NO_DATA_ANSWER = "No data found for this query."
RETRIEVAL_PROMPT_HEAD = (
    "You are a helpful job search assistant. Answer the user's query based ONLY on the job postings provided below.\n"
    "Be concise and specific. If the postings don't contain relevant information, say so clearly. "
    "Do not fabricate details.\n\n"
)
AGGREGATION_PROMPT_HEAD = (
    "You are a job search assistant. Summarize the following data in 2-3 sentences to answer the user's question.\n"
    "Be concise and factual. Do not fabricate details.\n\n"
)
HYBRID_PROMPT_HEAD = (
    "You are a job search assistant. Answer the user's question using BOTH the job listings and the statistical "
    "data below.\nBe concise and specific. Do not fabricate details. If salary or other details are not available "
    "for a listing, say so.\n\n"
)
