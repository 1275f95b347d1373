"""Fixed values that results depend on, and defaults of the tunable ones.

Everything a deployment is expected to change (vocabulary, countries, denied domains, policies)
is a parameter table, see ``schemas``; the values here are the parts of the data contract.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: URL rules -------------------------------------------------------------------
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
]
SKIPPED_EXTENSIONS = [
    ".zip", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif",
    ".svg", ".webp", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".css", ".js", ".xml", ".rss", ".json",
]
FURNITURE_PATH = (
    r"/(search|sitemap|privacy|accessibility|cookies?|login|signin|register|rss|feed"
    r"|press|news|tender|vacanc|recruit|contact|disclaimer|copyright)(/|$|\.)"
)
MACHINE_HOST_LABELS = ["api", "apis", "ws", "rest", "graphql"]
MACHINE_SEGMENTS = ["api", "rest", "graphql", "client-service"]
DATED_SEGMENT = r"^t?((?:19|20)[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])?(?:$|[_.\-])"

# ---- fixed values: host rules ------------------------------------------------------------------
SUFFIX_MARKERS = [
    "ac", "co", "com", "edu", "gc", "go", "gob", "gouv", "gov", "govt", "int", "mil", "net", "or",
    "org",
]
GOVERNMENT_HOST = (
    r"(^|\.)gov(\.[a-z]{2,})?$|(^|\.)go\.[a-z]{2}$|(^|\.)gouv\.[a-z]{2}$|(^|\.)gob\.[a-z]{2}$"
    r"|(^|\.)govt\.[a-z]{2}$|(^|\.)gc\.ca$|(^|\.)admin\.ch$|(^|\.)europa\.eu$"
)
KIND_HINTS = [
    ("immi", "immigration_authority"),
    ("immigration", "immigration_authority"),
    ("ica", "immigration_authority"),
    ("emb", "embassy_or_high_commission"),
    ("embassy", "embassy_or_high_commission"),
    ("consul", "embassy_or_high_commission"),
    ("mofa", "foreign_ministry"),
    ("mfa", "foreign_ministry"),
    ("foreign", "foreign_ministry"),
]

# ---- fixed values: page text -------------------------------------------------------------------
CHROME_ELEMENTS = [
    "script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form",
    "iframe", "button",
]
PLACEHOLDER_LINE = r"^[a-z][a-z0-9]*([.\-_][a-z0-9\-]+)+$|^[a-z]+([A-Z][a-z0-9]*)+$"
MACHINE_CONTENT_TYPES = ["application/json", "application/xml", "text/csv", "text/xml"]
GAP_MARK = "\n[…]\n"

# ---- fixed values: roles -----------------------------------------------------------------------
ROLES = [
    "visa_decision", "document_checklist", "application_route", "fees", "processing_times",
    "general_entry",
]
REPORTED_ROLES = ["visa_decision", "document_checklist"]
LOAD_BEARING_ROLES = ["visa_decision"]
MISSION_ROLES = ["document_checklist", "application_route"]

SETTLED_REFUSALS = [401, 403]
REFUSALS = [401, 403, 429]


@dataclass(frozen=True)
class Limits:
    """Bounds of the crawl, the shortlist and the evidence. Their usual values are fixed values: results depend on them."""

    links_per_page: int = 400
    link_text: int = 300
    page_title: int = 200
    title: int = 90
    trusted_domains: int = 5
    queries_needed: int = 2
    queries_needed_own: int = 1
    pages: int = 40
    depth: int = 2
    pages_per_host: int = 20
    pages_per_host_floor: int = 4
    wave: int = 4
    follow_score: float = 10.0
    shortlist: int = 25
    shortlist_per_role: int = 3
    shortlist_domain_floor: int = 1
    role_score: float = 20.0
    excerpt_budget: int = 20_000
    excerpt_head: int = 6_000
    excerpt_window: int = 3_000
    readable_text: int = 400
    forward_hops: int = 2
    policy_bytes: int = 512_000
    page_bytes: int = 4_000_000
    fresh_hours: float = 24.0
    stale_hours: float = 168.0
    policy_hours: float = 24.0
    corridor_hours: float = 504.0


LIMITS = Limits()


@dataclass(frozen=True)
class Weights:
    """Additive points of the page scores: fixed values."""

    link_text: float = 1.2
    heading: float = 0.5
    base_topic: float = 6.0
    base_purpose: float = 18.0
    purpose: float = 20.0
    off_scope: float = -30.0
    form: float = -35.0
    language: float = -25.0
    index_page: float = -18.0
    nationality: float = 40.0
    shallow: float = 8.0
    depth: float = -10.0
    own_mission: float = 30.0
    other_mission: float = -45.0
    pdf_checklist: float = 10.0
    document_noun: float = 9.0
    document_noun_cap: int = 5
    document_noun_floor: int = 3
    breadth: int = 2
    link_share: float = 0.4
    body_share: float = 0.6


@dataclass(frozen=True)
class Lexicon:
    """A short vocabulary in code. Terms are (role, phrase, weight) in listed order.

    Its phrases become literals of the scoring expressions. A vocabulary in tables, of any size, is a
    ``vocabulary.Vocabulary``; scoring takes either.
    """

    terms: list[tuple[str, str, float]]
    topic_word: str = "visa"
    purposes: dict[str, list[str]] = field(default_factory=dict)
    off_scope: list[str] = field(default_factory=list)
    hard_off_scope: list[str] = field(default_factory=list)
    form: list[str] = field(default_factory=list)
    language: list[str] = field(default_factory=list)
    index_stems: list[str] = field(default_factory=list)
    archive: list[str] = field(default_factory=list)
    boilerplate: list[str] = field(default_factory=list)
    mission_markers: list[str] = field(default_factory=list)
    document_nouns: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=lambda: list(ROLES))
    weights: Weights = Weights()

    def own_terms(self, purpose: str) -> list[str]:
        return self.purposes.get(purpose, [])

    def off_scope_for(self, purpose: str) -> list[str]:
        """Off-scope terms minus the purpose's own terms, in listed order."""
        own = {term.lower() for term in self.own_terms(purpose)}
        return [term for term in self.off_scope if term.lower() not in own]

    def hard_off_scope_for(self, purpose: str) -> list[str]:
        own = {term.lower() for term in self.own_terms(purpose)}
        return [term for term in self.hard_off_scope if term.lower() not in own]
