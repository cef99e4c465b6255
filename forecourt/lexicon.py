"""Word lists, rule tables and constants.

Everything here is data.  Every operator takes the table it needs as a
parameter and uses the one below only as its default, so a second city or a
second domain is a new table, not new code.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES.  Results depend on these exact values and, for the ordered
# tables, on their order (ties go to the earlier row).
# ---------------------------------------------------------------------------

ISSUE_KEYWORDS: dict[str, list[str]] = {
    "Meter Tampering & Fraud": [
        "scam", "fraud", "cheat", "cheating", "manipulat", "meter", "zero",
        "reset", "display", "ripoff", "rip off", "theft", "stealing", "dishonest",
        "deceiv", "trick", "fake reading", "tamper", "corrupt",
    ],
    "Fuel Short Filling": [
        "short fill", "less fuel", "less petrol", "less diesel", "quantity",
        "litre", "liter", "half fill", "full tank", "not full", "filled less",
        "wrong quantity", "less quantity", "gave less",
    ],
    "Fuel Quality": [
        "adulterat", "mileage", "quality", "impure", "pure", "engine",
        "knock", "fuel quality", "petrol quality", "diesel quality", "bad petrol",
        "contaminated", "water in fuel", "octane",
    ],
    "Staff Behaviour": [
        "rude", "arrogant", "misbehav", "impolite", "abusive", "foul language",
        "aggressive", "attitude", "unprofessional", "yelling", "shouting",
        "disrespect", "ignorant", "staff", "attendant", "employee", "worker",
    ],
    "Staff Helpfulness": [
        "helpful", "polite", "friendly", "courteous", "cooperative", "kind",
        "professional", "efficient", "good service", "great service",
        "nice staff", "good staff", "excellent staff",
    ],
    "Billing Issue": [
        "bill", "billing", "receipt", "invoice", "overcharg", "extra charge",
        "wrong bill", "incorrect amount", "charged more", "no receipt",
        "overpriced", "wrong amount",
    ],
    "Payment Methods": [
        "upi", "gpay", "phonepe", "paytm", "google pay", "card", "pos",
        "swipe", "digital payment", "online payment", "cash only",
        "no upi", "terminal", "machine not working", "payment failed",
    ],
    "Waiting Time & Queue": [
        "wait", "waiting", "queue", "long queue", "slow", "delay",
        "hour", "minute", "rush", "crowd", "crowded", "busy",
        "long line", "takes long", "no management",
    ],
    "CNG Availability": [
        "cng", "compressed natural gas", "no cng", "cng not available",
        "cng unavailable", "cng pressure", "compressor", "cng station",
        "cng closed", "cng down", "cng full",
    ],
    "Air, Tyre & Nitrogen": [
        "air", "tyre", "tire", "nitrogen", "puncture", "inflation",
        "air pump", "tyre pressure", "air check", "free air",
        "nitrogen filling", "tyre repair",
    ],
    "Cleanliness & Hygiene": [
        "dirty", "clean", "hygiene", "hygienic", "garbage", "trash", "toilet",
        "washroom", "restroom", "filthy", "messy", "stink", "smell",
        "untidy", "neat", "sweep", "unhygienic",
    ],
    "Safety Concern": [
        "safe", "safety", "fire", "accident", "risk", "danger", "hazard",
        "unsafe", "leakage", "spill", "explosion", "smoking near pump",
        "no safety", "fire hazard",
    ],
    "Facility Maintenance": [
        "broken", "repair", "maintenance", "damage", "out of order",
        "not working", "nozzle", "equipment", "fix", "defunct",
        "needs repair", "old machine",
    ],
    "Operating Hours": [
        "closed", "open", "timing", "hours", "24 hour", "24/7", "night",
        "midnight", "early morning", "late night", "not open",
        "closed at night", "opening time",
    ],
    "Amenities & ATM": [
        "atm", "water", "drinking water", "seating", "rest area", "food",
        "cafe", "parking", "waiting area", "shade", "canteen",
    ],
    "Traffic & Accessibility": [
        "traffic", "lane", "entry", "exit", "congestion", "block",
        "road", "location", "accessible", "difficult to find", "signage",
        "narrow", "no space", "can't enter", "visibility",
    ],
    "Pricing": [
        "price", "rate", "costly", "expensive", "cheap", "cost",
        "fuel price", "high price", "petrol rate", "diesel rate",
    ],
}

ASPECT_KEYWORDS: dict[str, list[str]] = {
    "Staff & Service": [
        "staff", "attendant", "employee", "rude", "polite", "helpful",
        "behavior", "behaviour", "arrogant", "friendly", "service", "worker",
    ],
    "Fuel Quality": [
        "quality", "adulterat", "mileage", "octane", "pure", "impure",
        "quantity", "litre", "liter", "engine",
    ],
    "Billing & Honesty": [
        "billing", "bill", "overcharg", "cheat", "fraud", "scam",
        "receipt", "meter", "manipulat", "dishonest", "correct", "honest",
    ],
    "Waiting & Speed": [
        "wait", "queue", "slow", "delay", "fast", "quick", "minute",
        "rush", "crowd", "time", "busy",
    ],
    "Cleanliness": [
        "clean", "dirty", "hygiene", "washroom", "toilet", "filthy",
        "smell", "garbage", "neat", "messy", "sweep",
    ],
    "Payment Methods": [
        "upi", "card", "cash", "paytm", "gpay", "phonepay", "digital",
        "terminal", "payment",
    ],
    "CNG Availability": [
        "cng", "compressed", "available", "unavailable", "pressure", "compressor",
    ],
    "Facilities": [
        "air", "water", "parking", "seating", "atm", "tyre", "inflation",
        "facility", "amenity",
    ],
}

NEGATIVE_SIGNALS: list[str] = [
    "rude", "worst", "bad", "terrible", "horrible", "pathetic", "fraud", "scam",
    "cheat", "manipulat", "dishonest", "avoid", "dirty", "filthy", "overcharg",
    "not working", "broken", "down", "no", "not available", "unavailable", "slow",
    "delay", "arrogant",
]

POSITIVE_SIGNALS: list[str] = [
    "good", "great", "excellent", "best", "clean", "honest", "helpful", "polite",
    "quick", "fast", "trustworthy", "superb", "recommended", "efficient",
    "professional", "correct", "available", "working", "reliable",
]

# Regular expressions, matched without regard to case on the untouched text.
NEGATIVE_OVERRIDES: list[str] = [
    r"\bno\s+cng\b",
    r"\bcng\s+not\s+available\b",
    r"\bcng\s+unavailable\b",
    r"\bno\s+cng\s+available\b",
    r"\bfraud\b",
    r"\bscam\b",
    r"\bcheating\b",
    r"\bcheat\b",
    r"\bovercharg",
    r"\bripoff\b",
    r"\brip\s+off\b",
    r"\bfake\b",
    r"\btheft\b",
    r"\bdishonest\b",
    r"\bmanipulat",
]
OVERRIDE_STAR = 2
OVERRIDE_NEGATIVE_FLOOR = 0.6
OVERRIDE_POSITIVE_CEILING = 0.2

SPECIFIC_KEYWORDS: list[str] = [
    "meter", "receipt", "upi", "gpay", "cng", "litre", "mileage",
    "attendant", "nozzle", "billing", "overcharge", "queue",
]

TOPIC_WORDS: dict[str, list[str]] = {
    "Staff Conduct": [
        "staff", "attendant", "rude", "polite", "helpful", "behavior", "attitude",
    ],
    "Billing & Fraud": [
        "billing", "bill", "overcharg", "cheat", "fraud", "scam", "meter", "receipt",
    ],
    "Fuel Quality & Mileage": [
        "quality", "mileage", "adulterat", "engine", "octane", "litre",
    ],
    "Waiting Time & Queue": [
        "wait", "queue", "slow", "delay", "time", "minute", "rush",
    ],
    "CNG Availability": [
        "cng", "compressed", "available", "pressure", "compressor", "unavailable",
    ],
    "Cleanliness & Hygiene": [
        "clean", "dirty", "washroom", "toilet", "hygiene", "smell", "garbage",
    ],
    "Payment & Digital": [
        "upi", "card", "cash", "gpay", "payment", "terminal", "phonepay",
    ],
    "Facilities & Amenities": [
        "air", "water", "parking", "tyre", "inflation", "facility", "atm",
    ],
}
TOPIC_DEFAULT = "General Experience"
TOPIC_NOISE_WORDS: list[str] = ["other", "general", "service", "fill", "car", "air"]

# (substring of the lower-case title, brand); the first hit wins.
BRAND_RULES: list[tuple[str, str]] = [
    ("hindustan petroleum", "HP"), ("hp ", "HP"), ("hpcl", "HP"),
    ("bharat petroleum", "BPCL"), ("bpcl", "BPCL"),
    ("indianoil", "IndianOil"), ("indian oil", "IndianOil"), ("iocl", "IndianOil"),
    ("mahanagar gas", "Mahanagar Gas"), ("mgl", "Mahanagar Gas"),
    ("essar", "Essar"), ("shell", "Shell"), ("nayara", "Nayara"),
    ("reliance", "Reliance"),
]
BRAND_DEFAULT = "Other"

# (zone, latitude below, longitude below); None is no bound; first hit wins.
ZONE_RULES: list[tuple[str, float | None, float | None]] = [
    ("South Mumbai", 18.970, None),
    ("Central Mumbai", 19.050, None),
    ("Western Suburbs", 19.150, 72.880),
    ("Eastern Suburbs", 19.150, None),
    ("North Suburbs", None, None),
]
ZONE_MISSING = "Unknown"
ZONE_MISSING_AT_COLLECTION = "Mumbai"
DEFAULT_LAT, DEFAULT_LNG = 19.076, 72.877

# (rating at most, label); anything above the last row is Positive.
RATING_BANDS: list[tuple[float, str]] = [(2.5, "Negative"), (3.5, "Neutral")]
STAR_BANDS: list[tuple[float, str]] = [(2.0, "Negative"), (3.0, "Neutral")]

# Severity of a negative share in percent: (above, label) per view.
SEVERITY_NETWORK = (45.0, 30.0)
SEVERITY_STATIONS = (30.0, 15.0)
SEVERITY_REVIEWS = (50.0, 30.0)
CITY_LOW, CITY_HIGH = 3.0, 3.6

# Candidate column names, matched on the trimmed lower-case header, in order.
STATION_COLUMNS: dict[str, list[str]] = {
    "_rating": ["totalscore", "total_score", "rating", "score", "place_rating"],
    "_review_count": [
        "reviewscount", "reviews_count", "review_count", "numreviews",
        "place_total_ratings",
    ],
    "_title": ["title", "name", "place_name", "outlet"],
    "_address": ["address", "place_address"],
    "_lat": ["lat", "latitude", "latitude_clean", "location_lat"],
    "_lng": ["lng", "longitude", "longitude_clean", "lon", "location_lng"],
    "_category": ["categoryname", "category_name", "category", "retail_category"],
}
REVIEW_COLUMNS: dict[str, list[str]] = {
    "_review_text": [
        "review_text_final", "text", "review", "review_text", "comment", "body",
    ],
    "_rating": ["stars", "rating", "star", "score", "place_rating"],
    "_date": [
        "publishedatdate", "published_at_date", "date_iso", "date", "review_date",
        "publishat", "collected_at",
    ],
    "_title": ["title", "place_name", "outlet", "name", "location"],
}

# Display headers per view, in display order.
BROWSER_HEADERS: dict[str, str] = {
    "station_name": "Station", "brand": "Brand", "zone": "Zone",
    "author_name": "Reviewer", "rating": "Stars", "sentiment": "Sentiment",
    "confidence": "Confidence", "text": "Review",
}
STATION_REVIEW_HEADERS: dict[str, str] = {
    "author_name": "Reviewer", "rating": "Stars", "sentiment": "Sentiment",
    "confidence": "Confidence Score", "issue_category": "Issue Category",
    "text": "Review Text",
}
EXPORT_HEADERS: dict[str, str] = {
    "station_name": "Station Name", "station_address": "Station Address",
    "brand": "Brand", "category": "Category", "zone": "Zone", "lat": "Latitude",
    "lng": "Longitude", "station_rating": "Google Avg Rating",
    "station_reviews": "Google Review Count", "author_name": "Reviewer",
    "rating": "Review Stars", "text": "Review Text",
    "date_relative": "Date (Relative)", "sentiment": "Sentiment Classification",
    "bert_star": "Predicted Rating", "confidence": "Model Confidence",
    "issue_category": "Primary Issue", "issue_tags": "All Issues",
    "quality_score": "Quality Score", "source": "Data Source",
    "review_id": "Review ID",
}
STATION_SCORECARD_HEADERS: dict[str, str] = {
    "_title": "Station", "_rating": "Avg Rating", "_review_count": "Total Reviews",
    "sentiment": "Sentiment", "zone": "Zone", "fuel_type": "Fuel Type",
    "_address": "Address",
}
RESULT_HEADERS: dict[str, str] = {
    "_review_text": "Review", "_rating": "Stars", "sentiment": "Sentiment",
    "bert_star": "Predicted Rating", "confidence": "Confidence",
    "issue_category": "Issue", "issue_tags": "All Issues",
}

# Stop words of the mining jobs, by kind.
MINING_STOP_WORDS: list[str] = [
    # articles, prepositions, conjunctions
    "the", "a", "an", "is", "it", "in", "of", "and", "to", "for", "with", "on", "at", "by",
    "from", "this", "was", "are", "be", "not", "but", "have", "had", "has", "they", "their",
    "there", "that", "very", "so", "or", "as", "do", "did", "been", "all", "one", "if", "up",
    "out", "about", "than", "more", "when", "will", "can", "would", "like",
    # pronouns
    "you", "your", "yours", "my", "we", "i", "its", "he", "she", "her", "him", "his", "them",
    "us", "our", "me", "who", "whom", "what", "which", "where", "how", "why",
    # filler verbs and adverbs
    "get", "got", "also", "just", "no", "really", "come", "even", "always", "never", "dont",
    "good", "place", "nice", "here", "again", "went", "came", "said", "told", "take", "taken",
    "give", "given", "put", "use", "used", "want", "need", "let", "go", "going", "still",
    "back", "too", "yet", "off", "now", "then", "well", "much", "many", "some", "any", "few",
    "every", "each", "both", "same", "other", "first", "last", "new", "old", "via", "per", "re",
    "ll", "ve", "don",
    # domain noise
    "petrol", "pump", "station", "fuel", "filling", "mumbai", "india", "oil", "gas", "visit",
    "visited", "please", "today", "day", "time", "times", "ago", "week", "month", "year", "car",
    "bike", "vehicle", "fill", "filled", "air", "service", "overall", "general",
    # remaining filler
    "only", "while", "after", "before", "being", "through", "another", "should", "asked",
    "people", "person", "experience", "free", "extra", "less", "show", "happened", "extremely",
    "petroleum", "road", "owner", "speed", "crowd", "customers", "customer", "toward", "upon",
    "since", "until", "though", "although", "because", "between", "under", "above", "below",
    "around", "against", "during", "without", "within", "along", "following", "across",
    "behind", "beyond", "plus", "except", "however", "therefore", "moreover", "furthermore",
    "despite", "instead",
]

# Stop words of the keyword charts (a different, shorter set).
KEYWORD_STOP_WORDS: list[str] = [
    # function words
    "the", "a", "an", "is", "it", "in", "of", "and", "to", "for", "with", "on", "at", "by",
    "from", "this", "was", "are", "be", "not", "but", "have", "had", "has", "they", "their",
    "there", "that", "very", "so", "my", "we", "i", "its", "here", "get", "got", "also", "just",
    "no", "or", "as", "do", "did", "been", "all", "one", "if", "up", "out", "about", "than",
    "more", "when", "will", "can", "good", "place", "nice", "would", "like", "really", "come",
    "petrol", "pump", "station", "fuel", "filling", "mumbai",
    # pronouns and filler
    "you", "your", "yours", "he", "she", "her", "him", "his", "them", "us", "our", "me", "who",
    "whom", "what", "which", "where", "how", "why", "these", "those", "then", "even", "said",
    "told", "went", "came", "going", "saying", "asked", "made", "take", "taken", "took", "give",
    "given", "gave", "put", "use", "used", "using", "want", "wanted", "need", "needed", "let",
    "via", "per", "too", "yet", "off", "own", "new", "old", "big", "small", "first", "last",
    "much", "many", "some", "any", "few", "every", "each", "both", "either", "other", "same",
    "well", "still", "back", "over", "around", "re", "ll", "ve", "don", "doesn",
    # domain noise
    "oil", "gas", "india", "please", "always", "never", "today", "yesterday", "now", "time",
    "ago", "visit", "visited", "day", "week", "month", "year", "times",
]

NEGATIVE, NEUTRAL, POSITIVE, UNKNOWN = "Negative", "Neutral", "Positive", "Unknown"
SENTIMENTS = [POSITIVE, NEUTRAL, NEGATIVE]
OTHER = "Other"
REFERENCE_MONTH = "2026-06-01"
EVIDENCE_MIN_REVIEWS = 50
LOW_REVIEW_COUNT = 10
CRITICAL_NEGATIVE_PCT = 40.0
MISMATCH_RATING = 4.0
AMBIGUOUS_CONFIDENCE = 0.35
FRAUD_ISSUE = "Meter Tampering & Fraud"
PRAISE_ISSUE = "Staff Helpfulness"
CNG_BRAND = "Mahanagar Gas"
CNG_CATEGORY = "CNG Station"
PETROL_CATEGORY = "Petrol Pump"
CNG_FUEL, PETROL_FUEL = "CNG", "Petrol / Diesel"
CNG_MARK = "compressed"
BOUNDING_BOX = (18.89, 19.28, 72.77, 73.00)
AUDIT_SAMPLE = 30
EMPTY_TOPIC_DOCUMENT = "general service"
EMPTY_PHRASE_DOCUMENT = "general"
DEFAULT_STATION_RATING, DEFAULT_STATION_REVIEWS = 3.5, 10
INTERVAL_Z_80 = 1.2815515655446004

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """The tables one enrichment run uses; replace any of them per domain."""

    issues: dict[str, list[str]] = field(default_factory=lambda: dict(ISSUE_KEYWORDS))
    aspects: dict[str, list[str]] = field(default_factory=lambda: dict(ASPECT_KEYWORDS))
    negative_signals: list[str] = field(default_factory=lambda: list(NEGATIVE_SIGNALS))
    positive_signals: list[str] = field(default_factory=lambda: list(POSITIVE_SIGNALS))
    overrides: list[str] = field(default_factory=lambda: list(NEGATIVE_OVERRIDES))
    specific: list[str] = field(default_factory=lambda: list(SPECIFIC_KEYWORDS))
    mining_stop_words: list[str] = field(default_factory=lambda: sorted(set(MINING_STOP_WORDS)))
    keyword_stop_words: list[str] = field(default_factory=lambda: sorted(set(KEYWORD_STOP_WORDS)))
    brands: list[tuple[str, str]] = field(default_factory=lambda: list(BRAND_RULES))
    zones: list[tuple] = field(default_factory=lambda: list(ZONE_RULES))

    @classmethod
    def from_json(cls, payload: str) -> "Lexicon":
        """Read a lexicon from JSON; tables left out keep their defaults."""
        given = json.loads(payload)
        for name in ("brands", "zones"):
            if name in given:
                given[name] = [tuple(row) for row in given[name]]
        return cls(**given)


DEFAULT = Lexicon()
