"""Word lists and patterns that results depend on. All are defaults of parameters."""

ENV_TERMS = (
    "carbon", "co2", "ghg", "greenhouse", "emission", "methane", "coal", "oil", "gas", "diesel", "fracking",
    "renewable", "solar", "wind", "photovoltaic", "hydro", "geothermal", "biofuel", "biodiesel", "nuclear",
    "recycl", "waste", "wastewater", "water", "pollut", "toxic", "hazard", "spill", "biodivers", "forest",
    "deforest", "reforest", "ecosystem", "air quality", "climate", "decarbon", "net zero", "net-zero",
    "electric vehicle", "ev charging", "energy efficien", "leed", "carbon capture", "ccs", "hydrogen",
    "scope 1", "scope 2", "scope 3", "sbti", "science based target", "tcfd", "csrd", "cbam", "carbon tax",
    "cap-and-trade", "emissions trading", "paris agreement", "energy transition", "low-carbon", "low carbon",
)
COMMODITY_TERMS = (
    "oil", "gas", "coal", "diesel", "fracking", "nuclear", "hydro", "water", "wastewater", "waste", "hazard", "spill", "toxic", "pollut", "wind", "solar", "forest",
)
CLAIM_TERMS = tuple(t for t in ENV_TERMS if t not in COMMODITY_TERMS)
FORWARD_TERMS = (
    "commit", "plan", "target", "future", "will", "aim", "aspire", "goal", "intend", "expect", "by 2030", "by 2040", "by 2050", "ambition", "pledge",
)
REALISED_TERMS = (
    "reduced", "achieved", "decreased", "cut", "installed", "invested", "completed", "delivered", "verified", "assured", "audited", "since 20", "compared with 20", "versus 20",
)
POSITIVE = (
    "achieve", "improve", "benefit", "success", "strong", "progress", "positive", "leader", "leading", "opportunit", "gain", "enhance", "excellent", "efficient", "innovat", "advantage", "best",
)
NEGATIVE = (
    "loss", "risk", "adverse", "fail", "decline", "penalt", "violat", "litigation", "impair", "negative", "unable", "weak", "difficult", "concern", "uncertain", "liabilit", "fine", "lawsuit",
)
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "by", "as", "at", "is", "are", "was", "were", "be", "been", "from", "that", "this", "it", "its", "we", "our", "their", "they", "which", "will", "may",
)
RISK_STEMS = (
    "risk", "threat", "hazard", "danger", "challeng", "concern", "cost", "disrupt", "exposure", "regulat", "legislat", "impact", "monitor", "overse", "control", "scenario", "stress",
)
CLIMATE_TERMS = (
    "climate", "carbon", "emission", "greenhouse", "ghg", "net zero", "net-zero", "renewable", "sustainab", "decarbon", "scope 1", "scope 2", "scope 3", "paris agreement", "energy transition",
    "environmental", "esg", "clean energy", "solar", "wind power", "electric vehicle", "methane", "carbon tax", "cap-and-trade", "emissions trading", "cbam", "csrd", "tcfd", "science based target",
    "biodiversity", "water usage", "waste", "pollution", "fossil", "coal", "natural gas",
)
DRY_RUN_FUTURE = ("will", "aim", "target", "by 2030", "by 2050", "commit", "aspire")
DRY_RUN_PAST = ("reduced", "achieved", "invested", "verified", "assured", "decreased")
LEGAL_SUFFIXES = (" Limited", " Ltd.", " Ltd", " Inc.", " Inc", " Corporation", " Corp.", " Corp", " PLC", " plc")
RUBRIC_WALK = {"realised_reductions": 0.25, "capital_deployed": 0.2, "verification": 0.15, "governance": 0.1, "hard_data_consistency": 0.15, "implementation_share": 0.15}
ABOUT_HINTS = (
    "about us", "about", "who we are", "our company", "company profile", "corporate profile", "overview", "關於", "关于", "公司簡介", "公司简介", "集團簡介", "集团简介",
)
SKIPPED_LINKS = ("javascript:", "mailto:", "tel:", "#")
RUBRIC_TALK = {"ambition": 0.4, "forward_looking_share": 0.3, "promotional_tone": 0.3}

# fixed values: (weight, pattern) by category of key figures, and report titles
_NUMBER = r"\d[\d,\.]*\s*"
KPI_PATTERNS = {
    "ghg": (
        (3, r"(?i)scope\s*[12]\b|scope\s*1\s*(?:and|&)\s*2"), (2, r"(?i)tco2|tonnes?\s+(?:of\s+)?co2|t\s*co2|ktco2|co2e|co2-e|carbon dioxide equivalent"), (1, r"(?i)greenhouse gas|ghg emissions?"),
    ),
    "energy": ((3, rf"(?i){_NUMBER}(?:kwh|mwh|gwh|gj|tj|terajoules?|gigajoules?)\b"), (1, r"(?i)energy consumption|electricity consumption|energy intensity|purchased electricity")),
    "water": ((3, rf"(?i){_NUMBER}(?:m3|m³|cubic met(?:re|er)s?|megalit(?:re|er)s?|ml\b)"), (1, r"(?i)water consumption|water withdrawal|water intensity|water usage")),
    "waste": ((2, r"(?i)hazardous waste|non-hazardous waste"), (1, r"(?i)waste (?:generated|produced|disposed|recycled|diverted)")),
}
TITLE_ESG = r"(?i)\b(esg|environmental, social|sustainab|climate)"
TITLE_ANNUAL = r"(?i)\bannual report\b"
TITLE_INTERIM = r"(?i)\binterim\b|\bquarterly\b|half-year"
TITLE_QUARTERLY = r"(?i)\bquarterly\b|\b(first|third)[- ]quarter"

# fixed values: preferences of 1 to 5 to annual volatility, greenness percentile and tilt
RISK_VOLATILITY = {1: 0.08, 2: 0.12, 3: 0.15, 4: 0.20, 5: 0.25}
GREEN_PERCENTILE = {2: 0.6, 3: 0.7, 4: 0.8, 5: 0.9}
GREEN_TILT = {1: 0.0, 2: 0.25, 3: 0.5, 4: 1.0, 5: 2.0}

# fixed values: listings by the end of a ticker (exchange, market, currency, factor proxy), and words left out of initials
LISTINGS = {
    ".HK": ("HKEX", "hk", "HKD", "Asia Pacific ex Japan regional factor proxy (USD)"),
    ".TWO": ("TPEx", "tw", "TWD", "Emerging regional factor proxy (USD)"),
    ".TW": ("TWSE", "tw", "TWD", "Emerging regional factor proxy (USD)"),
}
INITIALS_SKIPPED = ("CORP", "INC", "LTD", "LIMITED", "HOLDINGS", "GROUP", "CO")
NOT_DIMENSIONS = ("talk_unfiltered", "walk_composite", "walk_intensity_trend", "walk_emission_trend")
