"""Keyword lists, thresholds and label tables that results depend on."""

# Fast up/down market keywords.
FAST_MARKET_WORDS = [
    "updown-5m", "up-or-down-5", "btc-updown", "bitcoin-updown", "btc-up", "eth-up", "sol-up", "xrp-up", "doge-up",
]
# Words that exclude a market from the short-event tier.
SHORT_EVENT_EXCLUDED_WORDS = [
    "updown", "up-or-down", "5m", "15m", "1h", "hour", "minutes", "btc-up", "eth-up", "sol-up", "xrp-up", "doge-up",
]
# Sports categories.
SPORTS_CATEGORIES = ["sports", "soccer", "basketball", "esports", "football", "tennis", "baseball", "mma", "boxing"]
# Season-long sports words.
SEASON_WORDS = [
    "champion", "winner", "champion-2026", "champion-2027", "world-cup-winner", "nba-champion", "nfl-champion",
    "superbowl", "stanley-cup",
]
# Match-level sports words in slugs.
SPORTS_SLUG_WORDS = [
    "nba-", "nfl-", "epl-", "premier-league-", "champions-league-", "fa-cup-", "bundesliga-", "will-win-the-match",
    "beats-", "wins-the-match", "match-winner", "score-more-goals", "-vs-", "to-win-", "total-goals-", "over-under-",
    "first-goal-", "half-time-", "most-assists-", "top-scorer-", "handball-", "hockey-", "rugby-",
]
# Words that veto a slug-only sports match.
SPORTS_GUARD_WORDS = [
    "trump", "election", "tariff", "senate", "btc", "eth", "crypto", "will-trump", "president", "government",
    "harris", "biden", "desantis", "pelosi", "zuckerberg", "musk",
]
# Sports lists of the arbitrage scanner variant.
ARB_SPORTS_CATEGORIES = [
    "sports", "basketball", "football", "soccer", "tennis", "baseball", "hockey", "ufc", "boxing", "mma", "golf",
    "nascar", "f1", "esports", "olympics", "nba", "nfl", "mlb", "nhl", "epl", "la_liga", "champions_league",
    "serie_a", "bundesliga", "ligue_1", "cricket", "rugby",
]
ARB_SPORTS_SLUG_WORDS = [
    "nba-", "nfl-", "mlb-", "nhl-", "epl-", "la-liga-", "champions-league-", "serie-a-", "bundesliga-", "ligue-1-",
    "-vs-", "-to-win-", "total-goals-", "player-props-", "nba-finals", "nba-eastern", "nba-western", "nfl-playoffs",
    "super-bowl", "world-cup", "euro-cup", "ufc-", "mma-", "boxing-", "-win-the-",
]
# Political keywords in priority order, and their categories.
POLITICAL_WORDS = [
    "trump", "biden", "harris", "election", "congress", "senate", "president", "impeach", "tariff", "fed-chair",
    "supreme-court", "nato", "war", "ceasefire", "sanction", "debt-ceiling", "legislation", "veto", "executive-order",
]
POLITICAL_CATEGORY = {
    "election": "ELECTION", "president": "ELECTION", "senate": "ELECTION", "congress": "LEGISLATION",
    "legislation": "LEGISLATION", "veto": "LEGISLATION", "tariff": "POLICY", "fed-chair": "APPOINTMENT",
    "supreme-court": "APPOINTMENT", "war": "GEOPOLITICAL", "ceasefire": "GEOPOLITICAL", "nato": "GEOPOLITICAL",
    "sanction": "GEOPOLITICAL",
}
POLITICAL_EXCLUDED_WORDS = [
    "updown", "5m", "sport", "nba", "nfl", "nhl", "soccer", "champion", "winner", "world-cup", "playoff", "season",
]
# Tier classifier words.
TIER_FAST_WORDS = ["updown", "up-or-down", "5m", "-5m-"]
TIER_SPORTS_WORDS = ["sports", "sport", "game", "match", "nba", "nfl", "mlb", "epl", "f1", "ufc", "boxing", "tennis"]
# Resolution-risk words (the low list is tried first).
LOW_RISK_WORDS = [
    "meeting-held", "deal-signed", "ceasefire-extended", "treaty", "election-held", "voted", "announced",
    "updown-5m", "up-or-down-5m",
]
HIGH_RISK_WORDS = [
    "invade", "attack", "normal", "significant", "major", "substantial", "large-scale", "effectively",
    "hormuz-traffic", "iran-permanent", "us-iran", "military-action",
]
# Funding-source words.
MIXER_WORDS = ["tornado", "mixer"]
EXCHANGE_WORDS = ["binance", "okx", "coinbase", "kraken", "hot wallet", "cex"]
# Artifact sources that are never allowed.
BLOCKED_SOURCE_MARKERS = ["graphify", "graph_report", "graph_json", "human_read_only"]
# Smallest whale bet per tier in USD.
WHALE_MIN_USD = {"t1": 50.0, "t2": 75.0, "t3": 500.0, "t5": 25.0}
WHALE_MIN_USD_DEFAULT = 500.0
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
# Month-name deadline at the end of a slug, and trailing window timestamp.
DEADLINE_SUFFIX = (
    r"-(by-)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"(uary|ruary|ch|il|e|y|ust|tember|ober|ember)?-?\d*(-\d{4})?$"
)
WINDOW_SUFFIX = r"-(\d{9,11})$"
