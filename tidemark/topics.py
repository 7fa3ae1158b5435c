"""Default topic keywords, in priority order; ``classify_topic`` takes another table as a parameter."""

# ---- fixed values: topic keywords, whole and in the given order ---------------
TOPIC_KEYWORDS = [
    ("sports", [
        "counter-strike", " cs:", "csgo", "cs2", "league of legends", " lol:", "valorant", "dota 2", "overwatch",
        "rainbow six", "esports", "esport", "blast open", "blast premier", "pgl ", "iem ", "esl pro league", "faze",
        "natus vincere", "vitality vs", "astralis", "liquid vs", "furia vs", "ipl", " t20 ", "t20 world cup",
        "big bash", " bbl ", "pakistan super league", " psl ", "odi ", "test cricket", "cricket:",
        "indian premier league", "super giants", "kolkata knight", "rajasthan royals", "mumbai indians",
        "royal challengers", "nba", "nfl", "nhl", "mlb", "pga", "wimbledon", "ufc", "mma", "tennis", "soccer",
        "basketball", "baseball", "formula 1", " f1 ", "ncaa", "premier league", "champions league", "la liga",
        "bundesliga", "serie a", "ligue 1", "super bowl", "masters ", "olympics", "olympic games", "world series",
        "stanley cup", "nhl playoffs", "rebounds o/u", "assists o/u", "points o/u", "pts o/u", "eurobasket",
        "euro basket",
    ]),
    ("crypto", [
        "bitcoin", " btc ", "ethereum", " eth ", "crypto", "defi", "solana", " sol ", "usdt", "usdc", "binance",
        "coinbase", "nft ", "blockchain", "airdrop", " token ", "metamask", " sui ", "aptos", "avalanche", "ordinal",
        "inscription", "rune", "meme coin", "altcoin", "microstrategy bitcoin", "mstr bitcoin", "bitcoin purchase",
        "on-chain", "onchain", "layer 2", " l2 ", "staking", "polymarket us go live", "lighter market cap", "fdv",
    ]),
    ("geopolitics", [
        "war ", "military ", "nato ", "missile", "invasion", "troops", "ukraine", "russia", "china ", "taiwan",
        "iran", "israel", "hamas", "hezbollah", "north korea", "sanctions", "ceasefire", "conflict", "hostage",
        "airstrike", "air strike", "blockade", "siege", "capture", "nuclear", "npt ", "strike iran", "strikes iran",
        "iran strike", "israel strikes", "israel x ", "us strikes", "us x iran", "iranian regime", "khamenei",
        "netanyahu", "maduro", "venezuela", "regime", "coup", "junta", "embassy", "ambassador",
    ]),
    ("economics", [
        "federal reserve", "interest rate", "inflation", "gdp", " cpi", "earnings", "quarterly earnings",
        "beat earnings", "beat revenue", "merger", "acquisition", " ipo ", "crude oil", "oil price", " s&p ",
        "nasdaq", "dow jones", "unemployment", "tariff", "trade deal", "trade war", "recession", "rate cut",
        "rate hike", "stock price", "shares", " o/u ", "over/under", "revenue hit", "market cap", "opendoor",
        "payroll data", "bls stop",
    ]),
    ("entertainment", [
        "oscars", "grammy", "emmy", "bafta", "golden globe", "eurovision", "mrbeast", "mr beast", "youtube",
        "netflix", "spotify", "box office", "billboard", "taylor swift", "kanye", "beyoncé", "drake", "travis scott",
        "ariana", "billie eilish", "google year in search", "year in search", "stranger things", "movie release",
        "album release", "song release", "sam altman", "most searched", "chatgpt #1", "gpt-5", "gpt ads", "openai",
        "anthropic", "llama", "robinhood say", "robinhood earnings call", "will kanye", "bully release",
    ]),
    ("politics", [
        "election", "president", "senate", "congress", "house vote", "governor", "mayor", "parliament",
        "prime minister", "chancellor", "referendum", "ballot", "campaign", "democrat", "republican", "conservative",
        "labour party", "liberal party", "executive order", "government shutdown", "supreme court", "secretary of",
        "department of ", "cabinet member", "filibuster", "impeach", "resign", "trump", "biden", "harris", "macron",
        "scholz", "sunak", "publicly insult", "trump insult", "eo ", "trump eo", "congress vote", "senate vote",
        "house pass", "howard lutnick", "elon musk pay", "gambling loss", "cap on gambling",
    ]),
]
CATEGORY_TOPIC = {
    "military_geopolitics": "geopolitics",
    "regulatory_decision": "politics",
    "corporate_disclosure": "economics",
}
DEFAULT_TOPIC = "politics"
