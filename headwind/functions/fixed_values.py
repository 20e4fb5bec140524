"""Results are only right when these equal the published rules."""

# Subject categories, tried from top to bottom; the first rule with a matching substring wins.
CATEGORY_RULES = [
    ("Bitcoin", ["bitcoin", "btc"]),
    ("Ethereum", ["ethereum", "eth"]),
    ("Ripple", ["ripple", "xrp"]),
    ("Litecoin", ["litecoin", "ltc"]),
    ("Binance", ["binance", "bnb"]),
    ("Altcoins", ["altcoin", "alt", "token"]),
    ("Blockchain Tech", ["blockchain", "defi", "nft", "web3", "dao"]),
    ("Regulation", ["regulation", "sec", "law", "government"]),
    ("Markets & Exchanges", ["exchange", "trading", "market"]),
]
CATEGORY_DEFAULT = "Other Crypto"

# Tone words (case-sensitive) and their scores.
TONE_SCORES = {"positive": 1, "neutral": 0, "negative": -1}

# Bands used by the cluster names.
STRONG_POLARITY = 0.2
SUBJECTIVE_ABOVE = 0.5
OBJECTIVE_BELOW = 0.2
SECOND_CATEGORY_SHARE = 0.6
DOMINANT_SOURCE_SHARE = 0.7
NAME_LENGTH = 60
POLARITY_LABELS = ["Negative", "Neutral", "Positive"]

# Outlets by kind, lower-case.
MAINSTREAM_OUTLETS = ["reuters", "bloomberg", "cnbc", "forbes", "wsj", "cnn", "bbc"]
CRYPTO_OUTLETS = ["coindesk", "cointelegraph", "bitcoin.com", "crypto news", "the block"]

# Fields of one annotated record.
ANNOTATION_SCHEMA = (
    "record_id int, title_verbs array<string>, title_adjectives array<string>, title_tonality string, "
    "text_verbs array<string>, text_adjectives array<string>, text_tonality string"
)
ANNOTATION_LISTS = ["title_verbs", "title_adjectives", "text_verbs", "text_adjectives"]
ANNOTATION_TONES = ["title_tonality", "text_tonality"]
PROMPT_TEXT_CHARS = 500
