from pyspark.sql import functions as F

from headwind.functions import parse, text


def col(rows, values, expr, kind="string"):
    df = rows([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_sentiment_with_defaults(rows):
    got = col(rows, [None, "{'class': 'x', 'polarity': 0}", "bad", '{"class": "y", "polarity": -0.5, "subjectivity": 1}'], parse.parse_sentiment)
    assert [tuple(g) for g in got] == [("unknown", 0.0, 0.0, False), ("x", 0.0, 0.0, False), ("unknown", 0.0, 0.0, True), ("y", -0.5, 1.0, False)]


def test_sentiment_without_defaults(rows):
    got = col(rows, [None, "{'class': 'x'}", "{'class': None, 'polarity': None, 'subjectivity': 0.5}"], lambda c: parse.parse_sentiment(c, defaults=False))
    assert [tuple(g)[:3] for g in got] == [(None, None, None), ("x", None, None), (None, None, 0.5)]


def test_list_cells(rows):
    cells = [None, "", "[]", '["a","b"]', "['a', 'b']", "notalist", '["a", null]']
    assert col(rows, cells, lambda c: F.size(parse.parse_list(c))) == [0, 0, 0, 2, 2, 0, 0]


def test_tone_is_case_sensitive_unless_asked(rows):
    tones = ["positive", "Positive", "neutral", "negative", "unknown", None]
    assert col(rows, tones, parse.tone_score) == [1, 0, 0, -1, 0, 0]
    assert col(rows, tones, lambda c: parse.tone_score(c, normalize_case=True)) == [1, 1, 0, -1, 0, 0]


def test_joined_texts_keep_or_drop_blanks(rows):
    df = rows([("", "a", None, "b")], "a string, b string, c string, d string")
    row = df.select(parse.join_texts("a", "b", "c", "d"), parse.join_texts("a", "d", keep_blank=False)).first()
    assert list(row) == [" a  b", "b"]


def test_categories_follow_rule_order(rows):
    subjects = ["altcoin", "Bitcoin", "method", "security", "defi", "market", "token sale", None, "xrp", "bnb"]
    assert col(rows, subjects, parse.categorize) == [
        "Litecoin", "Bitcoin", "Ethereum", "Regulation", "Blockchain Tech", "Markets & Exchanges", "Altcoins", "Other Crypto",
        "Ripple", "Binance",
    ]


def test_own_rules(rows):
    rules = [("Fruit", ["apple", "pear"]), ("Veg", ["leek"])]
    assert col(rows, ["An Apple", "leek", "x"], lambda c: parse.categorize(c, rules, "None")) == ["Fruit", "Veg", "None"]


def test_instants_and_names(rows):
    got = col(rows, ["2025-03-13T21:26:41Z", "2025-03-13T23:26:41+02:00", "bad", None], lambda c: F.date_format(parse.iso_instant(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2025-03-13 21:26:41", "2025-03-13 21:26:41", None, None]
    names = ["they're bill's friends", "btc2usd NEWS", ""]
    assert col(rows, names, parse.title_case) == [n.title() for n in names]
    assert col(rows, names, parse.capitalize) == [n.capitalize() for n in names]
    assert col(rows, ["x" * 60, "x" * 61], parse.shorten) == ["x" * 60, "x" * 57 + "..."]


def test_terms(rows):
    texts = ["The Été in 2024, a über_cool x", "", None, "one"]
    assert col(rows, texts, text.tokens) == [["the", "été", "in", "2024", "über_cool"], [], [], ["one"]]
    assert col(rows, texts, lambda c: text.terms(c, ["the", "in"], (1, 2)))[0] == ["été", "2024", "über_cool", "été 2024", "2024 über_cool"]
    assert col(rows, ["a", "one", "one two"], lambda c: text.terms(c, None, (2, 2))) == [[], [], ["one two"]]


def test_preprocess_and_prefix_columns(rows):
    cell = "{'class': 'positive', 'polarity': 0.5, 'subjectivity': 0.25}"
    df = rows(
        [(cell, "altcoin", '["buy", "sell"]', None, "['is']", '["big"]', "positive", "Negative")],
        "sentiment string, subject string, title_verbs string, title_adjectives string, text_verbs string, text_adjectives string, title_tonality string, text_tonality string",
    )
    out = parse.preprocess(df)
    r = out.first()
    assert (r.sentiment_class, r.sentiment_polarity, r.crypto_category) == ("positive", 0.5, "Litecoin")
    assert (r.title_verbs_count, r.title_adjectives_count, r.title_tonality_score, r.text_tonality_score) == (2, 0, 1, 0)
    assert (r.all_linguistic_features, r.all_verbs, r.all_adjectives) == ("buy sell  is big", "buy sell is", "big")
    assert parse.columns_like(out, "title_verbs_") == ["title_verbs_parsed", "title_verbs_count", "title_verbs_text"]
