"""Query parameters: word tables and seed phrases that fit the synthetic texts."""

# (feature_id, phrase, weight): whole words, parts of words, two words, real regexes, a phrase
# that never occurs ('spotless') and one of an inactive feature (6).
SEED_PHRASES = [
    (1, "licensed", "1"), (1, "best", "-1"), (1, "spotless", "1"),
    (2, "with", "1"), (2, "from", "-1"), (2, "this the", "1"),
    (3, "und", "1"), (3, "der", "-1"),
    (4, "that", "1"), (4, "are", "-1"), (4, "in the", "-1"), (4, "é[nr]", "0.42"),
    (5, "los", "1"), (5, "tion", "-1"), (5, "fr[eo]", "0.5"),
    (6, "the", "1"),
]

ASPECT_KEYWORDS = [
    ("cleanliness", "thon"), ("cleanliness", "thnt"),
    ("service", "thth"), ("service", "thes"), ("service", "thnt haea"),
    ("location", "thre"), ("location", "thhe"),
    ("comfort", "ther"), ("comfort", "thha"),
    ("price", "thed"), ("price", "erin"),
]

LEXICON = [
    ("the", "0.3"), ("and", "-0.2"), ("with", "1.1"), ("not", "-1.5"),
    ("this", "0.7"), ("are", "-0.9"), ("was", "-0.4"), ("that", "0.5"),
]

STOP_WORDS = "the and of with not this are was that in on a to is be as it for".split()

# Lemmas and tags of a few words; all others are their own lemma and nouns.
LEMMAS = [("thst", "thon"), ("inin", "erin"), ("haha", "haea")]
TAGS = [("thha", "VB"), ("er", "JJ"), ("nd", "VB"), ("re", "RB"), ("at", "IN")]
