"""SQL twins of the registered queries, for a second engine on the same tables."""

from __future__ import annotations

import re

from workbench import words as W
from workbench.binding import FEATURES

CITY = "NATION_9"
CARD_NAME = "er#00000001_"
REVIEWED_HOTEL = "supplier#000000010"
MIN_SCORES = {"overall": 2.75, "cleanliness": 2.5}
DELETED_REGION = "AFRICA"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    lines = ", ".join(
        "(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )
    return f"SELECT * FROM (VALUES {lines}) AS v({columns})"


def per_type(position: int) -> str:
    whens = " ".join(
        f"WHEN '{t}' THEN {_text(v[position]) if isinstance(v[position], str) else v[position]}"
        for t, v in FEATURES.items()
    )
    return f"CASE p_type {whens} END"


def up(value: str, places: int = 2) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18,8)), {places}) AS DOUBLE)"


def even(value: str, places: int = 2) -> str:
    return f"CAST(round_even(CAST({value} AS DECIMAL(18,8)), {places}) AS DOUBLE)"


def mean(value: str, places: int) -> str:
    scale = 10**places
    return (
        f"(CAST(sum(CAST(round({value} * {scale}) AS BIGINT)) AS DOUBLE)"
        f" / ({scale}.0::DOUBLE * count({value})))"
    )


def clean_name(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(translate({text}, '_-', '  '),"
        r" '\p{L}+|\P{L}+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
    )


def polarity(total: str) -> str:
    """Scaled polarity of a valence sum."""
    return (
        f"CAST(round(CAST(({total}) / sqrt(({total}) * ({total}) + 15.0::DOUBLE)"
        " AS DECIMAL(18,8)), 4) * 10000 AS BIGINT)"
    )


def label(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 0.05 THEN 'positive' WHEN {score} <= -0.05 THEN 'negative'"
        " ELSE 'neutral' END"
    )


def label_of_mean(total: str, n: str) -> str:
    """Label of total / n, both whole numbers; polarities are scaled by 10,000."""
    return (
        f"CASE WHEN {total} >= 500 * {n} THEN 'positive' WHEN {total} <= -500 * {n} THEN 'negative'"
        " ELSE 'neutral' END"
    )


def band(score: str) -> str:
    return f"CASE WHEN {score} >= 4 THEN 'Green' WHEN {score} >= 3 THEN 'Orange' ELSE 'Red' END"


def stars(score: str) -> str:
    return (
        f"repeat('⭐', CAST(least(greatest(round_even(CAST({score} AS DECIMAL(18,8)), 0), 0), 5)"
        " AS INTEGER))"
    )


def has(name: str, *parts: str) -> str:
    return "(" + " OR ".join(f"upper({name}) LIKE '%{p}%'" for p in parts) + ")"


RAW_STAR = (
    "CASE WHEN s_suppkey % 5 = 0 THEN 'NA'"
    " ELSE CAST(CAST((s_suppkey % 9 + 2) / 2.0 AS DECIMAL(2,1)) AS VARCHAR) END"
)
SLASH = r"'^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$'"
ISO = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"
PARSED_DATE = (
    f"CASE WHEN regexp_matches(review_date, {SLASH}) THEN CAST(try_strptime(review_date,"
    f" '%m/%d/%y') AS DATE) WHEN regexp_matches(review_date, {ISO})"
    " THEN CAST(try_strptime(review_date, '%Y-%m-%d') AS DATE) END"
)


def na_number(column: str) -> str:
    return f"CASE WHEN {column} <> 'NA' THEN CAST({column} AS DECIMAL(2,1)) END"


def id_group(*keys: str) -> str:
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"substr(md5({text}), 1, 3)"


WORD = r"'[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*'"
SENTENCE = r"'[.!?]+\s+|\n+'"

# Common table expressions; each may use the ones before it.
CTES = {
    "raw_hotel": f"""
        SELECT s_name AS hotel_name, 'Street ' || s_suppkey AS address, n_name AS city,
               r_name AS country, {RAW_STAR} AS star_rating, s_suppkey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "hotel": f"""
        SELECT s_suppkey + 1 AS hotel_id, hotel_name, address, city, country,
               {na_number('star_rating')} AS star_rating
        FROM raw_hotel""",
    "feature": f"""
        SELECT CAST({per_type(0)} AS BIGINT) AS feature_id, {per_type(1)} AS feature_name,
               count(*) || ' parts' AS description, {per_type(2)} AS is_active
        FROM part GROUP BY p_type""",
    "seed_row": f"""
        SELECT feature_id, seed_phrase,
               CASE WHEN tenths < 0 THEN '-' ELSE '' END || CAST(abs(tenths) // 10 AS VARCHAR)
               || '.' || CAST(abs(tenths) % 10 AS VARCHAR) AS weight
        FROM (SELECT CAST({per_type(0)} AS BIGINT) AS feature_id, seed_phrase,
                     CAST(sum(p_size) % 21 - 10 AS BIGINT) AS tenths
              FROM (SELECT p_type, p_size, unnest(string_split(p_name, ' ')) AS seed_phrase
                    FROM part) AS w
              GROUP BY 1, 2) AS g
        UNION ALL
        {_values(W.SEED_PHRASES, 'feature_id, seed_phrase, weight')}""",
    "raw_seed": """
        SELECT feature_name, seed_phrase, weight FROM seed_row JOIN feature USING (feature_id)""",
    "seed": f"""
        SELECT row_number() OVER (ORDER BY {id_group('feature_id', 'seed_phrase')}, feature_id,
                                  seed_phrase) AS seed_id,
               feature_id, seed_phrase, CAST(CAST(weight AS DECIMAL(2,0)) AS BIGINT) AS weight
        FROM seed_row""",
    "review": """
        SELECT doc_id AS review_id,
               nth - CASE WHEN nth % 10 = 9 THEN 1 ELSE 0 END + 1 AS hotel_id,
               text AS review_text,
               CASE WHEN doc_id % 7 <> 0 THEN source END AS reviewer_name,
               CASE WHEN doc_id % 11 <> 0
                    THEN DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) END AS review_date,
               CASE WHEN n_chars % 11 <> 0
                    THEN CAST(1 + (n_chars % 9) * 0.5 AS DECIMAL(2,1)) END AS overall_rating
        FROM (SELECT *, doc_id % (SELECT count(*) FROM supplier) AS nth FROM documents) AS d""",
    "raw_review": """
        SELECT hotel_name, review_text, reviewer_name,
               CASE review_id % 3 WHEN 0 THEN strftime(review_date, '%-m/%-d/%y')
                    WHEN 1 THEN strftime(review_date, '%Y-%m-%d')
                    ELSE strftime(review_date, '%d.%m.%Y') END AS review_date,
               coalesce(CAST(overall_rating AS VARCHAR), 'NA') AS overall_rating, review_id
        FROM review JOIN hotel USING (hotel_id)""",
    "hit": """
        SELECT * FROM (
            SELECT review_id, hotel_id, overall_rating, seed_id, feature_id, weight,
                   CAST(len(regexp_extract_all(review_text, '(?i)' || seed_phrase)) AS BIGINT)
                       AS mentions
            FROM review, seed) AS pair
        WHERE mentions > 0""",
    "sentiment": """
        SELECT hotel_id, feature_id, review_id, CAST(sum(weight) AS BIGINT) AS sentiment
        FROM hit GROUP BY ALL""",
    "mention": """
        SELECT hotel_id, feature_id, count(*) AS total_mentions,
               CAST(sum(sentiment) AS DOUBLE) / count(*) AS avg_sentiment,
               CAST(sum(CASE WHEN sentiment > 0 THEN 1 ELSE 0 END) AS BIGINT)
                   AS positive_mentions,
               CAST(sum(CASE WHEN sentiment < 0 THEN 1 ELSE 0 END) AS BIGINT)
                   AS negative_mentions
        FROM sentiment GROUP BY ALL""",
    "grid": """
        SELECT hotel_id, feature_id FROM hotel, feature WHERE is_active = 'Y'""",
    "rating": f"""
        SELECT hotel_id, feature_id,
               CAST({up('''CASE WHEN n = 0 THEN 2.5 ELSE least(greatest(
                   (20.0::DOUBLE * 3.0::DOUBLE
                    + n * (3.0::DOUBLE + 2.0::DOUBLE * (a / (0.5::DOUBLE + abs(a)))))
                   / (20.0::DOUBLE + n), 1.0), 5.0) END''')} AS DECIMAL(5,2)) AS score,
               CAST(n AS BIGINT) AS total_mentions, positive_mentions, negative_mentions
        FROM (SELECT grid.hotel_id, grid.feature_id,
                     CAST(coalesce(total_mentions, 0) AS DOUBLE) AS n,
                     coalesce(avg_sentiment, 0.0) AS a, positive_mentions, negative_mentions
              FROM grid LEFT JOIN mention
              ON grid.hotel_id = mention.hotel_id AND grid.feature_id = mention.feature_id) AS g""",
    "review_stat": f"""
        SELECT hotel_id, count(*) AS total_reviews, {mean('overall_rating', 1)} AS mean_review
        FROM review GROUP BY hotel_id""",
    "rating_stat": f"""
        SELECT hotel_id, {mean('score', 2)} AS mean_score, count(f.feature_id) AS features_rated
        FROM rating LEFT JOIN feature AS f USING (feature_id) GROUP BY hotel_id""",
    "hotel_stat": """
        SELECT hotel_id, hotel_name, city, country, mean_score, mean_review,
               coalesce(features_rated, 0) AS features_rated,
               coalesce(total_reviews, 0) AS total_reviews
        FROM hotel LEFT JOIN rating_stat USING (hotel_id) LEFT JOIN review_stat USING (hotel_id)""",
    "pivoted": f"""
        SELECT hotel_id, {mean('score', 2)} AS overall,
               max(CASE WHEN {has('feature_name', 'CLEAN')} THEN CAST(score AS DOUBLE) END)
                   AS cleanliness,
               max(CASE WHEN {has('feature_name', 'SERVICE')} THEN CAST(score AS DOUBLE) END)
                   AS service,
               max(CASE WHEN {has('feature_name', 'LOCATION')} THEN CAST(score AS DOUBLE) END)
                   AS location,
               max(CASE WHEN {has('feature_name', 'COMFORT')} THEN CAST(score AS DOUBLE) END)
                   AS comfort,
               max(CASE WHEN {has('feature_name', 'PRICE', 'VALUE')} THEN CAST(score AS DOUBLE)
                   END) AS price
        FROM rating JOIN feature USING (feature_id) GROUP BY hotel_id""",
    "card": f"""
        SELECT hotel_id, hotel_name, city, country,
               {even('coalesce(mean_score, mean_review, 0)')} AS overall_rating,
               coalesce(cleanliness, 0) AS cleanliness_score, coalesce(service, 0) AS service_score,
               coalesce(location, 0) AS location_score, coalesce(comfort, 0) AS comfort_score,
               coalesce(price, 0) AS price_score, total_reviews
        FROM hotel_stat LEFT JOIN pivoted USING (hotel_id)""",
    "seed_total": f"""
        SELECT seed_id, CAST(sum(mentions) AS BIGINT) AS mentions,
               {mean('overall_rating', 1)} AS mean_rating
        FROM hit GROUP BY seed_id""",
    "keyword_row": f"""
        {_values(W.ASPECT_KEYWORDS, 'aspect, keyword')}""",
    "lemma": f"""
        {_values(W.LEMMAS, 'token, lemma')}""",
    "tag": f"""
        {_values(W.TAGS, 'token, tag')}""",
    "lexicon": """
        SELECT token, CAST(valence AS DECIMAL(9,4)) AS valence FROM ("""
    + _values(W.LEXICON, "token, valence")
    + ") AS l",
    "keyword": """
        SELECT DISTINCT aspect, keyword, coalesce(lemma, token) AS lemma
        FROM (SELECT aspect, keyword, unnest(string_split(keyword, ' ')) AS token
              FROM keyword_row) AS k
        LEFT JOIN lemma USING (token)""",
    "file": f"""
        SELECT *, {clean_name("replace(split_part(file, '/', 2), '.txt', '')")} AS hotel,
               {clean_name("split_part(file, '/', 1)")} AS city
        FROM (SELECT *, 'region-' || length(source) || '/' || source || '.txt' AS file
              FROM documents) AS d""",
    "sentence": f"""
        SELECT doc_id, file, hotel, city, sentence_no - 1 AS sentence_no,
               regexp_extract_all(lower(s), {WORD}) AS words
        FROM (SELECT doc_id, file, hotel, city, unnest(parts) AS s,
                     generate_subscripts(parts, 1) AS sentence_no
              FROM (SELECT *, string_split_regex(text, {SENTENCE}) AS parts FROM file) AS p) AS q""",
    "token": """
        SELECT doc_id, file, hotel, city, sentence_no, place, token, coalesce(lemma, token) AS lemma
        FROM (SELECT doc_id, file, hotel, city, sentence_no, unnest(words) AS token,
                     generate_subscripts(words, 1) AS place
              FROM sentence) AS t
        LEFT JOIN lemma USING (token)""",
    "valence": """
        SELECT doc_id, sentence_no, CAST(sum(CAST(valence * 10000 AS BIGINT)) AS DOUBLE) / 10000
                   AS total
        FROM token JOIN lexicon USING (token) GROUP BY ALL""",
    "overlap": f"""
        SELECT doc_id, sentence_no, aspect, {polarity('coalesce(total, 0)')} AS scaled
        FROM (SELECT DISTINCT doc_id, sentence_no, aspect
              FROM token JOIN keyword ON token.lemma = keyword.lemma) AS m
        LEFT JOIN valence USING (doc_id, sentence_no)""",
    "aspect_score": """
        SELECT doc_id, aspect, CAST(sum(scaled) AS BIGINT) AS total, count(*) AS n,
               round(CAST(sum(scaled) AS DOUBLE) / count(*)) / 10000.0::DOUBLE AS score
        FROM overlap GROUP BY ALL""",
    "whole": f"""
        SELECT d.doc_id, {polarity('coalesce(total, 0)')} / 10000.0::DOUBLE AS compound
        FROM documents AS d
        LEFT JOIN (SELECT doc_id, CAST(sum(CAST(valence * 10000 AS BIGINT)) AS DOUBLE) / 10000
                       AS total
                   FROM token JOIN lexicon USING (token) GROUP BY doc_id) AS v
        ON d.doc_id = v.doc_id""",
    "clean": f"""
        SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_no ORDER BY place) - 1 AS pos
        FROM token
        WHERE regexp_full_match(token, '[a-z]+')
          AND token NOT IN ({", ".join(_text(w) for w in W.STOP_WORDS)},
                            'quot', 'just', 'even', 'still', 'get', 'got')""",
    "clean_sentence": """
        SELECT doc_id, sentence_no, list(token ORDER BY pos) AS words
        FROM clean GROUP BY ALL""",
    "occurrence": f"""
        SELECT c.doc_id, c.file, c.hotel, c.city, c.sentence_no, c.pos, c.token, k.aspect,
               s.words, {polarity('coalesce(v.total, 0)')} AS scaled
        FROM clean AS c
        JOIN (SELECT DISTINCT aspect, lemma FROM keyword) AS k ON c.lemma = k.lemma
        JOIN clean_sentence AS s ON c.doc_id = s.doc_id AND c.sentence_no = s.sentence_no
        LEFT JOIN valence AS v ON c.doc_id = v.doc_id AND c.sentence_no = v.sentence_no""",
    "window_size": _values([(0, 1), (1, 0), (0, 2), (1, 1), (2, 0)], "l, r"),
    "phrase": """
        SELECT DISTINCT o.doc_id, file, hotel, city, sentence_no, pos, aspect, scaled,
               array_to_string(words[pos - l + 1 : pos + r + 1], ' ') AS phrase
        FROM occurrence AS o JOIN window_size ON pos >= l AND pos + r < len(words)
        LEFT JOIN tag AS kt ON kt.token = o.token
        LEFT JOIN tag AS lt ON pos >= 1 AND lt.token = words[pos]
        WHERE coalesce(kt.tag, 'NN') LIKE 'N%'
          AND (words[pos - l + 1] = o.token
               OR (pos >= 1 AND (coalesce(lt.tag, 'NN') LIKE 'N%'
                                 OR coalesce(lt.tag, 'NN') LIKE 'J%')))""",
    "by_file": """
        SELECT file, hotel, city, aspect, phrase, count(*) AS support,
               CAST(round(CAST(sum(scaled) AS DOUBLE) / count(*)) AS BIGINT) AS scaled
        FROM phrase GROUP BY file, hotel, city, aspect, phrase
        HAVING count(*) >= 2 AND abs(CAST(sum(scaled) AS DOUBLE) / count(*)) / 10000 > 0.000001""",
    "merged": """
        SELECT upper(aspect[1]) || aspect[2:] AS feature_name, phrase AS seed_phrase,
               round(CAST(sum(scaled) AS DOUBLE) / count(*)) / 10000.0::DOUBLE AS weight
        FROM by_file GROUP BY aspect, phrase
        HAVING count(*) >= 2 AND abs(CAST(sum(scaled) AS DOUBLE) / count(*)) / 10000 > 0.000001""",
}


def _mentioned(sql: str, tables: dict[str, str]) -> list[str]:
    found = set(re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)", sql))
    return [name for name in tables if name in found]


def query(select: str, **changed: str) -> str:
    """``select`` with the table expressions it needs in front. ``changed`` replaces some."""
    return query_over({**CTES, **changed}, select)


def query_over(tables: dict[str, str], select: str) -> str:
    wanted: set[str] = set()
    todo = _mentioned(select, tables)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += _mentioned(tables[name], tables)
    parts = [f"{n} AS MATERIALIZED ({tables[n]})" for n in tables if n in wanted]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
