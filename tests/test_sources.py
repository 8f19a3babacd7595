"""Review files, raw CSVs, stored tables, exports."""

from __future__ import annotations

import datetime
import gzip
import os

import pytest

from reviewlytics.plans import scoring
from reviewlytics.plans.search import recent_reviews
from reviewlytics.sources import exports, review_files, tables


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("reviews with space+plus")

    def put(path, content):
        target = base / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content, encoding="utf-8")

    put("top level_inn.txt", "2024\t sub \t text one \textra\n\n2024\tonly two\n2024\t\t\n x\ty\t\n")
    put("new-york/o'neil_2nd.house.dat", "d\t\tbody\x85d2\ts2\tb2\r\nd3\ts3\tb3")
    put("new-york/skipped.ZIP", "d\ts\tzipped")
    put("new-york/deep/er.txt", "d\ts\ttoo deep")
    with gzip.open(base / "old.gz", "wt") as f:
        f.write("d\ts\tgz")
    # Archives are pruned from the scan: reading this one would fail.
    put("new-york/broken.gz", "no gzip at all")
    return str(base)


def test_read_reviews(spark, root):
    got = {tuple(r) for r in review_files.read_reviews(spark, root).collect()}
    deep = ("new-york/o'neil_2nd.house.dat", "O'Neil 2Nd.House", "New York")
    top = ("top level_inn.txt", "Top Level Inn", "")
    assert got == {
        (*top, "2024", "sub", "text one"), (*top, "x", "y", ""),
        (*deep, "d", "", "body"), (*deep, "d2", "s2", "b2"), (*deep, "d3", "s3", "b3"),
    }


def write(spark, path, header, *lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.csv"), "w", encoding="utf-8") as f:
        f.write("\n".join([header, *lines]) + "\n")


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("csv"))
    write(spark, f"{base}/hotels", "hotel_name,address,city,country,star_rating",
          "Alpha,,Rome,IT,4.5", "Alpha,,Oslo,NO,NA", '"Be ""B"" ta","1, Road",Rome,IT,')
    write(spark, f"{base}/features", "feature_name,description,is_active", "Cleanliness,d,Y", "Parking,,N")
    write(spark, f"{base}/seeds", "feature_name,seed_phrase,weight",
          "Cleanliness,clean,0.5", "Cleanliness,dirty,-1", "Unknown,x,1", "Parking,car,0.42")
    write(spark, f"{base}/reviews", "hotel_name,review_text,reviewer_name,review_date,overall_rating",
          'Alpha,"clean, really",Ann,3/4/24,4.0', 'Nowhere,lost,,2024-01-01,1', '"Be ""B"" ta",dirty,,2024-05-06,NA',
          "Alpha,so so,,06.05.2024,3")
    return tables.load_tables(spark, base, str(tmp_path_factory.mktemp("tables")))


def test_load_tables(loaded):
    hotels = {(r.hotel_name, r.city): r for r in loaded.hotel.collect()}
    assert len({r.hotel_id for r in hotels.values()}) == 3
    assert hotels["Alpha", "Oslo"].star_rating is None and hotels['Be "B" ta', "Rome"].star_rating is None
    assert float(hotels["Alpha", "Rome"].star_rating) == 4.5
    seeds = {r.seed_phrase: int(r.weight) for r in loaded.seed.collect()}
    assert seeds == {"clean": 1, "dirty": -1, "car": 0}  # the unknown feature is dropped
    names = {r.hotel_id: (r.hotel_name, r.city) for r in hotels.values()}
    reviews = loaded.review.collect()
    assert len({r.review_id for r in reviews}) == len(reviews) == 5
    assert sorted((names[r.hotel_id], r.review_text, r.review_date) for r in reviews if r.review_text != "so so") == [
        (("Alpha", "Oslo"), "clean, really", datetime.date(2024, 3, 4)),
        (("Alpha", "Rome"), "clean, really", datetime.date(2024, 3, 4)),
        (('Be "B" ta', "Rome"), "dirty", datetime.date(2024, 5, 6)),
    ]
    assert {r.review_date for r in reviews if r.review_text == "so so"} == {None}
    assert loaded.rating.count() == 0


def test_scores_are_stored_and_refreshed_in_place(spark, loaded, tmp_path):
    root = str(tmp_path)
    day = datetime.date(2025, 1, 1)
    stored = tables.write_ratings(scoring.calc_ratings(loaded, updated=day), root)
    assert stored.count() == 3 and stored.select("rating_id").distinct().count() == 3
    m = loaded.with_(rating=stored.drop("rating_id"))
    again = scoring.refresh_hotels(m, loaded.hotel.filter("city = 'Oslo'"), updated=day)
    replaced = tables.write_ratings(again, root)
    columns = ["hotel_id", "feature_id", "score", "total_mentions"]
    assert sorted(replaced.select(columns).collect()) == sorted(
        scoring.calc_ratings(loaded, updated=day).select(columns).collect()
    )


def raw_files(spark, base, *reviews):
    write(spark, f"{base}/hotels", "hotel_name,address,city,country,star_rating", "Alpha,b,Rome,IT,4", "Alpha,a,Rome,IT,3")
    write(spark, f"{base}/features", "feature_name,description,is_active", "Price,d,Y", "Price,c,Y", "Bar,,Y")
    write(spark, f"{base}/seeds", "feature_name,seed_phrase,weight", "Price,cheap,1", "Price,cheap,1", "Bar,cheap,1")
    write(spark, f"{base}/reviews", "hotel_name,review_text,reviewer_name,review_date,overall_rating", *reviews)


def test_line_breaks_are_kept_or_stop_the_load(spark, tmp_path):
    base, root = str(tmp_path / "csv"), str(tmp_path / "tables")
    raw_files(spark, base, 'Alpha,"first line\nsecond, ""line""",bob,2024-01-01,4.0', "Alpha,other,,,NA")
    m = tables.load_tables(spark, base, root, multi_line=True, by_hotel=False)
    assert sorted((r.review_text, r.reviewer_name) for r in m.review.collect()) == [
        ('first line\nsecond, "line"', "bob"), ("other", None),
    ]
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.load_tables(spark, base, root)
    # The failed load has left the tables as they were.
    assert tables.read_tables(spark, root).review.count() == 2


def test_duplicates_are_rejected_and_counted(spark, tmp_path):
    base, root = str(tmp_path / "csv"), str(tmp_path / "tables")
    raw_files(spark, base, "Alpha,cheap,,,NA")
    m = tables.load_tables(spark, base, root)
    assert [(r.hotel_name, r.address) for r in m.hotel.collect()] == [("Alpha", "a")]
    assert m.feature.count() == 2 and m.seed.count() == 2 and m.review.count() == 1
    rejected = {(r.table, tuple(r.key)[-1]): r.rows for r in spark.read.parquet(f"{root}/rejected").collect()}
    assert rejected == {("hotel", "Rome"): 1, ("feature", "Price"): 1, ("seed", "cheap"): 1}
    again = tables.load_tables(spark, base, root)  # in place of the first load
    assert again.hotel.count() == 1 and sorted(os.listdir(root)) == [
        "feature", "hotel", "rating", "rejected", "review", "seed",
    ]


def test_roots_that_occur_in_names_below_them(spark, tmp_path, monkeypatch):
    root = tmp_path / "data"
    (root / "bigdata").mkdir(parents=True)
    (root / "bigdata" / "data.txt").write_text("d\ts\tb")
    monkeypatch.chdir(tmp_path)
    for given in (str(root), f"{root}/", f"file:{root}", f"file://{root}"):
        [r] = review_files.read_reviews(spark, given).collect()
        assert (r.file, r.hotel, r.city) == ("bigdata/data.txt", "Data", "Bigdata")


def test_files_that_cannot_be_listed_are_named(spark, tmp_path):
    (tmp_path / "rome").mkdir()
    (tmp_path / "a.txt").write_text("d\ts\tb")
    for name in ("_inn.txt", "rome/.inn.txt", "_SUCCESS", ".a.txt.crc"):
        (tmp_path / name).write_text("d\ts\tb")
    with pytest.raises(ValueError, match=r"2 files .*_inn.txt, rome/.inn.txt"):
        review_files.read_reviews(spark, str(tmp_path))
    assert review_files.read_reviews(spark, str(tmp_path), skip_hidden=True).count() == 1


def test_stored_reviews_answer_a_search(loaded):
    assert {r.review_text for r in recent_reviews(loaded, "ALPHA").collect()} == {"clean, really", "so so"}


def test_exports(spark, rows, tmp_path):
    names = exports.SENTIMENT_COLUMNS
    values = {c: None for c in names} | {
        "hotel": "H", "city": "", "review": 'say "hi", ok ', "subject": " s", "sentiment": "positive",
        "date": "d", "compound": 0.5, "price_score": -0.25, "price_label": "negative",
    }
    schema = ", ".join(f"{c} {'double' if c == 'compound' or c.endswith('score') else 'string'}" for c in names)
    df = spark.createDataFrame([tuple(values[c] for c in names)], schema).coalesce(1)
    path = str(tmp_path / "sentiment")
    exports.write_review_sentiment(df, path)
    [part] = [p for p in os.listdir(path) if p.startswith("part-")]
    header, line = open(os.path.join(path, part), encoding="utf-8").read().splitlines()
    assert header == ",".join(names)
    assert line == 'H,,d, s,"say ""hi"", ok ",positive,0.5000,,,,,,,,,-0.2500,negative'
    [back] = tables.read_csv(spark, path, exports.SENTIMENT_SCHEMA).collect()
    assert back.review == 'say "hi", ok ' and back.service_score is None

    seeds = rows([("Price", "good deal", 0.12345)], "feature_name string, seed_phrase string, weight double")
    exports.write_seeds(seeds, str(tmp_path / "seeds"))
    assert tables.read_csv(spark, str(tmp_path / "seeds"), exports.SEED_SCHEMA).first().weight in ("0.1234", "0.1235")
