"""Mention totals kept beside stored tables, so that a review is matched once.

``<root>/totals`` holds the totals of every hotel and feature (``pairs``), the names of the review files that
they count (``files``; a writer gives every file a name of its own) and a print of each feature's seeds
(``seeds``). Bringing them up to date reads

* the files that are not counted yet, whoever wrote them, for the features whose seeds are as they were;
* all reviews for features that are new or whose seeds have changed, with the seeds of these alone.

The folder is replaced as one, after the ratings that come from it: a job that stops anywhere leaves totals that are
true for the files they list, and the next run does what is missing. If a counted file has gone in any other
way than through ``plans.upkeep``, or the phrases are taken in another way, the totals are made anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics import schema as S
from reviewlytics.operators.matching import MatchLimits
from reviewlytics.plans.scoring import TOTALS, active_features, mention_totals, merge_totals
from reviewlytics.schema import Model
from reviewlytics.sources import tables

_FILES, _SEEDS = "file string", "feature_id bigint, print string"


@dataclass(frozen=True)
class State:
    pairs: DataFrame
    files: DataFrame
    seeds: DataFrame


@dataclass(frozen=True)
class UpToDate:
    """Totals of all stored reviews; ``touched``: hotels whose totals may have changed (None: all);
    ``keep`` makes them the stored ones, once the ratings that follow from them are stored."""

    totals: DataFrame
    touched: DataFrame | None
    keep: Callable[[], None]


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/totals"


def read_state(spark: SparkSession, root: str) -> State | None:
    """The stored totals, None where there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(root))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    schemas = {"pairs": TOTALS, "files": _FILES, "seeds": _SEEDS}
    return State(**{n: spark.read.schema(s).parquet(f"{_folder(root)}/{n}") for n, s in schemas.items()})


def file_names(table: DataFrame) -> dict[str, str]:
    """name -> path of the files of a table, as Spark's own list on the driver has them."""
    paths = [unquote(f) for f in table.inputFiles()]
    return {p.rsplit("/", 1)[1]: p for p in paths}


def seed_prints(m: Model, whole_word: bool) -> DataFrame:
    """feature_id, print of every active feature: equal if the same seeds are taken in the same way."""
    one = F.xxhash64("seed_phrase", F.col("weight").cast("decimal(2,0)")).cast("decimal(38,0)")
    seeds = m.seed.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("sum"))
    known = active_features(m.feature).select("feature_id").join(seeds, "feature_id", "left")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "sum")]
    return known.select("feature_id", F.concat_ws("|", *parts, F.lit(str(whole_word))).alias("print"))


def _of(m: Model, features: DataFrame) -> DataFrame:
    return m.seed.join(features.select("feature_id"), "feature_id", "left_semi")


def write_state(
    spark: SparkSession, root: str, pairs: DataFrame, files: Iterable[str], seeds: DataFrame
) -> tuple[DataFrame, Callable[[], None]]:
    """The totals as written beside the stored ones, and what puts them in their place."""
    fresh = f"{_folder(root)}-new-{uuid.uuid4().hex}"
    pairs.write.parquet(f"{fresh}/pairs")
    spark.createDataFrame([(n,) for n in sorted(files)], _FILES).write.parquet(f"{fresh}/files")
    seeds.write.parquet(f"{fresh}/seeds")
    return spark.read.schema(TOTALS).parquet(f"{fresh}/pairs"), lambda: tables.switch(spark, [(fresh, _folder(root))])


def bring_up_to_date(
    spark: SparkSession, root: str, limits: MatchLimits = MatchLimits(), whole_word: bool = False
) -> UpToDate:
    """Totals of the stored reviews; only what is not counted yet is matched."""
    m = tables.read_tables(spark, root)
    now = file_names(m.review)
    prints = seed_prints(m, whole_word)
    state = read_state(spark, root)
    counted = {r.file for r in state.files.toLocalIterator()} if state else set()
    if state is None or counted - now.keys():
        pairs = mention_totals(m.review, _of(m, prints), limits, whole_word)
        totals, keep = write_state(spark, root, pairs, now, prints)
        return UpToDate(totals, None, keep)
    same = prints.join(state.seeds, ["feature_id", "print"], "left_semi")
    changed = prints.join(state.seeds, ["feature_id", "print"], "left_anti")
    parts = [state.pairs.join(same.select("feature_id"), "feature_id", "left_semi").select(*state.pairs.columns)]
    touched = m.hotel.select("hotel_id").limit(0)
    added = sorted(now.keys() - counted)
    if added:
        new = spark.read.schema(S.REVIEW).parquet(*[now[name] for name in added])
        parts.append(mention_totals(new, _of(m, same), limits, whole_word))
        touched = new.select("hotel_id").distinct()
    if not changed.isEmpty():
        parts.append(mention_totals(m.review, _of(m, changed), limits, whole_word))
        touched = None
    # A feature that has gone leaves totals without a row in the grid.
    gone = not state.seeds.join(prints, "feature_id", "left_anti").isEmpty()
    if len(parts) == 1 and not gone:
        return UpToDate(state.pairs, touched, lambda: None)
    totals, keep = write_state(spark, root, merge_totals(*parts), now, prints)
    return UpToDate(totals, None if gone else touched, keep)
