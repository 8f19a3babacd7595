"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Everything runs as DataFrame expressions. Features come from the URL's text alone: lengths, depth, shares
of digits, entropies, counts of parameters, labels and signs, and statistics of the host's suffixes, which are
counted over all URLs. A suffix is hashed into one of ``BUCKETS`` slots, so the statistics have a fixed size
whatever hosts there are, and they travel as literal arrays instead of a join.

A tree is grown level by level: the sample's rows are summed per node, feature and bin on the executors, and the
driver picks the splits from these sums, whose number is bounded by nodes x features x bins. Sums are whole numbers
(gradients in 2^-20), so the model does not depend on the order of partial sums. Rows walk the trees, a
literal, by higher-order functions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.common import stored

#: verdict, rule. A rule is host/path; it fits the host and its subdomains where the path begins so.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs that teach the trees, about; their choice hangs on the row alone.
SAMPLE = 20_000
TREES, DEPTH, BINS = 15, 3, 32
RATE, PENALTY, LEAST_ROWS = 0.3, 1.0, 5
#: Slots of the suffix statistics, and the rows that a suffix's share of blocked URLs starts with.
BUCKETS, PRIOR = 4096, 20
_UNIT = 1 << 20
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty as the host is."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """verdict and rule of the longest rule that fits (of equal ones that with the longer host), or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        own, slash, begin = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + begin))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _entropy(text: Column) -> Column:
    """Bits a sign over letters (either case), digits and all other signs as one class."""
    n = F.length(text).cast("double")
    low = F.lower(text)
    xlogx = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    one = lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double")
    letters = F.split(F.lit(_ALPHABET), "")
    known = F.aggregate(letters, F.lit(0.0), lambda s, c: s + xlogx(one(c)))
    rest = F.length(F.translate(low, _ALPHABET, "")).cast("double")
    return F.when(n > 0, F.round(F.log2(n) - (known + xlogx(rest)) / n, 6)).otherwise(F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def lexical(urls: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the lexical features of ``url`` (see LEXICAL) and the slots of its suffixes."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = urls.select(*keep, url.alias("_u"), host_of(url).alias("_h"), path_of(url).alias("_p"))
    u, h, p = F.col("_u"), F.col("_h"), F.col("_p")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    digits = "0123456789"
    values = {
        "length": F.length(u), "host_length": F.length(h), "path_length": F.length(p),
        "query_length": F.length(query),
        "depth": F.size(F.filter(F.split(p, "/"), lambda s: s != "")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")),
        "labels": F.when(h != "", F.size(F.split(h, r"\."))).otherwise(0),
        "hyphens": _count(h, "-"), "escapes": _count(u, "%"),
        "capitals": _count(u, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digit_ratio": _share(_count(u, digits), F.length(u)), "host_digit_ratio": _share(_count(h, digits), F.length(h)),
        "entropy": _entropy(u), "host_entropy": _entropy(h),
        "suffix_length": F.length(F.substring_index(h, ".", -1)),
        "domain_length": F.length(F.substring_index(h, ".", -2)),
    }
    slots = [
        F.pmod(F.xxhash64(F.substring_index(h, ".", -k), F.lit(k)), F.lit(BUCKETS)).cast("int").alias(f"_slot{k}")
        for k in (1, 2)
    ]
    return parts.select(*keep, *[v.cast("double").alias(n) for n, v in values.items()], *slots)


LEXICAL = (
    "length", "host_length", "path_length", "query_length", "depth", "parameters", "labels", "hyphens", "escapes",
    "capitals", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "suffix_length", "domain_length",
)
#: Of the last label and of the last two: log2 of their share of all URLs, and the smoothed share of blocked ones.
SUFFIX = ("suffix_share", "suffix_blocked", "domain_share", "domain_blocked")
FEATURES = LEXICAL + SUFFIX


@dataclass(frozen=True)
class Tree:
    """A binary tree of DEPTH levels, the children of node k being 2k + 1 and 2k + 2. A row goes right at a node if its
    feature is above the cut; a node that is not split sends all rows left."""

    feature: tuple[int, ...]
    cut: tuple[float, ...]
    leaf: tuple[float, ...]


def _walk(values: str, tree: str, levels: int) -> str:
    """The node that a row reaches after so many levels; ``values``: its array of features."""
    return f"aggregate(sequence(1, {levels}), 0, (n, k) -> 2 * n + 1 + CAST({values}[{tree}.f[n]] > {tree}.c[n] AS int))"


def _literal(trees: Iterable[Tree]) -> str:
    """Trees as one literal. The compiled code of a query does not depend on it, so rounds share theirs."""
    rows = [{"f": t.feature, "c": t.cut, "v": t.leaf} for t in trees]
    return f"from_json('{json.dumps(rows)}', 'array<struct<f:array<int>,c:array<double>,v:array<double>>>')"


def _margin(values: str, base: float, trees: Iterable[Tree]) -> str:
    leaf = f"t.v[{_walk(values, 't', DEPTH)} - {(1 << DEPTH) - 1}]"
    return f"aggregate({_literal(trees)}, {base!r}D, (s, t) -> s + {leaf})"


@dataclass(frozen=True)
class UrlModel:
    """base + trees: log odds that a URL is to be blocked; suffix statistics by slot."""

    base: float
    trees: tuple[Tree, ...]
    statistics: dict[str, tuple[float, ...]]

    def margin(self) -> Column:
        """Log odds of a row with all features."""
        return F.expr(_margin(f"array({', '.join(FEATURES)})", self.base, self.trees))

    def features(self, urls: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and all features of ``url``."""
        rows = lexical(urls, *keep)
        for name in SUFFIX:
            table = F.split(F.lit(",".join(map(repr, self.statistics[name]))), ",").cast("array<double>")
            slot = F.col("_slot1" if name.startswith("suffix") else "_slot2")
            rows = rows.withColumn(name, F.get(table, slot))
        return rows.select(*keep, *FEATURES)


def _odds(rate: float) -> float:
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    return math.log(rate / (1 - rate))


def suffix_statistics(slots: DataFrame) -> tuple[dict[str, tuple[float, ...]], int, int]:
    """Statistics of both suffixes by slot, counted over all rows (y, _slot1, _slot2), and the numbers of
    labelled and blocked rows."""
    both = slots.select(
        "y", F.explode(F.array("_slot1", F.col("_slot2") + BUCKETS)).alias("slot")
    ).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("known"), F.sum("y").alias("blocked"))
    counted = {r["slot"]: (r["n"], r["known"], r["blocked"] or 0) for r in both.collect()}  # at most 2 * BUCKETS rows
    first = [v for k, v in counted.items() if k < BUCKETS]
    total, known, blocked = (sum(v[i] for v in first) for i in range(3))
    rate = blocked / known if known else 0.0
    out = {}
    for name, offset in (("suffix", 0), ("domain", BUCKETS)):
        mine = [counted.get(offset + k, (0, 0, 0)) for k in range(BUCKETS)]
        out[f"{name}_share"] = tuple(round(math.log2((n + 1) / (total + 1)), 6) for n, _, _ in mine)
        out[f"{name}_blocked"] = tuple(round((b + PRIOR * rate) / (k + PRIOR), 6) for _, k, b in mine)
    return out, known, blocked


def best_splits(sums: dict[tuple[int, int, int], tuple[int, int, int]], cuts: list[list[float]]):
    """node -> (feature, bin, left sums, right sums) of greatest gain, from (node, feature, bin) -> (rows, gradients,
    curvatures); nodes that no split improves are missing. Ties go to the first feature and bin."""
    out = {}
    for node in sorted({k[0] for k in sums}):
        best = (1e-9, None)
        for f in range(len(cuts)):
            bins = [sums.get((node, f, b), (0, 0, 0)) for b in range(len(cuts[f]) + 1)]
            whole = [sum(x[i] for x in bins) for i in range(3)]
            left = [0, 0, 0]
            for b in range(len(cuts[f])):
                left = [x + y for x, y in zip(left, bins[b])]
                right = [x - y for x, y in zip(whole, left)]
                if min(left[0], right[0]) < LEAST_ROWS:
                    continue
                gain = _gain(left) + _gain(right) - _gain(whole)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, b, tuple(left), tuple(right)))
        if best[1]:
            out[node] = best[1]
    return out


def _gain(sums) -> float:
    return (sums[1] / _UNIT) ** 2 / (sums[2] / _UNIT + PENALTY)


def _leaf(sums) -> float:
    return round(-RATE * (sums[1] / _UNIT) / (sums[2] / _UNIT + PENALTY), 9)


def fit(urls: DataFrame, sample: int = SAMPLE, trees: int = TREES) -> UrlModel:
    """A model from ``urls`` (url, y: 1 to be blocked, 0 to be let through, null unknown).

    Suffix statistics count every row. The trees learn from about ``sample`` labelled rows, all if there are
    fewer, chosen by a hash of page_id (if there is one) and url; equal rows of features count as one with a weight. Without
    labelled rows, or with one label only, there are no trees and the share of blocked rows decides.
    """
    given = urls.select(F.col("url").cast("string").alias("url"), F.col("y").cast("int").alias("y"), *_row_key(urls))
    statistics, known, blocked = suffix_statistics(lexical(given, "y").select("y", "_slot1", "_slot2"))
    base = round(_odds(blocked / known if known else 0.0), 9)
    model = UrlModel(base, (), statistics)
    if not 0 < blocked < known:
        return model
    labelled = given.where("y is not null")
    if known > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("_key", "url"), F.lit(1 << 30)) < int(sample / known * (1 << 30)))
    rows = stored(model.features(labelled, "y").groupBy("y", *FEATURES).agg(F.count(F.lit(1)).alias("w")), "url-sample")
    steps = F.array([F.lit(k / BINS) for k in range(1, BINS)])
    found = rows.agg(*[F.percentile(c, steps, F.col("w")).alias(c) for c in FEATURES]).first()
    cuts = [sorted(set(found[c])) for c in FEATURES]
    rows = stored(rows.select("y", "w", F.expr(f"array({', '.join(map(_bin, FEATURES, cuts))})").alias("bins")), "url-bins")
    # The sample is small: a sum per bin needs no shuffle within one task per SAMPLE rows.
    rows = rows.coalesce(-(-sample // SAMPLE))
    grown: list[Tree] = []
    for _ in range(trees):
        tree = _tree(rows, _margin("bins", base, grown), cuts)
        if tree is None:
            break
        grown.append(tree)
    return UrlModel(base, tuple(_with_cuts(tree, cuts) for tree in grown), statistics)


def _row_key(urls: DataFrame) -> list[Column]:
    return [(F.col("page_id") if "page_id" in urls.columns else F.lit(0)).cast("bigint").alias("_key")]


def _bin(feature: str, cuts: list[float]) -> str:
    """Number of cuts below a feature."""
    return f"CAST(size(filter(array({', '.join(f'{c!r}D' for c in cuts)}), c -> {feature} > c)) AS double)"


def _tree(rows: DataFrame, margin: str, cuts: list[list[float]]) -> Tree | None:
    """One tree, its cuts in bins, on the gradients of the logistic loss at ``margin``; None if no split helps."""
    graded = rows.selectExpr("w", "y", "bins", f"1 / (1 + exp(-({margin}))) AS chance").selectExpr(
        "w", "bins", f"CAST(round((chance - y) * {_UNIT}) AS bigint) * w AS g",
        f"CAST(round(chance * (1 - chance) * {_UNIT}) AS bigint) * w AS h",
    )
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, cut, leaf = [0] * inner, [float(BINS)] * inner, [0.0] * leaves
    nodes = [0]
    for level in range(DEPTH):
        grown = _literal([Tree(tuple(feature), tuple(cut), ())])
        node = _walk("bins", f"{grown}[0]", level) if level else "0"
        at = graded.selectExpr(f"{node} AS node", "w", "g", "h", "posexplode(bins) AS (f, b)")
        sums = at.where(F.col("node").isin(nodes)).groupBy("node", "f", "b").agg(F.sum("w"), F.sum("g"), F.sum("h"))
        # At most 2^(DEPTH - 1) nodes x features x BINS rows.
        found = best_splits({(r[0], r[1], int(r[2])): tuple(r)[3:] for r in sums.collect()}, cuts)
        nodes = []
        for k, (f, b, left, right) in found.items():
            feature[k], cut[k] = f, float(b)
            for child, own in ((2 * k + 1, left), (2 * k + 2, right)):
                nodes.append(child)
                for _ in range(level + 1, DEPTH):  # where its rows end if it is not split
                    child = 2 * child + 1
                leaf[child - inner] = _leaf(own)
        if not nodes:
            break
    return Tree(tuple(feature), tuple(cut), tuple(leaf)) if cut[0] < BINS else None


def _with_cuts(tree: Tree, cuts: list[list[float]]) -> Tree:
    """Values in place of the bins."""
    pairs = zip(tree.feature, tree.cut)
    return Tree(tree.feature, tuple(cuts[f][int(b)] if b < BINS else 1e300 for f, b in pairs), tree.leaf)


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, url, host, path, and the verdict and rule that the rules give, if any."""
    url = F.col("url").cast("string")
    some = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    some = some.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return some.select("page_id", "url", "host", "path", F.col("found.verdict").alias("ruled"), F.col("found.rule").alias("rule"))


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE
) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages`` (page_id, url).

    The longest rule that fits gives the verdict. Elsewhere the trees do: block at a score (chance of being one to
    block) above 0.5, else allow. They learn from ``labelled`` (url, y) or, without it, from the URLs that the rules
    judge; their score is given for every row. A null url, or one without ``://``, has an empty host and path, fits
    no rule and is scored as it is. Repeated rows are rows of their own, rows without page_id are judged like others. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    ruled = with_rules(pages, rules)
    known = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    learn = ruled.select("page_id", "url", (known if labelled is None else F.lit(None).cast("int")).alias("y"))
    if labelled is not None:
        learn = learn.unionByName(labelled.select(F.lit(None).cast("bigint").alias("page_id"), "url", "y"))
    model = fit(learn, sample)
    scored = model.features(ruled, "page_id", "host", "path", "rule", "ruled")
    scored = scored.withColumn("score", 1 / (1 + F.exp(-model.margin())))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
