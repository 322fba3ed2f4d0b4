"""URL filter: rules first, then gradient-boosted trees on lexical features, all in DataFrame functions.

The trees are grown from URLs that rules decide, but for those of some hosts, which are held out to measure them by. How often URLs of a suffix are blocked is
a feature as well; of a URL that trees are grown from, it leaves out the URLs of hosts in the same fold, so that no URL tells its own label. Labelled URLs are reduced to counts per vector of feature bins; each
level of a tree is one grouped sum of gradients by (node, feature, bin), of which a bounded table goes to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphora.llm._common import written

#: (verdict, host, path) of each rule; the longest that fits wins. Fixed values of the task.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Trees, their depth, step size, and ridge of leaf values.
TREES, DEPTH, RATE, RIDGE = 12, 3, 0.3, 1.0
#: Folds that hosts are dealt to; those of fold 0 are held out.
FOLDS = 5
#: Upper ends of the bins of each feature (the last bin is open).
EDGES = {
    "length": [20, 25, 30, 35, 40, 50, 60, 80, 120, 250],
    "host_length": [8, 12, 16, 18, 20, 22, 25, 30, 45],
    "path_length": [0, 1, 4, 6, 8, 10, 14, 20, 40, 80],
    "depth": [0, 1, 2, 3, 4, 6, 9],
    "labels": [1, 2, 3, 4, 5],
    "hyphens": [0, 1, 2, 4],
    "digit_ratio": [0.0, 0.03, 0.06, 0.09, 0.12, 0.16, 0.25, 0.4],
    "entropy": [1.0, 2.0, 2.5, 2.8, 3.0, 3.2, 3.4, 3.6, 3.8, 4.2],
    "params": [0, 1, 2, 3, 5],
    "query_length": [0, 8, 16, 30, 60, 120],
    "suffix_share": [-9.0, -7.0, -5.0, -3.5, -2.5, -1.8, -1.2, -0.7],
    "suffix_rate": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95],
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, without user and port."""
    return F.substring_index(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), ".", -1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> tuple[Column, Column]:
    """The longest rule that fits host (or a domain above it) and path, as text, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for word, own, start in sorted(RULES if rules is None else rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text).cast("double")
    part = lambda c: (size - F.length(F.replace(text, c))) / size
    return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - part(c) * F.log2(part(c)))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that the URL alone gives; a null URL counts as empty."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    return {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"))),
        "labels": F.length(host) - F.length(F.replace(host, F.lit("."))) + 1,
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"))),
        "digit_ratio": F.when(F.length(u) > 0, digits / F.length(u)).otherwise(0.0),
        "entropy": _entropy(host),
        "params": F.when(query == "", 0).otherwise(F.length(query) - F.length(F.replace(query, F.lit("&"))) + 1),
        "query_length": F.length(query),
    }


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    return F.coalesce(reduce(lambda a, e: a + (value > F.lit(float(e))).cast("int"), edges, F.lit(0)), F.lit(0)).cast("int")


def _margin(trees: list, bins: dict[str, Column]) -> Column:
    def value(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        name, at, low, high = node
        return F.when(bins[name] <= at, value(low)).otherwise(value(high))

    return reduce(lambda a, t: a + value(t), trees, F.lit(0.0))


def _score(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def grow(counts: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH) -> list:
    """counts (one int column per feature bin, n, blocked) -> trees as nested (feature, bin, low, high) or leaf values.

    The prior log-odds are the first, single-leaf tree. Ties between splits go to the first feature and bin.
    """
    total = counts.agg(F.sum("n"), F.sum("blocked")).first()
    n, blocked = float(total[0] or 0), float(total[1] or 0)
    if not blocked or blocked == n:  # nothing to tell apart
        return [20.0 if blocked else -20.0]
    forest: list = [math.log(blocked / (n - blocked))]
    bins = {c: F.col(c) for c in names}
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("b")) for k, c in enumerate(names)]))
    for _ in range(trees):
        p = 1.0 / (1.0 + F.exp(-_margin(forest, bins)))
        rows = counts.withColumns({"g": F.col("n") * p - F.col("blocked"), "h": F.col("n") * p * (1.0 - p)})
        splits: dict[tuple, tuple] = {}
        leaves: dict[tuple, tuple[float, float]] = {}
        open_: list[tuple] = [()]
        for level in range(depth):
            place = F.lit(None).cast("int")
            for k, way in enumerate(open_):
                inside = reduce(lambda a, s: a & ((bins[splits[way[:s]][0]] <= splits[way[:s]][1]) == F.lit(way[s] == 0)), range(len(way)), F.lit(True))
                place = F.when(inside, k).otherwise(place)
            held = rows.select(place.alias("node"), "g", "h", pair.alias("x")).where("node is not null")
            sums: dict[int, dict[int, list]] = {}
            for r in held.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x bins
                sums.setdefault(r.node, {}).setdefault(r.f, []).append((r.b, r.g, r.h))
            after: list[tuple] = []
            for k, by in sums.items():
                g, h = (math.fsum(x[i] for x in by[0]) for i in (1, 2))
                best = None
                for f in sorted(by):
                    low_g = low_h = 0.0
                    for b, x, y in sorted(by[f])[:-1]:
                        low_g, low_h = low_g + x, low_h + y
                        gain = _score(low_g, low_h) + _score(g - low_g, h - low_h) - _score(g, h)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = gain, names[f], b, (low_g, low_h), (g - low_g, h - low_h)
                leaves[open_[k]] = g, h
                if best:
                    splits[open_[k]] = best[1:3]
                    for side in (0, 1):
                        leaves[open_[k] + (side,)] = best[3 + side]
                        after.append(open_[k] + (side,))
            open_ = after if level + 1 < depth else []
            if not open_:
                break

        def node(way: tuple):
            if way in splits:
                return (*splits[way], node((*way, 0)), node((*way, 1)))
            g, h = leaves[way]
            return -RATE * g / (h + RIDGE)

        forest.append(node(()))
    return forest


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict (allow or block), score double (of being blocked), held_out boolean.

    Where no rule fits, the verdict is block from a score of 0.5. If rules decide no URL, or all alike, then it is theirs
    (allow, if none). One row per row, whatever its page_id; null and malformed URLs have empty host and path; long ones are read whole. held_out: URLs of its host train nothing, whatever rules say
    of them; if no others are decided, they train after all.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "suffix": suffix_of(F.col("host")), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")})
    blocked = F.sum((F.col("ruled") == "block").cast("int"))
    by_fold = written(rows.groupBy("suffix", "fold").agg(F.count("*").alias("n"), blocked.alias("b"), F.count("ruled").alias("r")), "suffixes")
    total, trains = by_fold.agg(F.sum("n"), F.sum(F.when(F.col("fold") > 0, F.col("r")))).first()
    least = 1 if trains else 0  # the first fold that trains
    told = F.when(F.col("fold") >= least, F.struct(F.coalesce("b", F.lit(0)).alias("b"), "r"))
    all_ = by_fold.groupBy("suffix").agg(
        F.log(F.sum("n") / float(total or 1)).alias("suffix_share"), F.coalesce(F.sum(told["b"]), F.lit(0)).alias("b"), F.coalesce(F.sum(told["r"]), F.lit(0)).alias("r"),
        F.map_from_entries(F.collect_list(F.struct("fold", told.alias("told")))).alias("folds"),
    )  # FOLDS entries at most
    rows = rows.join(all_, "suffix", "left")
    own = F.when(F.col("ruled").isNotNull(), F.try_element_at("folds", "fold"))
    rate = (F.col("b") - F.coalesce(own["b"], F.lit(0)) + 1.0) / (F.col("r") - F.coalesce(own["r"], F.lit(0)) + 2.0)
    found = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_share": F.col("suffix_share"), "suffix_rate": rate}
    rows = rows.select("page_id", "host", "path", "rule", "ruled", "fold", *[_bin(v, EDGES[c]).alias(f"bin_{c}") for c, v in found.items()])
    names = [f"bin_{c}" for c in found]
    counts = rows.where(F.col("ruled").isNotNull() & (F.col("fold") >= least)).groupBy(*names).agg(F.count("*").alias("n"), blocked.alias("blocked"))
    forest = grow(written(counts, "bins"), names)
    p = 1.0 / (1.0 + F.exp(-_margin(forest, {c: F.col(c) for c in names})))
    by_score = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.withColumn("score", p).select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score", (F.col("fold") < least).alias("held_out"))
