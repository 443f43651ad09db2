"""URL filter: path rules first, gradient-boosted trees on lexical features for the rest.

Only DataFrame functions are used. Training is histogram boosting with logistic loss: features are cut into few bins, labelled
rows with equal bins are summed into one row with a weight, and each tree level is one aggregation of gradients by node,
feature and bin; the driver sees only that histogram (nodes x features x bins), picks the splits and writes the tree as a
CASE expression.

Suffix statistics are target-encoded features: smoothed block rates, among the labelled URLs, of the host's last label, of its last two
and of the path's first segment, whole and however rare. A training row gets the rates of the other ``FOLDS - 1`` folds of URLs, so no row sees
its own label. The rates lie in tables of (hashed key, rate), which are joined; there are at most as many keys as rows in the training
sample, at most about ``2 * fit_rows`` and 16 bytes each, so they are broadcast. Keys that the sample lacks get the prior.

Cases. Null url or no ``://``: host and path empty, no rule, judged by the trees like any other. Repeated rows are
judged alike. Very long urls are read whole. Without labelled URLs of both classes the verdict is the class there is, or
``allow``. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.text import unit_hash
from provena.runtime import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: the rules of the query
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (the first given on equal length), else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    distinct = F.array_distinct(chars)
    n = F.length(text).cast("double")
    share = F.transform(distinct, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    query = F.regexp_extract(text, r"(?s)\A[^?#]*\?([^#]*)", 1)
    digits = n - F.length(F.regexp_replace(text, "[0-9]", ""))
    signs = F.length(F.regexp_replace(text, "[A-Za-z0-9]", ""))

    def per_char(x: Column) -> Column:
        return F.when(n > 0, x / n).otherwise(0.0)

    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "host_labels": F.when(host == "", 0.0).otherwise((F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1).cast("double")),
        "host_hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "digit_ratio": per_char(digits),
        "sign_ratio": per_char(signs),
        "entropy": entropy(text),
        "host_entropy": entropy(host),
        "parameters": F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")),
        "fragment": text.contains("#").cast("double"),
        "secure": text.startswith("https:").cast("double"),
    }


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _section(path: Column) -> Column:
    """First path segment, whole: with the suffix, where on a site a page lies."""
    return F.regexp_extract(path, r"(?s)\A/([^/]+)/", 1)


STATISTICS = {"tld": lambda h, p: _suffix(h, 1), "site": lambda h, p: _suffix(h, 2), "section": lambda h, p: _section(p)}
#: folds of URLs for out-of-fold rates; rows of the prior that smooth a rate
FOLDS, SMOOTH = 5, 20.0


@dataclass
class UrlModel:
    base: float
    trees: list[str] = field(default_factory=list)  # SQL expressions over the features
    cuts: dict[str, list[float]] = field(default_factory=dict)
    rates: dict[str, DataFrame] = field(default_factory=dict)  # by statistic: hashed key, rate
    prior: float = 0.5

    def with_features(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with url, host, path) and a column a feature."""
        host, path = F.col("host"), F.col("path")
        out = rows.select("*", *[c.cast("double").alias(n) for n, c in lexical_features(F.col("url"), host, path).items()])
        for name, key in STATISTICS.items():
            table = self.rates[name].select(F.col("key").alias(f"{name}_key"), F.col("rate").alias(f"{name}_known"))
            joined = out.join(F.broadcast(table), F.xxhash64(key(host, path)) == F.col(f"{name}_key"), "left")
            out = joined.withColumn(f"{name}_rate", F.coalesce(f"{name}_known", F.lit(self.prior))).drop(f"{name}_key", f"{name}_known")
        return out

    def margin(self) -> Column:
        """Log-odds of block, over columns named like the features."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + F.expr(tree)
        return total


def feature_names() -> list[str]:
    blank = F.lit("")
    return [*lexical_features(blank, blank, blank), *[f"{n}_rate" for n in STATISTICS]]


def _sample(labelled: DataFrame, n1: int, n0: int, fit_rows: int) -> DataFrame:
    """Rows ``url, host, path, block``; each url keeps its share of its copies, rounded up or down by its hash."""
    if fit_rows >= max(n1, n0):
        return labelled.select("url", "host", "path", "block")
    share = F.when(F.col("block") == 1, min(1.0, fit_rows / n1)).otherwise(min(1.0, fit_rows / n0))
    # the sample's copies of a url: their expectation is share times all of them
    copies = F.floor(F.count(F.lit(1)) * F.first("share") + unit_hash(F.col("url"), seed=7)).cast("int")
    distinct = labelled.withColumn("share", share).groupBy("url", "host", "path", "block").agg(copies.alias("copies"))
    return distinct.withColumn("nth", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "nth")


def _rate(s: Column, n: Column, prior: float) -> Column:
    return (s + F.lit(SMOOTH * prior)) / (n + F.lit(SMOOTH))


def fit(labelled: DataFrame, trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.4, fit_rows: int = 20_000, ridge: float = 1.0) -> UrlModel:
    """Learn from ``url, host, path, block`` (block 0 or 1): a sample of at most about ``fit_rows`` rows a class, by hash.

    A hot url stays at its part of the rows. Rows weigh by the full class sizes, from which the prior comes too.
    """
    sizes = {r["block"]: r["n"] for r in labelled.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return UrlModel(base=1.0 if n1 else -1.0)
    fold = F.pmod(F.xxhash64(F.lit(77), F.col("url")), F.lit(FOLDS)).cast("int")
    sample = materialize(_sample(labelled, n1, n0, fit_rows).withColumn("fold", fold), "url-sample")
    drawn = {r["block"]: r["n"] for r in sample.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = sum(drawn.values()) / (n1 + n0)
    # 1 for all rows unless a class is sampled; the weights sum to the sample's size
    heavy = {k: n * scale / max(drawn.get(k, 0), 1) for k, n in ((1, n1), (0, n0))}
    weight = F.when(F.col("block") == 1, heavy[1]).otherwise(heavy[0])
    model = UrlModel(base=0.0)
    model.prior = n1 / (n1 + n0)
    model.base = math.log(max(model.prior, 1e-6) / max(1 - model.prior, 1e-6))
    out = sample.select("*", *[c.cast("double").alias(n) for n, c in lexical_features(F.col("url"), F.col("host"), F.col("path")).items()])
    keys = {name: F.xxhash64(key(F.col("host"), F.col("path"))) for name, key in STATISTICS.items()}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), key.alias("key")) for name, key in keys.items()]))
    by_fold = sample.select("fold", "block", each.alias("k")).groupBy("k.name", "k.key", "fold").agg(F.sum(weight).alias("n"), F.sum(F.col("block") * weight).alias("s"))
    by_fold = materialize(by_fold, "url-folds")
    whole = by_fold.groupBy("name", "key").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    whole = materialize(whole.withColumn("rate", _rate(F.col("all_s"), F.col("all_n"), model.prior)), "url-rates")
    for name, hashed in keys.items():
        model.rates[name] = whole.filter(F.col("name") == name).select("key", "rate")
        # a fold's own rows leave the sums; at most a row a key and fold, so no larger than the sample
        others = by_fold.filter(F.col("name") == name).join(F.broadcast(whole), ["name", "key"])
        rate_there = _rate(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n"), model.prior)
        others = others.select(F.col("key").alias(f"{name}_key"), F.col("fold").alias(f"{name}_fold"), rate_there.alias(f"{name}_rate"))
        out = out.join(F.broadcast(others), (hashed == F.col(f"{name}_key")) & (F.col("fold") == F.col(f"{name}_fold")), "left")
    names = feature_names()
    rows = materialize(out.select("block", *[F.coalesce(n, F.lit(model.prior)).alias(n) for n in names]), "url-features")
    discard(sample)
    steps = [i / bins for i in range(1, bins)]
    quantiles = rows.agg(*[F.percentile_approx(n, steps, 2000).alias(n) for n in names]).first()
    model.cuts = {n: sorted(set(quantiles[n] or [])) for n in names}

    def binned(name: str) -> Column:
        out = F.lit(0)
        for cut in model.cuts[name]:
            out = out + (F.col(name) > cut).cast("int")
        return out

    cells = materialize(rows.groupBy(*[binned(n).alias(f"b_{n}") for n in names]).agg(F.sum(weight).alias("w"), F.sum(F.col("block") * weight).alias("y")), "url-cells")
    discard(rows)
    state = cells.withColumn("f", F.lit(model.base))
    for t in range(trees):
        nodes: dict[int, tuple[str, int] | float] = {}
        node = F.lit(1)
        frontier = [1]
        p = 1 / (1 + F.exp(-F.col("f")))
        graded = state.withColumn("g", F.col("y") - F.col("w") * p).withColumn("h", F.col("w") * p * (1 - p))
        for level in range(depth + 1):
            long = graded.withColumn("node", node).filter(F.col("node").isin(frontier))
            pairs = F.posexplode(F.array(*[F.col(f"b_{n}") for n in names]))
            hist = long.select("node", "g", "h", pairs.alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            tables: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in hist:
                tables.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
            nxt = []
            for at in frontier:
                found = _best_split(tables.get(at, {}), ridge) if level < depth else None
                if found is None:
                    g = sum(x[0] for x in tables.get(at, {}).get(0, {}).values())
                    h = sum(x[1] for x in tables.get(at, {}).get(0, {}).values())
                    nodes[at] = rate * g / (h + ridge)
                else:
                    nodes[at] = (names[found[0]], found[1])
                    nxt += [2 * at, 2 * at + 1]
            if not nxt:
                break
            for at in frontier:
                if isinstance(nodes[at], tuple):
                    name, bin_ = nodes[at]
                    node = F.when(node == at, F.when(F.col(f"b_{name}") <= bin_, 2 * at).otherwise(2 * at + 1)).otherwise(node)
            frontier = nxt
        model.trees.append(_as_sql(nodes, 1, lambda n, b: f"`{n}` <= {model.cuts[n][b]!r}D"))
        grown = state.withColumn("f", F.col("f") + F.expr(_as_sql(nodes, 1, lambda n, b: f"`b_{n}` <= {b}")))
        # a cut of the lineage every few trees keeps plans short
        state = materialize(grown, "url-state") if t % 4 == 3 and t + 1 < trees else grown
    return model


def _best_split(tables: dict[int, dict[int, tuple[float, float]]], ridge: float) -> tuple[int, int] | None:
    best, choice = 1e-6, None
    for feature in sorted(tables):
        cells = tables[feature]
        g, h = sum(x[0] for x in cells.values()), sum(x[1] for x in cells.values())
        left_g = left_h = 0.0
        for b in sorted(cells)[:-1]:
            left_g += cells[b][0]
            left_h += cells[b][1]
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            if gain > best + 1e-9 * abs(best) and min(left_h, h - left_h) > 1e-3:
                best, choice = gain, (feature, b)
    return choice


def _as_sql(nodes: dict[int, tuple[str, int] | float], at: int, test) -> str:
    here = nodes[at]
    if not isinstance(here, tuple):
        return f"{here!r}D"
    return f"CASE WHEN {test(*here)} THEN {_as_sql(nodes, 2 * at, test)} ELSE {_as_sql(nodes, 2 * at + 1, test)} END"


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, **how) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``.

    ``labelled`` has ``url, block``; by default the URLs that rules decide are the labelled ones. ``score`` is the trees'
    probability of block, for every row.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("rule", text).withColumn("by_rule", verdict)
    if labelled is None:
        known = ruled.filter("rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").cast("int").alias("block"))
    else:
        block = F.col("block").cast("int").alias("block")
        known = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), block).filter("block is not null")
    model = fit(known, **how)
    scored = (model.with_features(ruled) if model.trees else ruled).withColumn("margin", model.margin())
    own = F.when(F.col("margin") >= 0, "block").otherwise("allow")
    chance = 1 / (1 + F.exp(-F.col("margin")))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), chance.alias("score"))
