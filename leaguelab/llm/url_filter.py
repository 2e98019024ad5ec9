"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and aggregates. A boosting level is one grouped sum over the
training rows, by tree node, feature and bin; the driver sees those sums only (at most
nodes x features x bins rows) and picks the splits. Gradients are summed as integers, so the model
does not depend on partitions or on the order of rows. The finished trees are one expression over
the raw features and run inside the scan of the pages.

Defined cases: a null URL or one without ``://`` has an empty host and path and matches no rule; its
features are those of an empty text; URLs of any length are read whole; repeated rows are judged
each; without labelled rows of both kinds the trees are a constant (allow without any block); an
empty table gives an empty result; other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SCALE = 1 << 20
FEATURES = [
    "length", "host_length", "path_length", "depth", "subdomains", "digit_ratio", "host_digits",
    "hyphens", "entropy", "host_entropy", "parameters", "query_length", "first_segment", "has_fragment",
    "last_segment_length", "suffix_rate", "suffix_count",
]


def split_url(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with host, path and _rest (what follows the host)."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    df = df.withColumn("_after", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_after", r"^([^/?#]*)", 1)
    tail = F.substr("_after", F.length(host) + 1)
    return df.withColumns(
        {
            "host": F.translate(host, _UPPER, _UPPER.lower()),
            "path": F.regexp_extract(tail, r"^([^?#]*)", 1),
            "_rest": tail,
        }
    )


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """(text, action) of the longest rule that fits the columns host and path, or nulls."""
    text = action = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        own = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        fits = own & F.startswith(F.col("path"), F.lit(r.path))
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        action = F.when(fits, r.action) if action is None else action.when(fits, r.action)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text.otherwise(none), action.otherwise(none))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    bits = F.aggregate(
        letters,
        F.lit(0.0),
        lambda a, c: a + (n - F.length(F.replace(text, c, F.lit("")))) / n
        * F.log2((n - F.length(F.replace(text, c, F.lit("")))) / n),
    )
    return F.when(n > 0, -bits).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical_features(df: DataFrame, url_col: str) -> DataFrame:
    """Adds a double column ``f_<name>`` for each lexical feature, and _suffix.

    ``df`` has host, path and _rest.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract("_rest", r"\?([^#]*)", 1)
    length = F.length(url)
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    first = F.coalesce(F.try_element_at(segments, F.lit(2)), F.lit(""))
    values = {
        "length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "subdomains": _count(host, "[.]"),
        "digit_ratio": F.when(length > 0, _count(url, "[0-9]") / length).otherwise(0.0),
        "host_digits": _count(host, "[0-9]"),
        "hyphens": _count(host, "-"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": _count(query, "[^&=]+="),
        "query_length": F.length(query),
        # The place of the first path segment in the alphabet, by its first two letters.
        "first_segment": F.ascii(first) * 256 + F.ascii(F.substring(first, 2, 1)),
        "has_fragment": F.contains(F.col("_rest"), F.lit("#")).cast("int"),
        "last_segment_length": F.length(last),
    }
    return df.withColumns(
        {f"f_{k}": v.cast("double") for k, v in values.items()}
        | {"_suffix": F.element_at(F.split(host, "[.]"), -1)}
    )


@dataclass
class Trees:
    """Boosted trees; a node is (feature, threshold, left, right) or a leaf value."""

    start: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _tree_column(tree, 0)
        return total


def _tree_column(tree: dict, at: int) -> Column:
    node = tree[at]
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, threshold = node
    return F.when(
        F.col(f"f_{feature}") > F.lit(threshold), _tree_column(tree, 2 * at + 2)
    ).otherwise(_tree_column(tree, 2 * at + 1))


def _node_column(tree: dict, at: int, depth: int) -> Column:
    node = tree.get(at)
    if depth == 0 or not isinstance(node, tuple):
        return F.lit(at)
    feature, threshold = node
    return F.when(
        F.col(f"f_{feature}") > F.lit(threshold), _node_column(tree, 2 * at + 2, depth - 1)
    ).otherwise(_node_column(tree, 2 * at + 1, depth - 1))


def fit_trees(
    rows: DataFrame, trees: int = 10, depth: int = 3, rate: float = 0.4, bins: int = 16, ridge: float = 1.0
) -> Trees:
    """Logistic boosting on ``rows`` (f_<name> columns and label 0 or 1)."""
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or not 0 < ones < n:
        return Trees(0.0 if not n else 9.0 if ones else -9.0)
    cuts = rows.agg(
        *[
            F.percentile_approx(f"f_{f}", [k / bins for k in range(1, bins)], 10_000).alias(f)
            for f in FEATURES
        ]
    ).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    rows = rows.withColumns({f"b_{f}": _bin(F.col(f"f_{f}"), cuts[f]) for f in FEATURES})
    model = Trees(math.log(ones / (n - ones)))
    for count in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        grads = written(
            rows.withColumn("_p", p).withColumns(
                {
                    "_g": F.round((F.col("label") - F.col("_p")) * _SCALE).cast("long"),
                    "_h": F.round(F.col("_p") * (1 - F.col("_p")) * _SCALE).cast("long"),
                }
            ),
            "boosting",
        )
        tree: dict = {}
        for level in range(depth + 1):
            cells = grads.select(
                _node_column(tree, 0, level).alias("node"), "_g", "_h",
                F.explode(
                    F.array(
                        *[
                            F.struct(
                                F.lit(k).alias("feature"),
                                F.col(f"b_{f}").alias("bin"),
                            )
                            for k, f in enumerate(FEATURES)
                        ]
                    )
                ).alias("x"),
            )
            sums: dict = {}
            for r in (
                cells.groupBy("node", "x.feature", "x.bin")
                .agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
            ):
                sums.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (
                    r["g"] / _SCALE, r["h"] / _SCALE,
                )
            for node, by_feature in sorted(sums.items()):
                if node < 2**level - 1:
                    continue
                split = _best_split(by_feature, cuts, ridge) if level < depth else None
                total = by_feature[0].values()
                g, h = sum(x for x, _ in total), sum(x for _, x in total)
                tree[node] = split if split else rate * g / (h + ridge)
            if not any(isinstance(v, tuple) for k, v in tree.items() if k >= 2**level - 1):
                break
        for node in [k for k, v in tree.items() if isinstance(v, tuple)]:
            for child in (2 * node + 1, 2 * node + 2):
                tree.setdefault(child, 0.0)
        model.trees.append(tree)
    return model


def _bin(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: value > c))


def _best_split(by_feature: dict, cuts: dict, ridge: float) -> tuple | None:
    """(feature, threshold) of the largest gain, the first of equal ones."""
    best, found = 1e-6, None
    for k, f in enumerate(FEATURES):
        cells = by_feature.get(k, {})
        g_all, h_all = sum(g for g, _ in cells.values()), sum(h for _, h in cells.values())
        g = h = 0.0
        for b, cut in enumerate(cuts[f]):
            dg, dh = cells.get(b, (0.0, 0.0))
            g, h = g + dg, h + dh
            if h < 1.0 or h_all - h < 1.0:
                continue
            gain = (
                g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge)
                - g_all * g_all / (h_all + ridge)
            )
            if gain > best + 1e-9:
                best, found = gain, (f, float(cut))
    return found


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None,
    rules: list[Rule],
    most_rows: int = 20_000,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every page.

    ``labelled``: url and label (1 = block) to train from; without it the URLs that a rule decides
    are the labelled ones. The first ``most_rows`` by a hash of the URL are used.
    """
    pages = split_url(
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "url"
    )
    text, action = rule_of(rules)
    ruled = pages.withColumns({"rule": text, "_action": action})
    if labelled is None:
        known = ruled.where("_action IS NOT NULL AND url IS NOT NULL").select(
            "url", (F.col("_action") == "block").cast("int").alias("label")
        )
    else:
        known = labelled.where("label IS NOT NULL AND url IS NOT NULL").select(
            F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")
        )
    sample = known.orderBy(F.xxhash64("url"), "url", "label").limit(most_rows)
    sample = written(lexical_features(split_url(sample, "url"), "url"), "labelled-urls")
    # Bounded by the sample, so it can be sent to every task. Smoothed towards the mean.
    mean = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    suffixes = sample.groupBy("_suffix").agg(
        ((F.sum("label") + 20 * mean) / (F.count("*") + 20)).alias("f_suffix_rate"),
        F.log1p(F.count("*")).alias("f_suffix_count"),
    )
    suffixes = written(suffixes, "suffixes")

    def with_suffix(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(suffixes), "_suffix", "left").fillna(
            {"f_suffix_rate": float(mean), "f_suffix_count": 0.0}
        )

    train = written(
        with_suffix(sample).select("label", *[f"f_{f}" for f in FEATURES]), "labelled-features"
    )
    model = fit_trees(train)
    scored = with_suffix(lexical_features(ruled, "url")).withColumn("_margin", model.margin())
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_action", F.when(F.col("_margin") > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-F.col("_margin")))).alias("block_score"),
    )
