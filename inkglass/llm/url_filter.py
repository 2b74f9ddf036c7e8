"""URL filters: explicit rules, and for all other addresses a tree of path templates.

The tree is learned from addresses whose verdict is known. Per host, a path's segments are
generalised: segments that vary freely become wildcards, and branches under one parent that
lead on in statistically similar ways become one, unless their labels differ. A template is
rejected where the share of blocked addresses under it is high, smoothed towards its
parent's and towards that of the same paths on all hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stash
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths that begin so."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: How many segments of a path make levels of the tree; what follows is one last segment.
DEPTH = 6


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    """What stands between the host and ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null.

    Rules are configuration, so they are part of the expression. Of rules of equal length
    the first by text wins, and of two with the same text the one that blocks.
    """
    order = sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict != "block"))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column, depth: int = DEPTH) -> Column:
    """A path's segments; those from ``depth`` on stay one segment, so no path makes more."""
    return F.split(F.regexp_replace(path, "^/", ""), "/", depth)


# Shapes that always vary, and the wildcard that stands for them.
SHAPES = ((r"^[0-9]+$", "{n}"), (r"^[0-9]+(\.[A-Za-z]{1,5})$", "{n}$1"), (r"^[0-9a-fA-F-]{16,}$", "{h}"), (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{d}"))
ANY = "*"
#: How far sums of shares may be off.
ROUNDING = 1e-9


def shape(segment: Column) -> Column:
    for pattern, wildcard in SHAPES:
        segment = F.regexp_replace(segment, pattern, wildcard)
    return segment


def _labelled(addresses: DataFrame, depth: int, weight: float) -> tuple[DataFrame, float]:
    """Distinct ``host, segs`` with counts of all and of blocked, known addresses; and the share of blocked ones.

    ``shared`` holds, for each of ``segs``, the purity of the path so far over all hosts,
    (blocked + weight * the share) / (known + weight), or null where nothing is known.
    """
    known, bad = F.count("verdict"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0))
    segs = F.transform(segments(F.col("path"), depth), shape)
    rows = addresses.select("host", segs.alias("segs"), "verdict").groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), known.alias("known"), bad.alias("bad"))
    rows = stash(rows.withColumn("id", F.md5(F.to_json(F.struct("host", "segs")).cast("binary"))), "url-paths")
    all_known, all_bad = rows.agg(F.sum("known"), F.sum("bad")).first()
    share = all_bad / all_known if all_known else 0.0
    level = F.explode(F.sequence(F.lit(1), F.size("segs"))).alias("level")
    prefix = F.array_join(F.slice("segs", F.lit(1), F.col("level")), "/").alias("prefix")
    steps = rows.select("id", "segs", "known", "bad", level).select("id", "level", prefix, "known", "bad")
    pooled = steps.filter("known > 0").groupBy("prefix").agg(((F.sum("bad") + weight * share) / (F.sum("known") + weight)).alias("purity"))
    met = steps.select("id", "level", F.col("prefix").alias("_p")).join(pooled, F.col("_p") == F.col("prefix"), "left")
    listed = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "purity"))).alias("_l"))
    listed = listed.select(F.col("id").alias("_id"), F.transform("_l", lambda x: x["purity"]).alias("shared"))
    return stash(rows.join(listed, F.col("id") == F.col("_id")).drop("_id", "id"), "url-rows"), share


def _overlapping(pairs: DataFrame, dist: DataFrame, alike: float) -> DataFrame:
    """Those of the pairs ``a, b`` of nodes whose distributions overlap by ``alike`` at least."""
    one = dist.select(F.col("id").alias("a"), F.col("next").alias("_n"), F.col("share").alias("_s"))
    both = pairs.join(one, "a").join(dist.select(F.col("id").alias("b"), F.col("next").alias("_m"), "share"), "b").filter("_n = _m")
    return both.groupBy("a", "b").agg(F.sum(F.least("_s", "share")).alias("overlap")).filter(F.col("overlap") >= alike - ROUNDING).select("a", "b")


def _labels(links: DataFrame, few: int = 50_000) -> DataFrame:
    """``id, label`` of the nodes that have a link; a few links are followed on the driver, more in rounds over tables."""
    held = links.limit(few + 1).collect()
    if len(held) > few:
        return connected_components(links)
    up: dict[str, str] = {}

    def least(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in held:
        a, b = least(a), least(b)
        up[max(a, b)] = min(a, b)
    return links.sparkSession.createDataFrame([(x, least(x)) for x in list(up)], "id string, label string")


def _like_branches(shares: DataFrame, branches: DataFrame, alike: float) -> DataFrame | None:
    """``id, label``: nodes with the least node of their group, where a link joins any.

    A node stands for all branches under a parent with equal distributions and labels. Links
    are all pairs of a parent's nodes of one side that overlap by ``alike``, and the nodes
    that are like the pool. Such a pair shares a segment among the rarest of each that hold
    more than 1 - ``alike``, so only those are met. Each meeting is compared with its least
    node first, and what then is in one group already is not compared again.
    """
    key = ["host", "template", "side"]
    nodes = branches.groupBy(*key, "id").agg(F.min("seg").alias("seg"), F.max("pool_like").alias("pool_like"))
    parents = branches.groupBy(*key).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).filter("_lo < _hi").select(*key)
    nodes = stash(nodes.join(parents, key), "url-nodes")
    if not nodes.limit(1).count():
        return None
    dist = stash(shares.join(nodes, [*key, "seg"]).select(*key, "id", "next", "share"), "url-dist")
    rarity = dist.groupBy(*key, "next").agg(F.count(F.lit(1)).alias("nodes"))
    before = Window.partitionBy("id").orderBy("nodes", "next").rowsBetween(Window.unboundedPreceding, -1)
    met = dist.join(rarity, [*key, "next"]).withColumn("_before", F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    met = stash(met.filter(F.col("_before") <= 1 - alike + ROUNDING).select(*key, "next", "id"), "url-met")
    least = met.groupBy(*key, "next").agg(F.min("id").alias("a"))
    star = met.join(least, [*key, "next"]).filter("a < id").select("a", F.col("id").alias("b")).distinct()
    pool = nodes.filter("pool_like")
    pool = pool.join(pool.groupBy(*key).agg(F.min("id").alias("a")), key).filter("a < id").select("a", F.col("id").alias("b"))
    links = stash(_overlapping(star, dist, alike).union(pool), "url-links")
    labels = _labels(links)
    grouped = met.join(labels, "id", "left").select(*key, "next", "id", F.coalesce("label", "id").alias("label"))
    other = grouped.select(*key, "next", F.col("id").alias("b"), F.col("label").alias("_l"))
    rest = grouped.join(other, [*key, "next"]).filter("id < b and label != _l").select(F.col("id").alias("a"), "b").distinct()
    more = stash(_overlapping(rest, dist, alike), "url-links")
    return _labels(links.union(more)) if more.limit(1).count() else labels


def _generalised(rows: DataFrame, depth: int, many: int, thin: float, alike: float, reject: float) -> DataFrame:
    """The rows with ``template``, the template that each path takes.

    Level by level: under one parent template, if there are more than ``many`` different
    segments and they hold fewer than ``thin`` addresses each, the level varies freely and
    its segments become ``*``. Otherwise branches are like each other where the overlap of
    the distributions of their next segments (the end counts as one) is at least ``alike``,
    or where each overlaps so with that of all siblings together, unless their labels speak
    against it: a branch is on the side of blocked or of allowed ones by the share of its
    blocked addresses, or by that of its path over all hosts where it has no known one, and
    branches of two sides, or of a side and none, stay apart. Like branches and the like of
    those form groups, from two branches on. The segments of a parent's group with the most
    addresses become ``*``, those of its other groups ``*`` and the group's least segment.
    """
    rows = rows.withColumn("template", F.expr("cast(array() as array<string>)"))
    key = ["host", "template"]
    deepest = rows.agg(F.max(F.size("segs")).alias("levels")).first()["levels"] or 0
    for level in range(min(depth, deepest)):
        seg, after = F.get("segs", F.lit(level)), F.coalesce(F.get("segs", F.lit(level + 1)), F.lit(""))
        there = rows.filter(seg.isNotNull()).select(*key, seg.alias("seg"), after.alias("next"), "n", "known", "bad", F.get("shared", F.lit(level)).alias("shared"))
        sums = [F.sum(c).alias(c) for c in ("n", "known", "bad")]
        edges = stash(there.groupBy(*key, "seg", "next").agg(*sums, F.sum(F.col("shared") * F.col("n")).alias("shared"), F.sum(F.when(F.col("shared").isNotNull(), F.col("n"))).alias("told")), "url-edges")
        branch = edges.groupBy(*key, "seg").agg(F.sum("n").alias("bn"), *[F.sum(c).alias(c) for c in ("known", "bad", "shared", "told")])
        purity = F.when(F.col("known") > 0, F.col("bad") / F.col("known")).otherwise(F.col("shared") / F.col("told"))
        side = F.when(purity.isNull(), "").when(purity >= reject, "block").otherwise("allow")
        branch = branch.select(*key, "seg", "bn", side.alias("side"))
        parent = branch.groupBy(*key).agg(F.sum("bn").alias("pn"), F.count(F.lit(1)).alias("branches"))
        pooled = edges.groupBy(*key, "next").agg(F.sum("n").alias("nn"))
        joined = edges.select(*key, "seg", "next", "n").join(branch, [*key, "seg"]).join(parent, key).join(pooled, [*key, "next"])
        free = (F.col("branches") > many) & (F.col("pn") / F.col("branches") < thin)
        shares = joined.select(*key, "side", "seg", "next", "bn", free.alias("free"), (F.col("n") / F.col("bn")).alias("share"), (F.col("nn") / F.col("pn")).alias("pool"))
        shares = stash(shares, "url-shares")
        # equal distributions have equal sums of hashes: 128 bits tell them apart
        one, two = F.bit_xor(F.xxhash64("next", "share")), F.bit_xor(F.xxhash64("share", "next"))
        branches = shares.groupBy(*key, "side", "seg", "bn", "free").agg(F.sum(F.least("share", "pool")).alias("overlap"), one.alias("_1"), two.alias("_2"))
        node = F.md5(F.to_json(F.struct(*key, "side", "_1", "_2")).cast("binary"))
        branches = stash(branches.select(*key, "side", "seg", "bn", "free", (F.col("overlap") >= alike - ROUNDING).alias("pool_like"), node.alias("id")), "url-branches")
        labels = _like_branches(shares, branches.filter("not free"), alike)
        label = F.col("id") if labels is None else F.coalesce("label", "id")
        grouped = (branches if labels is None else branches.join(labels, "id", "left")).select(*key, "seg", "bn", "free", label.alias("label"))
        groups = grouped.groupBy(*key, "label").agg(F.sum("bn").alias("gn"), F.min("seg").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        first = groups.groupBy(*key).agg(F.min(F.struct(-F.col("gn"), "least")).getField("least").alias("first"))
        named = groups.join(first, key).select(*key, "label", F.when(F.col("least") == F.col("first"), ANY).otherwise(F.concat(F.lit(ANY), "least")).alias("any"))
        to = F.when(F.col("free"), ANY).otherwise(F.coalesce("any", "seg"))
        choice = grouped.join(named, [*key, "label"], "left").select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("seg").alias("_s"), to.alias("to"))
        met = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (seg == F.col("_s"))
        template = F.when(F.col("to").isNull(), F.col("template")).otherwise(F.concat("template", F.array("to")))
        rows = stash(rows.join(choice, met, "left").select("host", "segs", "shared", template.alias("template"), "n", "known", "bad"), "url-rows")
    return rows


def learn(
    addresses: DataFrame, depth: int = DEPTH, many: int = 20, thin: float = 5.0, alike: float = 0.8, weight: float = 4.0, reject: float = 0.5
) -> DataFrame:
    """``host, segs, template, purity, verdict`` from ``host, path, verdict`` (null: not known).

    The purity of a template is (blocked + weight * prior) / (known + weight). A host's own
    prior is the share of blocked ones among all that are known, or 0. Below it, a
    template's prior is its parent's purity, or the mean of that and the purity of its
    paths over all hosts, where anything is known of those: so labels of other hosts' like
    paths reach hosts that have none.
    """
    paths, share = _labelled(addresses, depth, weight)
    rows = _generalised(paths, depth, many, thin, alike, reject)
    level = F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level")
    shared = F.when(F.col("level") > 0, F.get("shared", F.col("level") - 1))
    prefixes = rows.select("host", "template", "shared", "n", "known", "bad", level).select(
        "host", F.slice("template", F.lit(1), F.col("level")).alias("prefix"), "n", "known", "bad", shared.alias("shared")
    )
    sums = prefixes.groupBy("host", "prefix").agg(
        F.sum("known").alias("known"), F.sum("bad").alias("bad"), (F.sum(F.col("shared") * F.col("n")) / F.sum(F.when(F.col("shared").isNotNull(), F.col("n")))).alias("shared")
    )
    sums = stash(sums.select(F.col("host").alias("_h"), F.col("prefix").alias("_p"), F.struct(F.size("prefix").alias("level"), "known", "bad", "shared").alias("node")), "url-sums")
    leaves = rows.select("host", "template").distinct()
    above = leaves.select("host", "template", F.explode(F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.slice("template", F.lit(1), i))).alias("prefix"))
    chains = above.join(sums, (F.col("host") == F.col("_h")) & (F.col("prefix") == F.col("_p"))).groupBy("host", "template").agg(F.array_sort(F.collect_list("node")).alias("nodes"))

    def step(purity: Column, node: Column) -> Column:
        prior = F.coalesce((purity + node["shared"]) / 2, purity)
        return (node["bad"] + weight * prior) / (node["known"] + weight)

    judged = chains.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.aggregate("nodes", F.lit(float(share)), step).alias("purity"))
    found = rows.join(judged, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    return found.select("host", "segs", "template", "purity", F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH, **options: float) -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict, template, purity``.

    A rule that fits decides, the longest first. All other addresses get their template's
    verdict; what rules say of a host's other addresses is what the tree learns from. A null
    url, or one without ``://``, has an empty host and path and is judged like any other.
    ``template`` is null where a rule decided. Rows may repeat and ids be null; other columns
    are ignored; an empty table gives no rows.
    """
    url = F.col(url_col)
    ruled = stash(
        pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules)),
        "url-ruled",
    )
    tree = stash(learn(ruled.select("host", "path", F.col("_r.verdict").alias("verdict")), depth, **options), "url-tree")
    tree = tree.select(F.col("host").alias("_h"), F.col("segs").alias("_s"), "template", "purity", "verdict")
    # a path that many addresses share is one row of the tree
    met = (F.col("host") == F.col("_h")) & (F.col("segs") == F.col("_s"))
    left = ruled.withColumn("segs", F.transform(segments(F.col("path"), depth), shape)).join(tree, met)
    free = F.col("_r").isNull()
    return left.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("_r.rule").alias("rule"),
        F.coalesce("_r.verdict", "verdict").alias("verdict"),
        F.when(free, F.concat(F.lit("/"), F.array_join("template", "/"))).alias("template"),
        F.when(free, F.col("purity")).alias("purity"),
    )
