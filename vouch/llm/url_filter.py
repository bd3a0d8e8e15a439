"""URL filter: host and path rules, then a tree of path templates per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouch.session import materialize

DEPTH = 4  # levels of the tree; a longer path keeps its rest in the last one
ALPHA = 0.05  # of the test that keeps branches apart
STRENGTH = 8.0  # labelled pages that the overall share of bad ones counts for
MOST_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without ``://``; the host's A-Z are lower-cased."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``(rule, action)`` that fits, and its action; nulls if none does.

    A rule ``host/path`` fits its host and all subdomains, if the path starts with the rule's.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = verdict = None
    for rule, action in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _levels(path: Column) -> list[Column]:
    """Segments with runs of digits generalised; absent ones are marked."""
    typed = F.regexp_replace(F.substring(path, 2, 1_000_000_000), "[0-9]+", "<n>")
    parts = F.split(typed, "/", DEPTH)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("<end>")) for i in range(DEPTH)]


def _similar(n: Column, bad: Column, all_n: Column, all_bad: Column) -> Column:
    """Hoeffding's test: whether a branch's share of bad pages may be its node's."""
    import math

    bound = math.sqrt(math.log(2 / ALPHA) / 2)
    gap = F.abs(bad / F.greatest(n, F.lit(1)) - all_bad / F.greatest(all_n, F.lit(1)))
    width = bound * (1 / F.sqrt(F.greatest(n, F.lit(1))) + 1 / F.sqrt(F.greatest(all_n, F.lit(1))))
    return (n == 0) | (gap <= width)


def template_verdicts(paths: DataFrame) -> DataFrame:
    """``host, s0.., m0.., purity``: the template of each distinct typed path, and its share of bad pages.

    ``paths`` has ``host``, the levels ``s0`` and so on, and the sums ``n`` (labelled) and ``bad``.
    From the root down, a child becomes the wildcard ``*`` if its share of bad pages doesn't differ from its
    node's, however many children the node has and however rare this one is.  Children that do differ are merged with those
    of their own tenth of the share, as ``*0`` to ``*9``; one that is alone in its tenth keeps its name.  Similar
    branches so become one, with their node or with each other.  Paths have ``DEPTH`` levels; the last one holds
    all that follows, as it is.
    The purity of a template is smoothed towards the overall share.
    """
    tree = materialize(paths, "paths")
    for level in range(DEPTH):
        node = ["host", *[f"m{i}" for i in range(level)]]
        child = f"s{level}"
        branches = materialize(
            tree.groupBy(*node, child).agg(*[F.sum(c).alias(c) for c in ("n", "bad")]), "branches"
        )
        nodes = materialize(
            branches.groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad")]), "nodes"
        )
        alike = _similar(F.col("n"), F.col("bad"), F.col("all_n"), F.col("all_bad"))
        tenth = F.least(F.floor(10 * F.col("bad") / F.greatest(F.col("n"), F.lit(1))), F.lit(9)).cast("int")
        dealt = materialize(
            branches.join(nodes, node).select(*node, child, F.when(alike, -1).otherwise(tenth).alias("tenth")), "dealt"
        )
        mates = materialize(dealt.groupBy(*node, "tenth").agg(F.count("*").alias("mates")), "mates")
        name = (
            F.when(F.col("tenth") < 0, "*")
            .when(F.col("mates") == 1, F.col(child))
            .otherwise(F.concat(F.lit("*"), F.col("tenth").cast("string")))
        )
        names = dealt.join(mates, [*node, "tenth"]).select(*node, child, name.alias(f"m{level}"))
        tree = materialize(tree.join(materialize(names, "names"), [*node, child]), "tree")
    template = ["host", *[f"m{i}" for i in range(DEPTH)]]
    overall = tree.agg(F.sum("n"), F.sum("bad")).first()
    share = (overall[1] or 0) / (overall[0] or 1)
    sums = tree.groupBy(*template).agg(F.sum("n").alias("t_n"), F.sum("bad").alias("t_bad"))
    purity = (F.col("t_bad") + STRENGTH * share) / (F.col("t_n") + STRENGTH)
    sums = materialize(sums.select(*template, purity.alias("purity")), "templates")
    return tree.select("host", *[f"s{i}" for i in range(DEPTH)], *template[1:]).join(sums, template)


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    reject: float = 0.5,
) -> DataFrame:
    """``id_col, host, path, rule, verdict, template, purity``: one row per row of ``pages``.

    ``labels(id, bad)`` marks some pages good (0) or bad (1); an id with both is bad, null ids and labels count for
    none.  A rule's verdict stands; elsewhere a page is blocked if its template's purity of bad pages reaches ``reject``.
    All pages, those with a rule too, make up the tree.  Without labels all purities are 0.  Null
    urls and urls without ``://`` have an empty host and path, and share a template.
    """
    one = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host.alias("host"), path.alias("path")
    )
    levels = [f"s{i}" for i in range(DEPTH)]
    own = materialize(
        own.join(one, "id", "left").select(
            "id", "host", "path", "bad", *[c.alias(s) for c, s in zip(_levels(F.col("path")), levels, strict=True)]
        ),
        "urls",
    )
    paths = own.groupBy("host", *levels).agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    known = materialize(template_verdicts(paths), "verdicts")
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    found = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return own.drop("bad").join(known, ["host", *levels]).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(action, found).alias("verdict"),
        F.concat_ws("/", *[f"m{i}" for i in range(DEPTH)]).alias("template"),
        "purity",
    )
