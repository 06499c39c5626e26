"""Mixing sources to target weights by hierarchical budgeting.

A tree over the columns ``levels`` (for instance domain, language, source) holds a weight for
every node.  A budget of tokens flows from the root to the leaves in proportion to the weights.
A node takes no more than its leaves can give in ``max_epochs`` passes; what it cannot take is
shared among its siblings by weight, and only what all siblings together cannot take goes back
to the parent's siblings.  Each leaf then gives whole epochs and, of one more epoch in seeded
order, the documents whose tokens come first, the last one cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Documents of a leaf that are put in order together, about.
BUCKET_DOCS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes``: (parent columns, weight, capacity, given: the parent's budget); adds ``budget``.

    The smallest level L such that sum(min(capacity, weight * L)) is the parent's budget, or
    the capacities if they do not reach it.  Nodes fill up in the order of capacity / weight;
    a node is full if the level at which it fills is not above what the others need.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *[c for c in nodes.columns if c not in parent])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    filled = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = F.col("capacity") * weight_left <= F.col("weight") * (F.col("given") - filled)
    nodes = nodes.withColumn("_full", full).withColumn("_level", (F.col("given") - filled) / weight_left)
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole)  # of the first that is not full
    budget = F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.floor(F.col("weight") * level + 1e-6)))
    return nodes.withColumn("budget", budget.cast("long")).drop("_full", "_level")


def leaf_budgets(supply: DataFrame, levels: list[str], weights: DataFrame | None, budget: int, max_epochs: int) -> DataFrame:
    """``supply``: (levels, tokens) of every leaf; returns (levels, tokens, budget).

    ``weights``: (levels, weight) with null in the columns below a node; nodes without an entry
    weigh 1; nodes with a weight of 0 or less get nothing and add nothing to what their parent can
    take.  A level's own null values are a node of
    that level: they are told from "below" by their depth, so weights name them only by default.
    """
    # Upwards: a node can take what its children can, and nothing with a weight of 0 or less.
    below, nodes_at = supply.withColumn("capacity", F.col("tokens") * max_epochs), {}
    for depth in range(len(levels), 0, -1):
        own = levels[:depth]
        nodes = below.groupBy(*own).agg(F.sum("capacity").alias("capacity"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            here = weights.where(F.col(own[-1]).isNotNull())
            for deeper in levels[depth:]:
                here = here.where(F.col(deeper).isNull())
            here = here.select(*(F.col(c).alias(f"_w_{c}") for c in own), F.col("weight").cast("double").alias("weight"))
            same = [F.col(c) == F.col(f"_w_{c}") for c in own]
            nodes = nodes.join(here, same, "left").drop(*(f"_w_{c}" for c in own))
            nodes = nodes.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0).cast("long"))
        below = nodes_at[depth] = stored(nodes.withColumn("weight", F.greatest("weight", F.lit(1e-12))), f"capacities-{depth}")
    given = None
    for depth in range(1, len(levels) + 1):
        own, nodes = levels[:depth], nodes_at[depth]
        if given is None:
            nodes = nodes.withColumn("_root", F.lit(0)).withColumn("given", F.lit(budget).cast("long"))
            parent = ["_root"]
        else:
            above = given.select(*(F.col(c).alias(f"_p_{c}") for c in own[:-1]), F.col("budget").alias("given"))
            nodes = nodes.join(above, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in own[:-1]]).drop(*(f"_p_{c}" for c in own[:-1]))
            parent = own[:-1]
        given = stored(water_fill(nodes, parent).select(*own, "budget"), f"budgets-{depth}")
    named = given.select(*(F.col(c).alias(f"_p_{c}") for c in levels), "budget")
    return supply.join(named, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in levels]).select(*levels, "tokens", "budget")


def mix(docs: DataFrame, levels: list[str], weights: DataFrame | None = None, budget: int | None = None, share: float | None = None,
        max_epochs: int = 1, seed: int = 1, id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text",
        bucket_docs: int = BUCKET_DOCS, names: tuple[str, str, str] = ("_epoch", "_tokens", "_taken")) -> DataFrame:
    """All columns of the chosen rows, with ``_epoch`` (from 0), ``_tokens`` and ``_taken`` (tokens used in that epoch).

    ``names`` gives these three other names; columns that bear them already are an error, any others stay as they are.

    The budget is a number of tokens or a share of all tokens.  A document has as many tokens as
    words (or what ``tokens`` says); documents without tokens are chosen in epoch 0 where their
    place in the order comes before the leaf's budget is used up.  Order within an epoch: MD5 of
    seed, epoch and id, then id; rows that repeat an id are taken in the order of their text, and
    rows equal in both share one place and one decision.  Null levels are values like others.
    """
    if (budget is None) == (share is None):
        raise ValueError("give either a budget or a share")
    n = tokens if tokens is not None else word_count(F.col(text_col))
    hidden = {n.lower() for n in names} & {c.lower() for c in docs.columns}
    if hidden:
        raise ValueError(f"columns {sorted(hidden)} exist already")
    lean = docs.select(*(F.col(c).alias(f"_l{i}") for i, c in enumerate(levels)), F.col(id_col).cast("string").alias("_id"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("_text"), n.alias("_tokens"))
    lean = stored(lean.groupBy(*lean.columns).agg(F.count(F.lit(1)).alias("_copies")), "lean")
    own = [f"_l{i}" for i in range(len(levels))]
    supply = lean.groupBy(*own).agg(F.sum(F.col("_tokens") * F.col("_copies")).alias("tokens"), F.count(F.lit(1)).alias("_docs"))
    supply = stored(supply, "supply")
    if budget is None:
        budget = int(share * (supply.agg(F.sum("tokens")).first()[0] or 0))
    if weights is not None:
        weights = weights.select(*(F.col(c).alias(o) for c, o in zip(levels, own, strict=True)), "weight")
    leaves = leaf_budgets(supply.drop("_docs"), own, weights, budget, max_epochs)
    leaves = leaves.withColumn("_whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0))
    leaves = leaves.withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens"))
    leaves = leaves.join(supply.select(*(F.col(c).alias(f"_s{c}") for c in own), "_docs"),
                         [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in own]).drop(*(f"_s{c}" for c in own))
    leaves = leaves.withColumn("_buckets", F.ceil(F.col("_docs") / bucket_docs))
    leaves = stored(leaves.select(*(F.col(c).alias(f"_p{c}") for c in own), "_whole", "_rest", "_buckets"), "leaves")
    each = lean.join(leaves, [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in own]).drop(*(f"_p{c}" for c in own))
    # The partial epoch: the order is cut into buckets, whose sums say which bucket holds the limit.
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce("_id", F.lit("null"))).cast("binary"))
    each = each.withColumn("_order", order)
    bucket = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.col("_buckets"))
    each = each.withColumn("_bucket", bucket.cast("long")).withColumn("_all", F.col("_tokens") * F.col("_copies"))
    sums = each.groupBy(*own, "_bucket").agg(F.sum("_all").alias("_sum"))
    ahead = Window.partitionBy(*own).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    sums = stored(sums.select(*(F.col(c).alias(f"_p{c}") for c in own), F.col("_bucket").alias("_p_bucket"), "_ahead"), "buckets")
    each = each.join(sums, [*(F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in own), F.col("_bucket") == F.col("_p_bucket")])
    inside = Window.partitionBy(*own, "_bucket").orderBy("_order", "_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_all").over(inside), F.lit(0)))
    part = F.least(F.col("_tokens"), F.greatest(F.col("_rest") - F.col("_before"), F.lit(0)))
    each = each.withColumn("_part", F.when(F.col("_before") < F.col("_rest"), part))
    each = each.where("_whole > 0 or _part is not null").select(
        F.col("_id").alias("_c_id"), F.col("_text").alias("_c_text"), *(F.col(c).alias(f"_c{c}") for c in own), "_tokens", "_whole", "_part")
    # Keys as columns, so that only columns that are asked for go through the exchange.
    given = [f"_d{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(d) for c, d in zip(docs.columns, given, strict=True)), F.col(id_col).cast("string").alias("_k_id"),
                        F.xxhash64(F.col(text_col).cast("string")).alias("_k_text"), *(F.col(c).alias(f"_k{o}") for c, o in zip(levels, own, strict=True)))
    keys = [F.col("_k_id").eqNullSafe(F.col("_c_id")), F.col("_k_text") == F.col("_c_text"),
            *(F.col(f"_k{o}").eqNullSafe(F.col(f"_c{o}")) for o in own)]
    chosen = keyed.join(stored(each, "chosen"), keys)
    last = F.col("_whole") + F.col("_part").isNotNull().cast("long") - 1
    chosen = chosen.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    taken = F.when(F.col("_epoch") < F.col("_whole"), F.col("_tokens")).otherwise(F.col("_part"))
    return chosen.select(*(F.col(d).alias(c) for c, d in zip(docs.columns, given, strict=True)), F.col("_epoch").cast("int").alias(names[0]),
                         F.col("_tokens").alias(names[1]), taken.alias(names[2]))


#: Production parameters of the registered query.
SHARE, EPOCHS, SEED = 0.6, 3, 11
LEVELS = ["domain", "lang", "source"]
#: Target weights: domains, a language within every domain is 1 unless named, and so are sources.
WEIGHTS = [("domain0", None, None, 4.0), ("domain1", None, None, 2.0), ("domain2", None, None, 1.0), ("domain3", None, None, 1.0),
           ("domain0", "en", None, 2.0), ("domain1", "en", None, 2.0), ("domain2", "en", None, 2.0), ("domain3", "en", None, 2.0)]


def domain() -> Column:
    """A domain for every source, by its last character."""
    last = F.right(F.coalesce("source", F.lit("")), F.lit(1))
    found = F.lit("domain3")
    for name, ends in (("domain2", "26"), ("domain1", "159"), ("domain0", "048")):
        found = F.when(last.isin(*ends), F.lit(name)).otherwise(found)
    return found


def weight_table(spark) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "domain string, lang string, source string, weight double")


def query(spark, folder: str) -> DataFrame:
    """``op1``: 60 % of all words by domain, language and source, up to three epochs."""
    from .shared import table

    docs = table(spark, folder, "documents").withColumn("domain", domain())
    out = mix(docs, LEVELS, weight_table(spark), share=SHARE, max_epochs=EPOCHS, seed=SEED)
    return out.select("doc_id", *LEVELS, F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_taken").alias("taken"))


def _level_sql(depth: int) -> str:
    """The nodes of one level with their budgets, in SQL: the same filling order and the same rounding."""
    own, above = LEVELS[:depth], LEVELS[: depth - 1]
    cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(own, w, strict=False)) + f" THEN {w[3]}"
                     for w in WEIGHTS if all(v is not None for v in w[:depth]) and all(v is None for v in w[depth:3]))
    weight = f"CASE {cases} ELSE 1.0 END" if cases else "1.0"
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    given = f"JOIN b{depth - 1} p USING ({', '.join(above)})" if above else "CROSS JOIN total p"
    return f"""
n{depth} AS (SELECT {', '.join(own)}, sum(tokens) * {EPOCHS} AS capacity, CAST({weight} AS DOUBLE) AS weight
  FROM supply GROUP BY {', '.join(own)}),
f{depth} AS (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER ({part}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM (SELECT n.*, p.budget AS given FROM n{depth} n {given})
  WINDOW w AS ({part} ORDER BY capacity / weight, {own[-1]})),
g{depth} AS (SELECT *, capacity * rest_weight <= weight * (given - filled) AS is_full, (given - filled) / rest_weight AS lvl FROM f{depth}),
b{depth} AS (SELECT {', '.join(own)}, CAST(CASE WHEN is_full THEN capacity ELSE least(capacity,
    floor(weight * max(CASE WHEN NOT is_full THEN lvl END) OVER ({part}) + 1e-6)) END AS BIGINT) AS budget FROM g{depth})"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN right(source, 1) IN ('0', '4', '8') THEN 'domain0'
    WHEN right(source, 1) IN ('1', '5', '9') THEN 'domain1' WHEN right(source, 1) IN ('2', '6') THEN 'domain2' ELSE 'domain3' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
supply AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY ALL),
total AS (SELECT CAST(floor({SHARE} * sum(tokens)) AS BIGINT) AS budget FROM supply),
{','.join(_level_sql(i) for i in (1, 2, 3))},
leaves AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
    budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM supply JOIN b3 USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{SEED}:' || whole || ':' || doc_id), CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM d JOIN leaves USING (domain, lang, source)),
e AS (SELECT *, unnest(range(whole + CASE WHEN seen < rest THEN 1 ELSE 0 END)) AS epoch FROM o)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n AS n_tokens,
  CAST(CASE WHEN epoch < whole THEN n ELSE least(n, greatest(rest - seen, 0)) END AS BIGINT) AS taken FROM e"""
