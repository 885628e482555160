"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a tree domain > language > source. A budget of tokens flows down the tree: each
node's children share its budget by weight, none gets more than its documents give in ``max_epochs``
passes, and what one cannot use goes to its siblings; since a child's limit is that of its whole
subtree, a shortage reaches the siblings of an ancestor only when its own siblings are full. At a leaf
the budget buys whole passes first and then the longest token-prefix of one more pass, in an order
seeded by epoch.

The tree has as many rows as there are sources. No leaf is ever sorted as a whole: documents fall into
4096 hash ranges a leaf, whose token sums are added up, and only the range that the prefix ends in is
ordered by itself, so a source with a third of all rows is spread like any other.

Defined results: null or empty text holds no tokens and is never selected; a null domain, language or
source counts as ``none``; nodes without a weight have the default weight 1000 (thousandths), nodes of
weight 0 get nothing; rows that repeat an id are rows like others, and tie by id and tokens; other
columns are ignored; no rows give no rows. The same documents and seed give the same selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_bytes, small, stored, table

LEVELS = ("domain", "lang", "source")
SEED = "mix-1"
SHARE = 0.6  #: of all tokens that the query's budget has
MAX_EPOCHS = 2
WEIGHTS = {"domain": {"domain0": 400, "domain1": 300, "domain2": 200, "domain3": 100}, "lang": {"en": 500, "de": 200, "fr": 200, "es": 100}, "source": {}}
DEFAULT_WEIGHT = 1000
RANGE_DIGITS = 3  #: hexadecimal digits that make a hash range


def tokens(text: Column) -> Column:
    """Tokens of a text, estimated as a quarter of its bytes."""
    return F.floor((n_bytes(text) + 3) / 4).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4."""
    return F.coalesce(F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)") % 4).cast("string")), F.lit("none"))


def leaves_of(docs: DataFrame, row: str, by: str) -> DataFrame:
    """doc_id, which is column ``row``, the tree's levels, tokens and ``by`` as text of every document that has tokens."""
    return docs.select(
        F.col(row).cast("long").alias("doc_id"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("by"), domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), tokens(F.col("text")).alias("n_tokens")
    ).where("n_tokens > 0")


def shared(level: str, parents: DataFrame | None, nodes: DataFrame, budget: int, weights: dict[str, int]) -> DataFrame:
    """Give each node of a level its share of its parent's ``budget``.

    With limits c and weights w, and nodes in order of c / w, the level of water is the largest of
    (budget - limits before) / (weights from here on); a node gets the lesser of c and w times that.
    """
    above = list(LEVELS[: LEVELS.index(level)])
    known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.expr("cast(map() as map<string,int>)")
    here = nodes.groupBy(*above, level).agg(F.sum("limit").alias("limit")).withColumn("weight", F.coalesce(F.element_at(known, F.col(level)), F.lit(DEFAULT_WEIGHT)).cast("long")).where("weight > 0")
    here = here.join(small(parents), above) if parents is not None else here.withColumn("budget", F.lit(budget).cast("long"))
    family = W.partitionBy(*above) if above else W.partitionBy(F.lit(0))
    order = family.orderBy(F.col("limit") / F.col("weight"), level)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    return here.withColumn("water", (F.col("budget") - before) / onward).select(*above, level, F.least(F.col("limit"), F.floor(F.col("weight") * F.max("water").over(family)).cast("long")).alias("budget"))


def budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """Tokens that each leaf of the tree is to give: one row a source."""
    nodes = leaves.select(*LEVELS, (F.col("available") * max_epochs).alias("limit"))
    at = None
    for level in LEVELS:
        at = stored(shared(level, at, nodes, budget, weights.get(level, {})), f"budget-{level}")
    return leaves.join(small(at), list(LEVELS)).select(*LEVELS, "available", "budget")


def mix(docs: DataFrame, budget: int | None = None, share: float = SHARE, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row: str = "doc_id", by: str | None = None) -> DataFrame:
    """doc_id, tree levels, epoch and n_tokens of every selected document, a row for each epoch.

    ``budget`` is in tokens; without it, it is ``share`` of all tokens. ``row`` is the column that names a document in the result, and ``by``
    the one whose text seeds its place in the order, if another.
    """
    rows = leaves_of(docs, row, by or row)
    # One row a leaf: bounded by the number of sources, which is far below that of documents.
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available")), "leaves")
    total = leaves.agg(F.sum("available")).first()[0] or 0
    plan = budgets(leaves, int(total * share) if budget is None else budget, weights, max_epochs)
    plan = small(stored(plan.select(*LEVELS, F.expr("budget div available").alias("passes"), F.expr("budget % available").alias("rest")), "budgets"))
    ordered = rows.join(plan, list(LEVELS)).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("passes").cast("string"), "by"))).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    key = [*LEVELS, "range"]
    ends = W.partitionBy(*LEVELS).orderBy("range")  # at most 4096 rows a leaf
    ranges = ordered.groupBy(*key).agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("limit")).select(*key, "held", "limit", (F.sum("held").over(ends) - F.col("held")).alias("before"))
    cut = stored(ranges.where("before < limit"), "ranges")
    placed = ordered.join(small(cut), key, "left")
    inside = placed.where("before + held <= limit")
    within = W.partitionBy(*key).orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    edge = placed.where("before + held > limit").withColumn("upto", F.col("before") + F.sum("n_tokens").over(within)).where("upto <= limit").drop("upto")
    out = ["doc_id", *LEVELS]
    partial = inside.union(edge).select(*out, F.col("passes").alias("epoch"), "n_tokens")
    whole = ordered.where("passes > 0").select(*out, F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("epoch"), "n_tokens")
    return whole.union(partial)


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of the documents at 60 % of their tokens, up to two epochs."""
    return mix(table(spark, sf_dir, "documents"))


def _level_sql(name: str, above: str, level: str, budget: str, join: str, weights: dict[str, int]) -> str:
    case = f"CASE {level} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE {DEFAULT_WEIGHT} END" if weights else str(DEFAULT_WEIGHT)
    by = f"PARTITION BY {above}" if above else ""
    cols = f"{above}, {level}" if above else level
    return f"""{name}_in AS (SELECT {cols}, sum(available)::BIGINT * {MAX_EPOCHS} AS lim, ({case})::BIGINT AS w FROM leaves GROUP BY {cols}),
{name}_w AS (SELECT i.*, b.budget, (b.budget - coalesce(sum(lim) OVER ({by} ORDER BY lim / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER ({by} ORDER BY lim / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS water FROM {name}_in i {join.format(budget=budget)}),
{name} AS (SELECT {cols}, least(lim, floor(w * max(water) OVER ({by}))::BIGINT) AS budget FROM {name}_w)"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), 'none') AS domain,
  coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, ((coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS n_tokens FROM documents),
r AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available FROM r GROUP BY ALL),
top AS (SELECT floor(sum(available)::DOUBLE * {SHARE})::BIGINT AS budget FROM leaves),
{_level_sql("l1", "", "domain", "top", "CROSS JOIN {budget} b", WEIGHTS["domain"])},
{_level_sql("l2", "domain", "lang", "l1", "JOIN {budget} b USING (domain)", WEIGHTS["lang"])},
{_level_sql("l3", "domain, lang", "source", "l2", "JOIN {budget} b USING (domain, lang)", WEIGHTS["source"])},
plan AS (SELECT domain, lang, source, budget // available AS passes, budget % available AS rest FROM leaves JOIN l3 USING (domain, lang, source)),
o AS (SELECT r.*, passes, rest, md5('{SEED}:' || passes || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM r JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, domain, lang, source, passes::BIGINT AS epoch, n_tokens FROM c WHERE upto <= rest
UNION ALL SELECT doc_id, domain, lang, source, e::BIGINT AS epoch, n_tokens FROM o, range({MAX_EPOCHS}) t(e) WHERE e < passes
"""
