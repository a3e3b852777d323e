"""Operator 3: mixing sources to target weights by hierarchical budgeting.

Documents form a tree: domain, language, source (leaf). The token budget goes down from the root:
a node's budget is shared among its children by weight; a child that cannot take its share (its
tokens times MAX_EPOCHS) takes what it can, and the rest is shared among its siblings. As no node
is given more than its leaves can take together, a shortage is made good among siblings first and
only what all of them lack reaches the siblings of their parent. A leaf of t tokens with budget b
yields floor(b / t) whole epochs and, of the next epoch's seeded order, the longest prefix of
documents within the remaining tokens.

Shares are exact: with children ordered by capacity over weight, child i is full when
capacity_i * (weights from i on) <= weight_i * (budget less capacities before i); the others get
floor(budget left * weight / weights left). Comparisons are whole numbers in DECIMAL(38).

All DataFrame code. Prefix sums never gather a leaf: documents fall into BUCKETS ranges of their
order hash, ranges are summed, and only the range in which the budget ends is sorted. Leaf plans
are broadcast up to BROADCAST_LEAVES leaves, and joined by (leaf, range) beyond.

Defined cases: null language or source is a leaf of its own (''); null and empty texts have 0
tokens and come with any epoch they fall into; documents of equal order hash and doc_id (repeated
rows) are taken or left together; a null doc_id counts as empty text in the hash; nodes without
tokens get nothing; an empty table gives no rows; other columns are kept by select_docs, ignored
by mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

SEED, BUCKETS, BROADCAST_LEAVES = 17, 1024, 20_000
#: Weights by node name; a node that is not named has weight 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
DOMAINS = 4
LEVELS = ("domain", "lang", "source")
WHOLE = "decimal(38,0)"


def domain() -> Column:
    """A source's domain: its number modulo DOMAINS; sources without a number are of domain0."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.when(number == "", F.lit(0)).otherwise(number.cast("long") % DOMAINS).cast("string"))


def leaves(docs: DataFrame) -> list[Column]:
    return [domain().alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")]


def tokens() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def order_hash(seed: int, epoch: Column) -> Column:
    """A 32-bit place of a document in an epoch's order."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def weight(level: str, named: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in named.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out


def shared_among(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents..., name, w, cap, budget of the parent) with their own budget."""
    w, cap, total = (F.col(c).cast(WHOLE) for c in ("w", "cap", "budget"))
    by = Window.partitionBy(*parents, "one")
    before = by.orderBy((F.col("cap") / F.col("w")), name).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(WHOLE)
    nodes = nodes.withColumn("one", F.lit(1)).withColumn("cap_before", F.coalesce(F.sum(cap).over(before), zero)).withColumn(
        "w_left", F.sum(w).over(by) - F.coalesce(F.sum(w).over(before), zero)
    )
    full = cap * F.col("w_left").cast(WHOLE) <= w * (total - F.col("cap_before").cast(WHOLE))
    nodes = nodes.withColumn("full", full)
    rest_w = F.sum(F.when(~F.col("full"), w).otherwise(zero)).over(by).cast(WHOLE)
    rest = (total - F.sum(F.when(F.col("full"), cap).otherwise(zero)).over(by)).cast(WHOLE)
    own = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("div(cast(rest * w AS decimal(38,0)), rest_w)"))
    return nodes.withColumn("rest_w", rest_w).withColumn("rest", rest).withColumn("own", own.cast("long")).drop("one", "cap_before", "w_left", "full", "rest_w", "rest", "w", "budget").withColumnRenamed("own", "budget")


def leaf_budgets(sizes: DataFrame, budget: Column, max_epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """domain, lang, source, tokens, budget from sizes (domain, lang, source, tokens)."""
    sizes = sizes.withColumn("cap", F.col("tokens") * max_epochs)
    given = sizes.agg(budget.cast("long").alias("budget"))
    for i, level in enumerate(LEVELS):
        nodes = sizes.groupBy(*LEVELS[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", weight(level, weights[i]))
        nodes = nodes.join(given, list(LEVELS[:i])) if i else nodes.withColumn("budget", F.lit(given.first()[0]).cast("long"))
        given = shared_among(nodes, list(LEVELS[:i]), level).drop("cap")
    return sizes.drop("cap").join(given, list(LEVELS))


def plans(rows: DataFrame, share: float, max_epochs: int, weights: tuple[dict, dict, dict], seed: int) -> DataFrame:
    """domain, lang, source, epochs (whole), and the last place (cut, cut_id) of the next epoch that is taken,
    from rows (doc_id, domain, lang, source, tokens)."""
    sizes = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(written(sizes, "leaf-sizes"), F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)), max_epochs, weights)
    empty = F.col("tokens") == 0
    budgets = budgets.select(
        *LEVELS, "budget", F.when(empty, 0).otherwise(F.expr("budget div tokens")).alias("epochs"), F.when(empty, 0).otherwise(F.expr("budget % tokens")).alias("rest")
    )
    budgets = written(budgets, "leaf-budgets")
    placed = with_plan(rows, budgets).withColumn("place", order_hash(seed, F.col("epochs"))).withColumn("range", F.floor(F.col("place") / ((1 << 32) // BUCKETS)).cast("int"))
    placed = placed.select(*LEVELS, "doc_id", "tokens", "rest", "place", "range")
    ranges = placed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy(*LEVELS).orderBy("range")  # BUCKETS rows a leaf
    ranges = ranges.withColumn("through", F.sum("tokens").over(up_to))
    ends = ranges.where("through > rest").groupBy(*LEVELS).agg(F.min("range").alias("range"), F.min_by(F.col("through") - F.col("tokens"), "range").alias("base"))
    ends = written(ends, "leaf-ends")
    last = placed.join(ends, [*LEVELS, "range"])
    reach = Window.partitionBy(*LEVELS).orderBy("place", F.coalesce("doc_id", F.lit(-1))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = last.withColumn("through", F.col("base") + F.sum("tokens").over(reach)).where("through <= rest").groupBy(*LEVELS).agg(F.max(F.struct("place", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))).alias("cut"))
    first_place = (F.col("range").cast("long") * ((1 << 32) // BUCKETS)) - 1  # all of the ranges before
    return (
        budgets.join(ends.drop("base"), list(LEVELS), "left").join(cut, list(LEVELS), "left")
        .select(*LEVELS, "budget", "epochs",
                F.coalesce("cut.place", first_place, F.lit((1 << 32) - 1)).alias("cut"),
                F.when(F.col("cut").isNotNull(), F.col("cut.doc_id")).otherwise(F.lit((1 << 63) - 1)).alias("cut_id"))
    )


def with_plan(rows: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """rows with the columns of their leaf. Beyond BROADCAST_LEAVES leaves, hot ones are spread over salts."""
    if leaf_rows.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaf_rows), list(LEVELS))
    salts = 64
    spread = leaf_rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(spread, [*LEVELS, "salt"]).drop("salt")


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaves(docs), tokens().alias("tokens"))


DEFAULT_WEIGHTS = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)


def mix(docs: DataFrame, share: float = 0.6, max_epochs: int = 4, weights: tuple[dict, dict, dict] = DEFAULT_WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies (0: left out) for each row of docs; the budget is
    share of docs' tokens."""
    rows = written(slim(docs), "token-counts")
    plan = written(plans(rows, share, max_epochs, weights, seed), "leaf-plans")
    return copies(with_plan(rows, plan), seed).select("doc_id", *LEVELS, "tokens", "copies")


def copies(planned: DataFrame, seed: int) -> DataFrame:
    place, doc_id = order_hash(seed, F.col("epochs")), F.coalesce("doc_id", F.lit(-1))
    taken = (place < F.col("cut")) | ((place == F.col("cut")) & (doc_id <= F.col("cut_id")))
    return planned.withColumn("copies", F.col("epochs") + taken.cast("int"))


def select_docs(docs: DataFrame, share: float, weights: tuple[dict, dict, dict] = DEFAULT_WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of docs that one epoch at most of each leaf yields, with all their columns."""
    rows = written(slim(docs), "token-counts")
    plan = written(plans(rows, share, 1, weights, seed), "leaf-plans")
    names = [x for x in docs.columns]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), *leaves(docs))
    return copies(with_plan(own, plan), seed).where("copies > 0").select("__row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _case(column: str, named: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in named.items()) + " ELSE 1 END" if named else "1"


def _level(i: int, given: str) -> str:
    own, up = LEVELS[: i + 1], LEVELS[:i]
    by = ", ".join([*up, "one"])
    named = DEFAULT_WEIGHTS[i]
    return f"""
n{i} AS (SELECT {", ".join(own)}, sum(tokens * 4)::HUGEINT AS cap, ({_case(LEVELS[i], named)})::HUGEINT AS w, 1 AS one FROM sizes GROUP BY {", ".join(own)}),
o{i} AS (SELECT n{i}.*, g.budget AS total,
  coalesce(sum(cap) OVER (PARTITION BY {", ".join("n%d.%s" % (i, c) for c in [*up, "one"])} ORDER BY cap::DOUBLE / w, {LEVELS[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(w) OVER (PARTITION BY {", ".join("n%d.%s" % (i, c) for c in [*up, "one"])} ORDER BY cap::DOUBLE / w, {LEVELS[i]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM n{i} JOIN {given} g {"USING (" + ", ".join(up) + ")" if up else "ON true"}),
f{i} AS (SELECT *, cap * w_left <= w * (total - cap_before) AS is_full FROM o{i}),
b{i} AS (SELECT {", ".join(own)}, (CASE WHEN is_full THEN cap ELSE (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {by})) * w
  // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {by}) END)::BIGINT AS budget FROM f{i})"""


SQL = f"""
WITH d AS (SELECT doc_id, 'domain' || CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 0
    ELSE regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1)::BIGINT % {DOMAINS} END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
sizes AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
root AS (SELECT floor(coalesce(sum(tokens), 0)::DOUBLE * 0.6::DOUBLE)::BIGINT AS budget FROM sizes),{_level(0, "root")},{_level(1, "b0")},{_level(2, "b1")},
leaf AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest
  FROM sizes JOIN b2 USING (domain, lang, source)),
p AS (SELECT d.*, epochs, rest, ('0x' || substr(md5('{SEED}:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
  FROM d JOIN leaf USING (domain, lang, source)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM p)
SELECT doc_id, domain, lang, source, tokens, (epochs + CASE WHEN through <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM s
"""
