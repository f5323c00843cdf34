"""Mixing sources to target weights: a token budget shared out down a tree, and a prefix of seeded epochs per leaf.

The tree has a level for each of `levels` (here domain, language, source). Each node shares its budget among its children
by their weights; a child never gets more than its capacity, the tokens below it times `epochs`, and what it can't take
goes to its siblings by weight, again and again. As a node's capacity is that of its whole subtree, a shortage leaves a
subtree, to the siblings of the ancestor, only when all of it is used up. Shares are whole tokens, rounded down.

A leaf of t tokens with a budget of b takes all its documents b div t times; of the next epoch, an order of the documents
by a seeded digest of epoch and key, it takes the longest prefix that fits in the rest. The cut is found digit by digit
of the digest: counts of 256 ranges a leaf, then of 256 ranges inside the one with the cut, until few documents are left,
so no task orders a whole leaf. The key in the digest is the doc_id, or a digest of the text where that is null. Documents
with the same key (repeated rows) are taken together or not at all.

Tokens are the words of a text, runs without ASCII white space; a null or empty text has none and is taken when its place
lies in the prefix. A null lang or source is the name `(none)`. A leaf without tokens takes no epoch as a whole. An empty
table gives an empty table. Other columns are not read, and pass through `mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.llm.common import WORD, quoted, unpacked, whole_rows

MISSING = "(none)"
LEVELS = ("domain", "lang", "source")
FEW_ROWS = 4_096
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Recipe:
    """Weights are whole numbers by level and name, `other` for names without one. The budget is `numerator` parts of
    `denominator` of the tokens at hand. `domains` names the domain of a source, `other_domain` the rest."""

    numerator: int = 1
    denominator: int = 2
    epochs: int = 2
    seed: int = 17
    other: int = 1
    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "crawl": ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"),
        "reference": ("src8", "src9", "src10", "src11", "src12", "src13")})
    other_domain: str = "community"
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {
        "domain": {"crawl": 5, "reference": 3, "community": 2},
        "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
        "source": {}})


def _domain(source: Column, recipe: Recipe) -> Column:
    out = F.lit(recipe.other_domain)
    for name, sources in recipe.domains.items():
        out = F.when(source.isin(*sources), F.lit(name)).otherwise(out)
    return out


def _weight(level: str, recipe: Recipe) -> Column:
    out = F.lit(recipe.other)
    for name, weight in recipe.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _leaf(recipe: Recipe) -> list[Column]:
    source = F.coalesce(quoted("source").cast("string"), F.lit(MISSING))
    return [_domain(source, recipe).alias("domain"), F.coalesce(quoted("lang").cast("string"), F.lit(MISSING)).alias("lang"),
            source.alias("source")]


def _key() -> Column:
    return F.coalesce(quoted("doc_id").cast("string"), F.md5(F.coalesce(quoted("text"), F.lit("")).cast("binary")))


def _digest(recipe: Recipe, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(recipe.seed)), epoch.cast("string"), F.col("key")).cast("binary"))


def tokens(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """doc_id, key, the leaf and n_tokens of each row."""
    return docs.select(quoted("doc_id").alias("doc_id"), _key().alias("key"), *_leaf(recipe),
                       F.regexp_count(F.coalesce(quoted("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))


def shares(sizes: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The leaves, one row each with n_tokens, and their budget: `sizes` shared out level by level from the root down."""
    big = "decimal(38,0)"
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    budget = min(total * recipe.numerator // recipe.denominator, total * recipe.epochs)
    wanted = F.lit(True)
    for level in LEVELS:
        wanted = wanted & (_weight(level, recipe) > 0)
    leaves = sizes.withColumn("capacity", F.when(wanted, F.col("n_tokens") * recipe.epochs).otherwise(F.lit(0)))
    nodes, above = None, []
    for level in LEVELS:
        path = [*above, level]
        children = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("w", _weight(level, recipe))
        children = children.join(nodes, above) if above else children.withColumn("budget", F.lit(budget).cast("long"))
        # ordered by capacity over weight, the children that are filled come first
        order = Window.partitionBy(*above).orderBy(F.try_divide("capacity", "w"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        since = order.rowsBetween(0, Window.unboundedFollowing)
        siblings = Window.partitionBy(*above)
        children = (children.withColumn("remaining", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
                    .withColumn("open_w", F.sum("w").over(since))
                    .withColumn("filled", F.expr(f"capacity = 0 or cast(capacity as {big}) * open_w <= cast(remaining as {big}) * w")))
        spent = F.coalesce(F.sum(F.when(F.col("filled"), F.col("capacity"))).over(siblings), F.lit(0))
        children = (children.withColumn("spare", F.col("budget") - spent)
                    .withColumn("open_w", F.sum(F.when(~F.col("filled"), F.col("w"))).over(siblings)))
        nodes = children.select(*path, F.when(F.col("filled"), F.col("capacity")).otherwise(
            F.expr(f"cast(spare as {big}) * w div open_w")).alias("budget"))
        above = path
    return leaves.join(nodes, above).select(*LEVELS, "n_tokens", "budget")


def _beside(rows: DataFrame, leaves: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """`rows` joined to one row per leaf, broadcast while there are at most BROADCAST_LEAVES."""
    return rows.join(F.broadcast(leaves) if count <= BROADCAST_LEAVES else leaves, list(LEVELS), how)


def _cuts(counted: DataFrame, budgets: DataFrame, leaves: int, rows: int, recipe: Recipe) -> DataFrame:
    """The leaf, its whole epochs, and the last digest that it takes of the next one ('' for none)."""
    digest = _digest(recipe, F.col("whole") + 1).alias("digest")
    open_rows = staged(_beside(counted, budgets.select(*LEVELS, "whole"), leaves).select(*LEVELS, "n_tokens", digest))
    state = budgets.select(*LEVELS, "whole", "rest", F.lit("").alias("prefix"))

    def inside() -> DataFrame:
        return _beside(open_rows, state.select(*LEVELS, "prefix"), leaves).filter(F.col("digest").startswith(F.col("prefix")))

    def running(column: str):
        return Window.partitionBy(*LEVELS).orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    depth = 0
    while rows > FEW_ROWS and depth < 30:
        rows, depth = rows // 256, depth + 2
        ranges = inside().groupBy(*LEVELS, F.substring("digest", 1, depth).alias("step")).agg(F.sum("n_tokens").alias("n"))
        placed = _beside(ranges.withColumn("upto", F.sum("n").over(running("step"))), state, leaves)
        placed = placed.filter(F.col("upto") - F.col("n") <= F.col("rest"))
        # the last range that something of the rest is left for
        edge = placed.groupBy(*LEVELS).agg(F.max(F.struct("step", "upto", "n")).alias("edge"))
        state = staged(state.join(edge, list(LEVELS), "left").select(
            *LEVELS, "whole", (F.col("rest") - F.coalesce(F.col("edge.upto") - F.col("edge.n"), F.lit(0))).alias("rest"),
            F.coalesce("edge.step", "prefix").alias("prefix")))
    placed = _beside(inside().withColumn("upto", F.sum("n_tokens").over(running("digest"))).drop("prefix"), state, leaves)
    last = placed.filter(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("digest").alias("cut"))
    # a prefix is smaller than the digests that start with it and larger than all before them
    return state.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("cut", "prefix").alias("cut"))


def plan(counted: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """What each leaf takes: n_tokens, budget, `whole` epochs, and the last digest (`cut`) of the epoch after those."""
    sizes = staged(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")))
    leaves, rows = sizes.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    whole = F.when(F.col("n_tokens") > 0, F.expr("budget div n_tokens")).otherwise(F.lit(0)).cast("long")
    budgets = staged(shares(sizes.select(*LEVELS, "n_tokens"), recipe).withColumn("whole", whole).withColumn(
        "rest", F.col("budget") - F.col("whole") * F.col("n_tokens")))
    cuts = _cuts(counted, budgets, leaves, rows, recipe)
    return staged(budgets.select(*LEVELS, "n_tokens", "budget", "whole").join(cuts, list(LEVELS)))


def _taken(rows: DataFrame, leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """`rows` (with the leaf and key) and `epochs`: how often each is taken."""
    part = (_digest(recipe, F.col("whole") + 1) <= F.col("cut")) & (F.col("whole") < recipe.epochs)
    return _beside(rows, leaves.select(*LEVELS, "whole", "cut"), leaves.count()).withColumn(
        "epochs", F.col("whole") + F.when(part, 1).otherwise(0))


def chosen(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """doc_id, the leaf, n_tokens and `epochs` of each row of `docs`, rows that aren't taken included (0)."""
    counted = staged(tokens(docs, recipe))
    return _taken(counted, plan(counted, recipe), recipe).select("doc_id", *LEVELS, "n_tokens", "epochs")


def mixed(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The rows of `docs` that are taken, all columns, as often as they are taken."""
    leaves = plan(staged(tokens(docs, recipe)), recipe)
    rows = docs.select(whole_rows(docs), _key().alias("key"), *_leaf(recipe))
    taken = _taken(rows, leaves, recipe).filter("epochs > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))))
