"""Mixing sources to target weights: a token budget goes down a tree of groups to its leaves.

Levels (say domain, language, source) make a tree; each node has a weight among its siblings. A
node's budget is split by weight, but no child gets more than its subtree can supply; what a short
child leaves goes to its siblings by weight, and only what all of them cannot take stays with the
ancestors, who had split by the same rule, so it went to the node's own siblings. A leaf of n tokens
with budget b takes whole epochs first and then, of its documents in the order that the seed and the
number of the epoch it has begun give, the shortest prefix that reaches the rest (its last document
may cross the line, and `max_epochs` bounds all).

Where the line falls in a leaf is found without sorting it: tokens are summed per range of the
seeded hash, the range that holds the line is found from those sums, and only that range's
documents are ordered. A leaf with a third of all rows is never one group.

Defined results: null text has no tokens; documents without tokens are taken in the epochs whose
line lies beyond them, at no cost; null level values are a group of their own; weights that are not
given count as 1, a weight of 0 closes a group unless nobody else can take the tokens; rows that
repeat an id are separate documents (equal in order; a tie is cut after its last row, so that the
choice does not depend on chance); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import broadcast_if_small, written

TINY = 1e-12


@dataclass(frozen=True)
class MixOptions:
    """`weights[level][value]`; `share` of all tokens is the budget unless `tokens` states it."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: Mapping[str, Mapping[str | None, float]] = field(default_factory=dict)
    share: float = 0.5
    tokens: int | None = None
    max_epochs: int = 2
    seed: int = 13
    rows_per_range: int = 2000


def word_tokens(text: Column) -> Column:
    """Runs of characters other than blank, counted as they begin."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _budgets(sums: list[dict], options: MixOptions, total: float) -> dict[tuple, float]:
    """Budget of each leaf. sums: one dict per leaf; the tree has as many nodes as there are sources, not documents."""

    def fill(leaves: list[dict], depth: int, budget: float) -> None:
        if depth == len(options.levels):
            out[tuple(leaves[0][name] for name in options.levels)] = budget
            return
        children: dict = {}
        for leaf in leaves:
            children.setdefault(leaf[options.levels[depth]], []).append(leaf)
        given = options.weights.get(options.levels[depth], {})
        room = {c: float(sum(x["tokens"] for x in part)) * options.max_epochs for c, part in children.items()}
        share, left = dict.fromkeys(children, 0.0), budget
        open_ones = sorted((c for c in children if room[c] > 0), key=str)
        while open_ones and left > TINY:
            weight = {c: float(given.get(c, 1.0)) for c in open_ones}
            if sum(weight.values()) <= 0:
                weight = dict.fromkeys(open_ones, 1.0)
            unit = left / sum(weight.values())
            short = [c for c in open_ones if weight[c] * unit >= room[c] - share[c]]
            if not short:
                for c in open_ones:
                    share[c] += weight[c] * unit
                break
            for c in short:
                left -= room[c] - share[c]
                share[c] = room[c]
            open_ones = [c for c in open_ones if c not in short]
        for c, part in children.items():
            fill(part, depth + 1, share[c])

    out: dict[tuple, float] = {}
    if sums:
        fill(sums, 0, total)
    return out


def leaf_budgets(docs: DataFrame, options: MixOptions) -> DataFrame:
    """Levels, rows, tokens and budget of each leaf. What comes to the driver is one row per leaf (source), with a stated bound."""
    leaves = docs.groupBy(*options.levels).agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    held = [r.asDict() for r in leaves.limit(1_000_001).collect()]
    if len(held) > 1_000_000:
        raise ValueError("more than a million leaves; use coarser levels")
    total = float(options.tokens) if options.tokens is not None else sum(r["tokens"] for r in held) * options.share
    budgets = _budgets(held, options, total)
    rows = [(*(r[n] for n in options.levels), r["rows"], r["tokens"], budgets[tuple(r[n] for n in options.levels)]) for r in held]
    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in options.levels]
    return docs.sparkSession.createDataFrame(rows, ", ".join([*kinds, "rows bigint", "tokens bigint", "budget double"]))


def choose(docs: DataFrame, options: MixOptions = MixOptions(), counts: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` (which has doc_id, n_tokens and the levels) that are taken, with `copies` (1 to max_epochs).

    counts: doc_id, n_tokens and the levels of the same rows, where counting the tokens of docs each time would be dear.
    """
    keep = docs.columns
    counts = docs if counts is None else counts
    leaves = leaf_budgets(counts, options).withColumn("_epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9))).otherwise(0).cast("long"))
    leaves = leaves.withColumn("_rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("_epochs") * F.col("tokens")))
    leaves = leaves.withColumn("_ranges", F.greatest(F.lit(1), F.ceil(F.col("rows") / options.rows_per_range)).cast("long"))
    leaves = leaves.select(*[F.col(n).alias(f"_{n}") for n in options.levels], "_epochs", "_rest", "_ranges")
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in options.levels]
    # One row per source: these sides are sent to all tasks only where their number allows it.
    sources = leaves.count()

    def place(rows: DataFrame) -> DataFrame:
        hashed = rows.join(broadcast_if_small(leaves, sources, 96), same).withColumn("_hash", F.xxhash64(F.lit(options.seed), F.col("_epochs"), F.col("doc_id")))
        return hashed.withColumn("_range", F.floor((F.shiftrightunsigned("_hash", 1) / F.lit(float(1 << 63))) * F.col("_ranges")).cast("long"))

    placed = place(counts)
    leaf = [f"_{n}" for n in options.levels]
    sums = placed.groupBy(*leaf, "_range", "_rest").agg(F.sum("n_tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # _before: tokens of the leaf's earlier ranges. The line lies in the range where it is passed.
    line = written(sums.withColumn("_before", F.coalesce(upto, F.lit(0))).where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest"))).select(*[F.col(n).alias(f"{n}_l") for n in leaf], F.col("_range").alias("_line"), "_before"), "mix-lines")
    beside = [F.col(n).eqNullSafe(F.col(f"{n}_l")) for n in leaf]
    cut = placed.join(broadcast_if_small(line, sources, 96), [*beside, F.col("_range") == F.col("_line")])
    running = F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy(F.shiftrightunsigned("_hash", 1), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    last = cut.select(*leaf, F.shiftrightunsigned("_hash", 1).alias("_at"), F.col("doc_id").alias("_id"), (F.coalesce(running, F.lit(0)) + F.col("_before")).alias("_sofar"), "_rest", "n_tokens")
    # The document that crosses the line: the last one whose predecessors do not reach it.
    last = last.where(F.col("_sofar") < F.col("_rest")).groupBy(*leaf).agg(F.max(F.struct("_at", "_id")).alias("_end"))
    ends = written(last.select(*[F.col(n).alias(f"{n}_e") for n in leaf], "_end"), "mix-ends")
    at_end = [F.col(n).eqNullSafe(F.col(f"{n}_e")) for n in leaf]
    key = F.struct(F.shiftrightunsigned("_hash", 1).alias("_at"), F.col("doc_id").alias("_id"))
    partial = F.when(F.col("_rest") > 0, F.coalesce((key <= F.col("_end")).cast("int"), F.lit(0))).otherwise(0)
    taken = place(docs).join(broadcast_if_small(ends, sources, 96), at_end, "left").withColumn("copies", (F.col("_epochs") + partial).cast("int"))
    return taken.where(F.col("copies") > 0).select(*keep, "copies")


def mix(docs: DataFrame, options: MixOptions, domain: Column | None = None) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken."""
    names = docs.columns
    rename = {n: f"_doc_{i}" for i, n in enumerate(names)}
    base = docs.select(*[F.col(n).alias(rename[n]) for n in names], *[F.col(n) for n in names if n == "doc_id" or n in options.levels])
    if domain is not None:
        base = base.withColumn("domain", domain)
    # Tokens are counted once for all steps; only the last step reads the texts again.
    counts = written(base.select("doc_id", *options.levels, word_tokens(F.col(rename["text"])).alias("n_tokens")), "mix-counts")
    chosen = choose(base, options, counts)
    return chosen.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(rename[n]).alias(n) for n in names])
