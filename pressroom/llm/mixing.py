"""Mixing documents so that sources, languages and topics hold target shares of the tokens.

Raking (iterative proportional fitting) finds one factor per source, language and topic such that the
token weights, multiplied by their three factors, have the target totals on every margin. Documents
are grouped into cells of (source, language, topic) first; every update is one aggregation of the cells
by one margin. The factors times a common scale are then the chance of a document to be taken. The scale
that gives the cell that is wanted most the chance 1 keeps all shares exactly. Where it would keep less than ``share``
of the tokens, as one rare cell does, a budget of that share is raked to instead: cells whose chance would exceed 1
are taken whole, values that have less than their part of the budget likewise, and the factors of the others are
fitted within that bound. No document repeats. Draws hash the key: the same rows under any partitioning.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.session import cut_lineage

MARGINS = ("source", "lang", "topic")
#: Least share of the tokens to keep.
SHARE = 0.4
#: Factor of a value that is taken whole.
WHOLE = 1e12
#: What a missing source or language counts as.
MISSING = "(none)"
# Topics by the first pattern found in the text, in this order; else prose.
TOPICS = {
    "legal": r"(?i)\blicen[cs]e",
    "table": r" \| ",
    "markup": r"[#*$%&]{3}",
    "records": r"(?i)@|://|\d{4,}",
}
PROSE = "prose"


@dataclass(frozen=True)
class Plan:
    """Chances per cell (source, lang, topic, factor, chance), and the largest relative error left on a margin."""

    cells: DataFrame
    error: float
    rounds: int


def topic(text: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name, pattern in TOPICS.items():
        chosen = F.coalesce(chosen, F.when(F.regexp_like(text, F.lit(pattern)), F.lit(name)))
    return F.coalesce(chosen, F.lit(PROSE))


def weighed(docs: DataFrame, key: str, text: str, source: str, lang: str) -> DataFrame:
    """key, source, lang, topic and n_tokens (words) of every row; a null text has no tokens."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(source).cast("string"), F.lit(MISSING)).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit(MISSING)).alias("lang"),
        topic(value).alias("topic"),
        F.regexp_count(value, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"),
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Default target of a margin: (margin, target), its shares raised to ``power`` and made to sum to 1."""
    held = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).withColumn("raised", F.pow("tokens", F.lit(power)))
    total = held.agg(F.sum("raised")).first()[0] or 1.0
    return held.select(margin, (F.col("raised") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-4, most_rounds: int = 30) -> Plan:
    """Fit factors to the targets. ``cells`` has the margins and ``tokens`` (above 0); a target's shares sum to 1.

    A value without a target is wanted with share 0. Every round writes one small table per margin, so
    a lost executor costs one update; the driver receives one number per round.
    """
    factors = {m: cut_lineage(cells.select(m).distinct().withColumn("factor", F.lit(1.0))) for m in MARGINS}
    aims = {m: cut_lineage(targets[m].select(m, "target")) for m in MARGINS}

    def fitted() -> DataFrame:
        joined, product = cells, F.col("tokens").cast("double")
        for m in MARGINS:
            joined = joined.join(factors[m].withColumnRenamed("factor", f"{m}_factor"), m)
            product = product * F.col(f"{m}_factor")
        return joined.withColumn("weight", product)

    error, done = 0.0, 0
    for done in range(1, most_rounds + 1):
        before, error = error, 0.0
        for m in MARGINS:
            sums = fitted().groupBy(m).agg(F.sum("weight").alias("weight"))
            step = F.coalesce(F.col("target"), F.lit(0.0)) / F.col("weight")
            moved = sums.join(aims[m], m, "left").join(factors[m], m).select(
                m, F.when(F.col("weight") > 0, F.col("factor") * step).otherwise(F.lit(0.0)).alias("factor"),
                F.when(F.col("weight") > 0, F.abs(step - 1)).otherwise(F.lit(0.0)).alias("off"),
                F.coalesce("target", F.lit(0.0)).alias("target"),
            )
            written = cut_lineage(moved)
            off = written.where("target > 0").agg(F.max("off")).first()[0] or 0.0
            error = max(error, off)
            factors[m] = written.select(m, "factor")
        if done > 1 and (error <= tolerance or abs(before - error) <= 1e-6 * error):  # at a stand: targets contradict
            break
    factor = F.col("weight") / F.col("tokens")
    whole = cut_lineage(fitted().select(*MARGINS, "tokens", factor.alias("factor")))
    largest = whole.agg(F.max("factor")).first()[0] or 1.0
    return Plan(whole.withColumn("chance", F.least(F.col("factor") / largest, F.lit(1.0))), error, done)


def budgeted(cells: DataFrame, targets: DataFrame, margin: str, budget: float) -> DataFrame:
    """(margin, held, aim): parts of the budget by target; a value that holds less than its part gives all, the others more."""
    held = cut_lineage(cells.groupBy(margin).agg(F.sum("tokens").alias("held")).join(targets.select(margin, "target"), margin))
    level, before = budget, None
    while level != before:
        full = F.col("target") * level >= F.col("held")
        given, open_ = held.agg(F.sum(F.when(full, F.col("held"))), F.sum(F.when(~full, F.col("target")))).first()
        before, level = level, (budget - (given or 0)) / open_ if open_ else level
        level = max(level, before)
    return held.select(margin, "held", F.least("held", F.col("target") * level).alias("aim"))


def bounded(fit: Plan, targets: dict[str, DataFrame], budget: float, tolerance: float = 1e-3, most_rounds: int = 30) -> Plan:
    """Factors within the bound: chances of at most 1 whose tokens meet the parts of ``budget`` on every margin."""
    cells = cut_lineage(fit.cells.where("factor > 0").select(*MARGINS, "tokens", "factor"))
    mass = cells.agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0]
    aims = {m: cut_lineage(budgeted(cells, targets[m], m, budget)) for m in MARGINS}
    whole = F.when(F.col("aim") >= F.col("held") * (1 - 1e-9), F.lit(WHOLE)).otherwise(F.lit(1.0))
    moves = {m: cut_lineage(aims[m].select(m, whole.alias("move"))) for m in MARGINS}

    def chanced() -> DataFrame:
        joined, product = cells, F.col("factor") * F.lit(budget / mass)
        for m in MARGINS:
            joined = joined.join(moves[m].withColumnRenamed("move", f"{m}_move"), m)
            product = product * F.col(f"{m}_move")
        return joined.withColumn("raw", product)

    error, done = 0.0, 0
    for done in range(1, most_rounds + 1):
        before, error = error, 0.0
        for m in MARGINS:
            sums = chanced().groupBy(m).agg(
                F.sum(F.col("tokens") * F.least("raw", F.lit(1.0))).alias("got"),
                F.sum(F.when(F.col("raw") < 1, F.col("tokens") * F.col("raw")).otherwise(F.lit(0.0))).alias("free"),
            )
            capped = F.col("got") - F.col("free")
            step = F.when((F.col("free") > 0) & (F.col("aim") > capped), (F.col("aim") - capped) / F.col("free"))
            step = F.coalesce(step, F.when(F.col("got") > F.col("aim"), F.col("aim") / F.col("got")), F.lit(1.0))
            moved = sums.join(aims[m], m).join(moves[m], m)
            written = cut_lineage(moved.select(m, (F.col("move") * step).alias("move"), F.abs(F.col("got") / F.col("aim") - 1).alias("off")))
            error = max(error, written.agg(F.max("off")).first()[0] or 0.0)
            moves[m] = written.select(m, "move")
        if done > 1 and (error <= tolerance or abs(before - error) <= 1e-6 * error):  # at a stand: targets contradict
            break
    chances = chanced().select(*MARGINS, F.least("raw", F.lit(1.0)).alias("chance"))
    return replace(fit, cells=cut_lineage(fit.cells.drop("chance").join(chances, list(MARGINS), "left").fillna(0.0, ["chance"])), error=error, rounds=done)


def plan(
    docs: DataFrame, power: float, targets: dict[str, DataFrame] | None, share: float = SHARE, **names: str
) -> tuple[DataFrame, Plan]:
    """The weighed rows of ``docs`` and the chances of their cells; warns when a margin misses its target."""
    rows = cut_lineage(weighed(docs, **names))
    cells = cut_lineage(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    given = targets or {}
    wanted = {m: given.get(m) or tempered(cells, m, power) for m in MARGINS}
    fit = rake(cells, wanted)
    kept, most = fit.cells.agg(F.sum(F.col("tokens") * F.col("chance")), F.sum("tokens")).first()
    for m in given:
        held = cells.groupBy(m).agg(F.sum("tokens").alias("held")).join(given[m].where("target > 0"), m)
        most = min(most or 0, held.agg(F.min(F.col("held") / F.col("target"))).first()[0] or 0)
    if kept and kept < share * most:
        fit = bounded(fit, wanted, share * most)
    if fit.error > 0.01:
        warnings.warn(f"mixing: a margin is off its target by {fit.error:.1%} after {fit.rounds} rounds", stacklevel=2)
    return rows, fit


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)


def mix(
    docs: DataFrame,
    power: float = 0.85,
    targets: dict[str, DataFrame] | None = None,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    share: float = SHARE,
) -> DataFrame:
    """key, source, lang, topic, n_tokens, chance and taken of every row.

    Targets are tables (margin, target); by default every margin's shares of tokens are raised to
    ``power``, which lifts the small ones. At least ``share`` of the tokens is kept in expectation, or of the most
    tokens that given targets allow; rare values are taken whole for it. A null source or language is a value of its own. A row without
    tokens has no cell: its chance is 0 and it is not taken. Rows with equal keys (null ones too) share
    one draw. An empty table gives no rows. Other columns are not read.
    """
    rows, fit = plan(docs, power, targets, share, key=key, text=text, source=source, lang=lang)
    cells = fit.cells.select(*MARGINS, "chance")
    chance = F.when(F.col("n_tokens") > 0, F.col("chance")).otherwise(F.lit(0.0))
    joined = rows.join(cells, list(MARGINS), "left").withColumn("chance", F.coalesce(chance, F.lit(0.0)))
    taken = draw(F.col("key"), seed) < F.col("chance")
    return joined.select(F.col("key").alias(key), *MARGINS, "n_tokens", "chance", taken.alias("taken"))


def sampled(
    docs: DataFrame,
    power: float = 0.85,
    targets: dict[str, DataFrame] | None = None,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    share: float = SHARE,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, with all their columns."""
    names = {"key": key, "text": text, "source": source, "lang": lang}
    fit = plan(docs, power, targets, share, **names)[1]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = whole.select("row", F.struct(*[F.col("row")[name].alias(at) for at, name in names.items()]).alias("named"))
    cell = marked.select(
        "row", F.col("named.key").alias("key"),
        *[F.coalesce(F.col(f"named.{m}").cast("string"), F.lit(MISSING)).alias(m) for m in MARGINS[:2]],
        topic(F.coalesce(F.col("named.text"), F.lit(""))).alias("topic"),
        F.regexp_like(F.coalesce(F.col("named.text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")).alias("has_words"),
    )
    joined = cell.join(fit.cells.select(*MARGINS, "chance"), list(MARGINS))
    return joined.where((draw(F.col("key"), seed) < F.col("chance")) & F.col("has_words")).select("row.*")
