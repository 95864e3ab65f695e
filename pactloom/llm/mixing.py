"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactloom.llm.staging import drop_staged, stage

NONE = "(none)"
DIMS = ("source", "lang", "topic")
#: A marginal's target share is proportional to its tokens to this power: below 1, large sources give way to small ones.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
FRACTION = 0.5
#: Rounds of raking: after 15 the marginals that can be met are within 1 per cent of their goals on the test tables.
ROUNDS = 15


def taken(text: Column, chars: str) -> Column:
    """How many of these ASCII characters a text holds."""
    return reduce(lambda a, b: a + b, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in chars])


def topic_of(text: Column) -> Column:
    """A coarse topic by the shape of a text, for corpora without a topic column; null texts are short."""
    n = F.length(text)
    return (
        F.when(n.isNull() | (n < 200), "short").when(taken(text, "|") * 100 >= n, "table").when(taken(text, "!") * 100 >= n, "shouting")
        .when(taken(text, "#$%&*") * 100 >= n * 2, "symbols").when(n > 8000, "long").otherwise("prose")
    )


def token_weight(text: Column) -> Column:
    """Words by their separators: one more than the blanks, tabs and line ends; 1 for a null text."""
    return F.coalesce(taken(text, " \t\r\n") + 1, F.lit(1)).cast("double")


def wanted(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame] | None, fraction: float) -> DataFrame:
    """(dim, value, have, want, goal): tokens there are, tokens by the target shares, and those that can be had.

    Shares are the given targets (dim, target), or else tokens ** TEMPER[dim]. A value without a target keeps its share of the tokens, one
    without cells has no effect; targets are weights and needn't add up to 1; a target of 0 or below leaves a value out. If all values of a marginal that
    have tokens are left out, nothing is drawn. A value that has fewer tokens than it should give is taken whole, and what it lacks is
    spread over the others by their shares, until all can give theirs: each round fixes one value or more.
    """
    pair = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])
    have = cells.select(F.explode(pair).alias("m"), "tokens").groupBy("m.dim", "m.value").agg(F.sum("tokens").alias("have"))
    power = reduce(lambda e, d: F.when(F.col("dim") == d, F.lit(TEMPER.get(d, 1.0))).otherwise(e), dims, F.lit(1.0))
    given = [t.select(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col("target").cast("double")) for d, t in (targets or {}).items() if d in dims]
    told = reduce(DataFrame.unionByName, given) if given else cells.sparkSession.createDataFrame([], "dim string, value string, target double")
    all_of = have.groupBy("dim").agg(F.sum("have").alias("all"))  # a row for each marginal
    own = F.col("have") / F.col("all") if given else F.lit(None).cast("double")
    is_given = F.col("dim").isin([d for d in (targets or {}) if d in dims])
    share = have.join(F.broadcast(all_of), "dim").join(told, ["dim", "value"], "left").withColumn("share", F.when(is_given, F.greatest(F.coalesce("target", own), F.lit(0.0))).otherwise(F.pow("have", power)))
    now = stage(share.select("dim", "value", "have", "share", F.lit(False).alias("whole"), (fraction * F.col("all")).alias("budget")), "wanted")
    first = True
    while True:
        rest = now.groupBy("dim").agg(F.sum(F.when(~F.col("whole"), F.col("share"))).alias("open"), F.sum(F.when(F.col("whole"), F.col("have")).otherwise(0.0)).alias("fixed"))
        step = now.join(F.broadcast(rest), "dim").withColumn("goal", F.when(F.col("whole"), F.col("have")).otherwise(F.coalesce(F.try_divide(F.col("share"), F.col("open")), F.lit(0.0)) * (F.col("budget") - F.col("fixed"))))
        step = step.withColumn("want", F.col("goal") if first else F.col("want")).withColumn("full", (F.col("goal") >= F.col("have")) & (F.col("have") > 0))
        before, now = now, stage(step.select("dim", "value", "have", "share", "budget", "want", F.least("goal", "have").alias("goal"), F.col("full").alias("whole"), (F.col("full") & ~F.col("whole")).alias("new")), "wanted")
        drop_staged(before)
        first = False
        if not now.where("new").count():
            return now.select("dim", "value", "have", "want", "goal")


def rake(cells: DataFrame, goals: DataFrame, dims: list[str], fraction: float, rounds: int = ROUNDS) -> DataFrame:
    """cells (dims..., tokens) with p: probabilities, 1 at most, whose expected tokens meet each marginal's goals.

    Each step scales the cells of a marginal value by goal / present tokens, counting no cell above its whole: the mass
    that a full cell can't give goes to the others of its value. A step is an aggregate and a join, staged at once, since
    a plan of several steps would double with each.
    """
    fixed = {d: stage(goals.where(F.col("dim") == d).select(F.col("value").alias(d), "goal"), f"goal_{d}") for d in dims}
    now = stage(cells.select(*dims, "tokens", F.lit(fraction).alias("r")), "cells")
    for _ in range(rounds):
        for dim, goal in fixed.items():
            given = now.groupBy(dim).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), "r")).alias("given"))
            factor = given.join(goal, dim).select(dim, F.coalesce(F.try_divide("goal", "given"), F.lit(0.0)).alias("factor"))
            before, now = now, stage(now.join(factor, dim).select(*dims, "tokens", (F.col("r") * F.col("factor")).alias("r")), "cells")
            drop_staged(before)
    return now.select(*dims, "tokens", F.least(F.lit(1.0), "r").alias("p"))


def reached(raked: DataFrame, goals: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, have, want, goal, got, gap): expected tokens of each marginal value, and |got - goal| / goal (got, where the goal is 0).

    want above have: the target can't be reached, as the corpus lacks the tokens.
    """
    pair = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])
    got = raked.select(F.explode(pair).alias("m"), (F.col("tokens") * F.col("p")).alias("t")).groupBy("m.dim", "m.value").agg(F.sum("t").alias("got"))
    return goals.join(got, ["dim", "value"]).withColumn("gap", F.when(F.col("goal") == 0, F.col("got")).otherwise(F.try_divide(F.abs(F.col("got") - F.col("goal")), F.col("goal"))))


def chance(id_col: Column) -> Column:
    """A uniform number in [0, 1) from the md5 of the id as text; the same for repeated ids and in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def traits(dims: dict[str, Column], text: Column) -> Column:
    """Struct of the marginal values and tokens of a document."""
    return F.struct(*[F.coalesce(c.cast("string"), F.lit(NONE)).alias(d) for d, c in dims.items()], token_weight(text).alias("tokens"))


def drawn(known: DataFrame, dims: list[str], fraction: float, targets: dict[str, DataFrame] | None, rounds: int) -> DataFrame:
    """The sampled rows of known (id, mix, ...), with probability."""
    cells = stage(known.groupBy(*[F.col(f"mix.{d}").alias(d) for d in dims]).agg(F.sum("mix.tokens").alias("tokens")), "sums")
    rate = rake(cells, wanted(cells, dims, targets, fraction), dims, fraction, rounds).select(*dims, "p")
    same = reduce(lambda a, b: a & b, [F.col(f"mix.{d}") == F.col(d) for d in dims])
    return known.join(rate, same).where(chance(F.col("id")) < F.col("p")).withColumn("mix", F.col("mix").withField("probability", F.col("p")))


def mix(docs: DataFrame, fraction: float = FRACTION, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of docs with all columns, and __mix: struct of source, lang, topic, tokens and probability.

    `fraction` of all tokens is drawn, so that each marginal's shares meet its targets as far as the corpus has the
    tokens (`wanted` says what targets of 0 and absent ones mean); `dims` gives other marginals, such as a topic column. Sampling is by document id, so repeated rows stay or
    go together. Null marginal values form the value (none); null texts weigh one token, as empty ones do; very long
    texts are read whole; no rows give no rows; a column __mix of docs is replaced.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text_col))}
    columns = [c for c in docs.columns if c != "__mix"]
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("id"), traits(dims, F.col(text_col)).alias("mix"))
    out = drawn(known, list(dims), fraction, targets, rounds)
    return out.select(*[F.col(f"row.`{c}`") for c in columns], F.col("mix").alias("__mix"))


def sample(docs: DataFrame) -> DataFrame:
    """The documents drawn: doc_id, source, lang, topic, tokens, probability (6 decimals). Texts are read once, for their traits."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}
    known = stage(docs.select(F.col("doc_id").alias("id"), traits(dims, F.col("text")).alias("mix")), "traits")
    out = drawn(known, list(dims), FRACTION, None, ROUNDS)
    return out.select(F.col("id").alias("doc_id"), "mix.source", "mix.lang", "mix.topic", F.col("mix.tokens").cast("bigint").alias("tokens"), F.round("mix.probability", 6).alias("probability"))


def sample_sql() -> str:
    steps, now = [], "c0"
    for i in range(ROUNDS):
        for dim in DIMS:
            nxt = f"c{i}{dim[0]}"
            steps.append(f"{nxt} AS MATERIALIZED (SELECT source, lang, topic, tokens, r * goal / sum(tokens * least(1.0, r)) OVER (PARTITION BY {dim}) AS r FROM {now} JOIN g_{dim} USING ({dim}))")
            now = nxt
    goals = [
        f"""h_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS have, pow(sum(tokens), {TEMPER[d]}) AS share FROM cells GROUP BY {d}),
w_{d} AS MATERIALIZED (SELECT *, ({FRACTION} * sum(have) OVER () - coalesce(sum(have) OVER (ORDER BY have / share, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY have / share, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM h_{d}),
g_{d} AS MATERIALIZED (SELECT {d}, CASE WHEN scale >= have / share THEN have ELSE share * (SELECT max_by(scale, -(have / share)) FROM w_{d} WHERE scale < have / share) END AS goal FROM w_{d})"""
        for d in DIMS
    ]
    gone = lambda chars: "length(text) - length(translate(text, '" + chars + "', ''))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
CASE WHEN text IS NULL OR length(text) < 200 THEN 'short' WHEN ({gone('|')}) * 100 >= length(text) THEN 'table' WHEN ({gone('!')}) * 100 >= length(text) THEN 'shouting'
WHEN ({gone('#$%&*')}) * 100 >= length(text) * 2 THEN 'symbols' WHEN length(text) > 8000 THEN 'long' ELSE 'prose' END AS topic,
coalesce(length(text) - length(translate(text, ' ' || chr(9) || chr(13) || chr(10), '')) + 1, 1)::DOUBLE AS tokens FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL),
{", ".join(goals)},
c0 AS MATERIALIZED (SELECT *, {FRACTION}::DOUBLE AS r FROM cells),
{", ".join(steps)},
rate AS (SELECT source, lang, topic, least(1.0, r) AS p FROM {now})
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(p, 6) AS probability FROM d JOIN rate USING (source, lang, topic)
WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 < p"""
