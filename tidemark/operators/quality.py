"""Data-quality rules, coverage gates, baselines and conformance checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import close_to, relative_delta
from tidemark.sources.schemas import ENVELOPE


@dataclass(frozen=True)
class Rule:
    """A check on the concepts of one statement.  `ok` maps the concepts' columns to a Boolean column.

    A rule applies where all its concepts are present; null or NaN inputs, and a null answer, are violations."""

    name: str
    concepts: tuple[str, ...]
    ok: Callable[[dict[str, Column]], Column]
    severity: str = "hard"
    modality: str = "financials"


A, AC, L, LC, E, LE = (f"us-gaap:{x}" for x in ("Assets", "AssetsCurrent", "Liabilities", "LiabilitiesCurrent", "StockholdersEquity", "LiabilitiesAndStockholdersEquity"))
ACCOUNTING_RULES = [
    Rule("assets_eq_liabilities_plus_equity", (A, L, E), lambda v: close_to(v[A], v[L] + v[E], 0.01), "soft"),
    Rule("assets_eq_liabilities_and_equity_alias", (A, LE), lambda v: close_to(v[A], v[LE], 0.01)),
    Rule("nonnegative_total_assets", (A,), lambda v: v[A] >= 0),
    Rule("current_assets_leq_total_assets", (A, AC), lambda v: v[AC] <= v[A] * 1.01),
    Rule("current_liabilities_leq_total_liabilities", (L, LC), lambda v: v[LC] <= v[L] * 1.01),
    Rule("nonnegative_equity", (E,), lambda v: v[E] >= 0, "soft"),
]

FURTHER_RULES = [
    Rule("nonnegative_liabilities", (L,), lambda v: v[L] >= 0),
    Rule("working_capital_leq_assets", (A, AC, LC), lambda v: v[AC] - v[LC] <= v[A]),
]
_CASH = ("CashPeriodIncreaseDecrease", "NetCashFromOperating", "NetCashFromInvesting", "NetCashFromFinancing")
CASH_FLOW = Rule("cash_flow_identity", _CASH, lambda v: close_to(v[_CASH[0]], v[_CASH[1]] + v[_CASH[2]] + v[_CASH[3]], 0.01))


def pivot_concepts(df: DataFrame, by: Sequence[str], concepts: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each statement: a struct(present, value) for each concept, the value being the latest by `order`."""
    columns = []
    for c in concepts:
        at = F.col("concept") == c
        columns.append(F.struct((F.count(F.when(at, 1)) > 0).alias("present"), F.max_by(F.when(at, F.col("value")), F.when(at, F.struct(*order))).alias("value")).alias(c))
    return df.filter(F.col("concept").isin(list(concepts))).groupBy(*by).agg(*columns)


def evaluate(wide: DataFrame, by: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(*by, rule, severity, modality, ok) for every rule that applies to a row of `pivot_concepts`."""

    def verdict(r: Rule) -> Column:
        cell = lambda c: F.col(f"`{c}`")
        applies = F.lit(True)
        sound = F.lit(True)
        for c in r.concepts:
            applies = applies & cell(c)["present"]
            sound = sound & F.coalesce(~F.isnan(cell(c)["value"]), F.lit(False))
        ok = sound & F.coalesce(r.ok({c: cell(c)["value"] for c in r.concepts}), F.lit(False))
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.modality).alias("modality"), applies.alias("applies"), ok.alias("ok"))

    return wide.select(*by, F.explode(F.array(*map(verdict, rules))).alias("v")).select(*by, "v.*").filter("applies").drop("applies")


def late_filings(filings: DataFrame, days: int = 90) -> DataFrame:
    """(accession, rule, severity, modality, ok): filed within `days` of the report date."""
    return filings.select("accession", F.lit("filed_in_time").alias("rule"), F.lit("hard").alias("severity"), F.lit("filings").alias("modality"), (F.datediff("filed", "report_date") <= days).alias("ok"))


def tally(verdicts: DataFrame) -> DataFrame:
    """Checks, violations and violation rate of each rule."""
    t = verdicts.groupBy("rule", "severity", "modality").agg(F.count(F.lit(1)).alias("checks"), F.sum((~F.col("ok")).cast("long")).alias("violations"))
    return t.withColumn("rate", F.col("violations") / F.col("checks"))


def by_modality(tallies: DataFrame, limit: float = 0.02) -> DataFrame:
    """Constraint-violation rate of each modality's hard rules, and whether it passes."""
    t = tallies.filter("severity = 'hard'").groupBy("modality").agg(F.sum("checks").alias("checks"), F.sum("violations").alias("violations")).filter("checks > 0")
    return t.withColumn("cvr", F.col("violations") / F.col("checks")).withColumn("passed", F.col("cvr") <= limit)


def gate(tallies: DataFrame, limit: float = 0.02) -> DataFrame:
    """One row: the rate of hard violations over all rules; without hard checks it passes."""
    t = tallies.filter("severity = 'hard'").agg(F.coalesce(F.sum("checks"), F.lit(0)).alias("hard_checks"), F.coalesce(F.sum("violations"), F.lit(0)).alias("hard_violations"))
    return t.withColumn("cvr", F.when(F.col("hard_checks") > 0, F.col("hard_violations") / F.col("hard_checks")).otherwise(0.0)).withColumn("passed", F.col("cvr") <= limit)


def examples(verdicts: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """Up to `n` violations of each rule, the smallest keys first."""
    w = Window.partitionBy("rule").orderBy(*by)
    return verdicts.filter("not ok").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def run_checks(checks: dict[str, Callable[[], tuple[bool, str, str]]], spark) -> DataFrame:
    """A row for each coverage check: name, passed, observed, message; a check that raises has failed with its error."""
    rows = []
    for name, check in checks.items():
        try:
            passed, observed, message = check()
        except Exception as error:  # a gate reports whatever goes wrong
            passed, observed, message = False, "", f"{type(error).__name__}: {error}"
        rows.append((name, bool(passed), str(observed), message))
    return spark.createDataFrame(rows, "name string, passed boolean, observed string, message string")


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(modality, n, is_empty) of each table."""
    counts = [df.agg(F.lit(m).alias("modality"), F.count(F.lit(1)).alias("n")) for m, df in tables.items()]
    return reduce(DataFrame.union, counts).withColumn("is_empty", F.col("n") == 0)


def breadth(tables: dict[str, DataFrame]) -> DataFrame:
    """(modality, entities, n) of each table."""
    return reduce(DataFrame.union, [df.agg(F.lit(m).alias("modality"), F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("n")) for m, df in tables.items()])


def coverage_checks(tables: dict[str, DataFrame], facts: DataFrame, sentinel: Column, modalities: int = 10, quarters: int = 60, entities: int = 1000) -> dict[str, Callable[[], tuple[bool, str, str]]]:
    """The coverage gates for `run_checks`: populated modalities, the upper median of entities' quarters, a known fact, entities (soft)."""
    per = facts.groupBy("entity_id").agg(F.count_distinct("fiscal_year", "fiscal_period").alias("q"))

    def populated():
        n = sizes(tables).filter("n > 0").count()
        return n >= modalities, n, f"at least {modalities} modalities"

    def median():
        hist = sorted(per.groupBy("q").count().collect())  # as many rows as there are different counts
        left = sum(r["count"] for r in hist) // 2
        for r in hist:
            left -= r["count"]
            if left < 0:
                return r.q >= quarters, r.q, f"at least {quarters} quarters"
        return False, 0, "no entities"

    def known():
        n = facts.filter(sentinel).count()
        return n > 0, n, "the known fact"

    def enough():
        n = per.count()
        return n >= entities, n, f"at least {entities} entities (soft)"

    return {"modalities": populated, "median_quarters": median, "sentinel": known, "entities": enough}


def roll_up(bars: DataFrame, by: str, period: str) -> DataFrame:
    """Daily bars (by, day, open, high, low, close, volume) as bars of a week, month or quarter from `start` on."""
    start = F.to_date(F.trunc("day", period))
    return bars.groupBy(by, start.alias("start")).agg(F.min_by("open", "day").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "day").alias("close"), F.sum("volume").alias("volume"))


def drift(now: DataFrame, before: DataFrame, keys: Sequence[str], value: str, limit: float = 0.05) -> DataFrame:
    """Full outer comparison of two baselines: missing sides count as 0; `material` where the relative change exceeds the limit."""
    a, b = now.select(*keys, F.col(value).alias("now")), before.select(*keys, F.col(value).alias("prior"))
    both = a.join(b, list(keys), "full_outer").withColumns({"now": F.coalesce("now", F.lit(0)), "prior": F.coalesce("prior", F.lit(0))})
    return both.withColumn("delta", relative_delta(F.col("now").cast("double"), F.col("prior").cast("double"))).withColumn("material", F.abs(F.col("delta")) > limit)


@dataclass(frozen=True)
class RatioRule:
    """A least ratio for the filings of an industry (by prefix of its code) that carry all of some policy tags.

    Of the rules of one constraint that apply to a filing, the one with the highest priority decides."""

    name: str
    constraint: str
    industry: str
    tags: tuple[str, ...]
    ratio: str
    least: float
    priority: int


def check_ratios(filings: DataFrame, rules: Sequence[RatioRule]) -> DataFrame:
    """A row for each filing (industry, policy_tags, financials: a map) and constraint that applies: `rule`, `ratio`, `violated`.

    All rules are decided in one pass over the rows, without a shuffle.  A filing without tags, or without the ratio that
    a rule names, isn't subject to that rule; a rule of lower priority then may be."""
    constraints = {}
    for rule in sorted(rules, key=lambda r: (-r.priority, r.name)):
        constraints.setdefault(rule.constraint, []).append(rule)
    decided = []
    for constraint, ranked in constraints.items():
        cases = []
        for rule in ranked:
            value = F.col("financials")[rule.ratio]
            tagged = [F.array_contains(F.coalesce("policy_tags", F.array().cast("array<string>")), tag) for tag in rule.tags]
            applies = reduce(lambda a, b: a & b, tagged, F.col("industry").startswith(rule.industry) & value.isNotNull())
            outcome = F.struct(F.lit(constraint).alias("constraint"), F.lit(rule.name).alias("rule"), value.alias("ratio"), (value < rule.least).alias("violated"))
            cases.append(F.when(applies, outcome))
        decided.append(F.coalesce(*cases))
    kept = [c for c in filings.columns if c not in ("policy_tags", "financials")]
    return filings.select(*kept, F.inline(F.filter(F.array(*decided), lambda x: x.isNotNull())))


def conformance(df: DataFrame) -> DataFrame:
    """One row of counts: envelope columns absent, and rows that break an envelope rule, in a single pass."""
    absent = [f.name for f in ENVELOPE.fields if f.name not in df.columns]
    has = lambda c: c not in absent
    bad = {
        "null_recorded_at": F.col("recorded_at").isNull() if has("recorded_at") else F.lit(True),
        "belief_range": ~F.coalesce(F.col("belief").between(0, 1), F.lit(False)) if has("belief") else F.lit(True),
        "certainty_range": ~F.coalesce(F.col("source_certainty").between(0, 1), F.lit(False)) if has("source_certainty") else F.lit(True),
        "empty_perspective": F.coalesce(F.col("perspective"), F.lit("")) == "" if has("perspective") else F.lit(True),
        "negative_uncertainty": ~F.coalesce(F.col("valid_from_uncertainty_days") >= 0, F.lit(False)) if has("valid_from_uncertainty_days") else F.lit(True),
    }
    return df.agg(F.lit(len(absent)).alias("absent_columns"), F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in bad.items()))


def bar_faults(bars: DataFrame) -> DataFrame:
    """Bars whose high is below the low, or whose close is outside both."""
    return bars.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("high") < F.col("low")).cast("long")).alias("high_below_low"), F.sum((~F.col("close").between(F.col("low"), F.col("high"))).cast("long")).alias("close_outside"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
