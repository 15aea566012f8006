"""Data contracts: a table's types, nulls and values, checked in one pass.

A contract is a list of named conditions that every row must meet. Columns are first cast where they can be (a value
that cannot be is a violation); columns that the contract does not name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DIMENSIONS


class ContractError(ValueError):
    """Violations by rule."""


@dataclass(frozen=True)
class Contract:
    types: dict[str, str]
    required: tuple[str, ...]
    rules: tuple[tuple[str, str], ...]

    def plus(self, types: dict[str, str], required: tuple[str, ...] = (), rules: tuple[tuple[str, str], ...] = ()) -> Contract:
        return Contract(self.types | types, self.required + required, self.rules + rules)


RAW = Contract(
    {"headline": "string", "label_clickbait": "int", "source": "string", "outlet": "string"},
    ("headline", "label_clickbait", "source"),
    (("headline_length", "length(headline) >= 1"), ("label_domain", "label_clickbait IN (0, 1)")),
)
DEDUPED = RAW.plus({"dup_group": "bigint"}, ("dup_group",))
SPLIT = DEDUPED.plus({"split": "string"}, ("split",), (("split_domain", "split IN ('train', 'val', 'test')"),))


def coerced(df: DataFrame, contract: Contract) -> DataFrame:
    """df with the contract's columns cast to its types; what cannot be cast is null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in contract.types.items() if c in df.columns})


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, violations): how many rows break each rule. One pass, one row for each rule."""
    missing = [c for c in contract.types if c not in df.columns and c in contract.required]
    if missing:
        raise ContractError(f"columns are missing: {missing}")
    checks: dict[str, Column] = {}
    cast = coerced(df.withColumns({f"_raw_{c}": F.col(c) for c in contract.types if c in df.columns}), contract)
    for c in contract.types:
        if c in df.columns:
            checks[f"type:{c}"] = F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull()
    for c in contract.required:
        checks[f"null:{c}"] = F.col(f"_raw_{c}").isNull()
    for name, rule in contract.rules:
        checks[f"rule:{name}"] = ~F.expr(rule)
    counts = cast.agg(*[F.coalesce(F.sum(F.coalesce(bad, F.lit(False)).cast("bigint")), F.lit(0)).alias(k) for k, bad in checks.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("violations")) for k in checks])
    return counts.select(F.explode(pairs).alias("p")).select("p.rule", "p.violations")


def validated(df: DataFrame, contract: Contract) -> DataFrame:
    """df in the contract's types, or an error that tells the broken rules."""
    broken = {r["rule"]: r["violations"] for r in violations(df, contract).where("violations > 0").collect()}
    if broken:
        raise ContractError(f"rows break {broken}")
    return coerced(df, contract)


# --- requests and label responses -----------------------------------------------------------

REQUESTS = {
    "score": "length(headline) BETWEEN 1 AND 500",
    "batch_item": "headline IS NOT NULL AND length(headline) <= 500",
    "delivery_gap": "length(headline) BETWEEN 1 AND 500 AND length(body) BETWEEN 1 AND 20000",
    "feedback": "length(headline) BETWEEN 1 AND 500 AND user_verdict IN ('agree', 'too_high', 'too_low') AND (comment IS NULL OR length(comment) <= 1000)",
}


def with_validity(df: DataFrame, kind: str) -> DataFrame:
    """df with ``valid``; rows that are not can be kept apart."""
    return df.withColumn("valid", F.coalesce(F.expr(REQUESTS[kind]), F.lit(False)))


def valid_batches(df: DataFrame, batch: str, most: int = 100) -> DataFrame:
    """Items of batches that hold 1 to ``most`` items, all of them of a valid length."""
    ok = with_validity(df, "batch_item").groupBy(batch).agg(F.count("*").alias("n"), F.min("valid").alias("valid")).where(F.col("valid") & (F.col("n") <= most))
    return df.join(ok.select(batch), batch, "left_semi")


def meets_label_schema(response: Column) -> Column:
    """Whether a JSON text is an object of exactly the dimensions, each a whole number 0, 1 or 2, and out_of_scope, a boolean."""
    parsed = F.try_parse_json(response)
    kinds = {d: "BIGINT" for d in DIMENSIONS} | {"out_of_scope": "BOOLEAN"}
    shape = "OBJECT<" + ", ".join(f"{k}: {kinds[k]}" for k in sorted(kinds)) + ">"
    domain = F.lit(True)
    for d in DIMENSIONS:
        domain = domain & F.try_variant_get(parsed, f"$.{d}", "bigint").isin(0, 1, 2)
    return F.coalesce((F.schema_of_variant(parsed) == shape) & domain, F.lit(False))


def coerce_label(c: Column) -> Column:
    """A response's value as 0, 1 or 2: rounded half to even, clamped; what is no finite number counts as 0."""
    number = c.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(2.0), number)), 0).cast("int")).otherwise(0)
