"""Extraction, token accounting, budgets and letters."""

from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.functions import costs
from adjudica.operators import budget, extraction, letters
from adjudica.plans import outcomes
from adjudica.registry import query, r6
from adjudica.registry.tables import _JOINT_P, joint_proposals
from adjudica.sources import bindings

FIELDS = schemas.extraction_fields(schemas.PROPOSAL)

_TEXTS = f"with t as ({bindings.RAW_TEXTS})"
_EXTRACTED = _TEXTS + r""", x as (select text_id, seq,
  nullif(trim(regexp_extract(text, '(?i)holder\s*(?:is|:)\s*([A-Za-z][A-Za-z\- ]*?)(?:[.,;]|$)', 1)), '') as holder_name,
  try_cast(nullif(regexp_extract(text, '(?i)premium\s*(?:is|:)\s*\$?(-?\d+(?:\.\d+)?)', 1), '') as double) as premium,
  nullif(regexp_extract(text, '(?:^|[^\pL\pN_])(\d{5})(?:$|[^\pL\pN_])', 1), '') as zip_code,
  try_cast(nullif(regexp_extract(text, '(?i)(?:^|[^\pL\pN_])age\s*(?:is|:)\s*(\d{1,3})(?:$|[^\pL\pN_])', 1), '') as int) as age,
  greatest(1, length(text) // 4 + 20) as tokens from t)"""


@query(
    _EXTRACTED + " select text_id, holder_name, round(premium, 6) as premium, zip_code, age, "
    "cast(null as varchar) as nickname from x"
)
def extract_fields(spark, sf_dir):
    df = extraction.extract_fields(bindings.raw_texts(spark, sf_dir), [*FIELDS, "nickname"])
    return df.select(
        "text_id", "holder_name", r6("premium").alias("premium"), "zip_code", "age", "nickname"
    )


@query(
    _EXTRACTED + " select text_id, holder_name, round(premium, 6) as premium, zip_code, age from x "
    "where holder_name is not null and premium is not null and zip_code is not null and age is not null"
)
def complete_extractions(spark, sf_dir):
    df = extraction.extract_proposals(bindings.raw_texts(spark, sf_dir), schemas.PROPOSAL)
    return df.select("text_id", "holder_name", r6("premium").alias("premium"), "zip_code", "age")


@query(_TEXTS + " select text_id, cast(greatest(1, length(text) // 4 + 20) as bigint) as tokens from t")
def extraction_tokens(spark, sf_dir):
    texts = bindings.raw_texts(spark, sf_dir)
    return texts.select("text_id", costs.extract_tokens(F.col("text"), len(FIELDS)).alias("tokens"))


@query(
    _TEXTS + " select text_id, concat('[mock-completion] ', text) as completion, "
    "cast(greatest(1, length(text) // 4) as bigint) as tokens from t"
)
def completion_tokens(spark, sf_dir):
    text = F.col("text")
    return bindings.raw_texts(spark, sf_dir).select(
        "text_id",
        costs.complete_text(text).alias("completion"),
        costs.complete_tokens(text).alias("tokens"),
    )


# Three fifths of what all calls would cost: the cap grows with the table.
_COSTS = _TEXTS + """, c as (select text_id, seq, seq // 50 as batch, greatest(1, length(text) // 4 + 20) as tokens from t),
limits as (select sum(tokens) * 3 // 5 as cap from c)"""


def _spending(spark, sf_dir):
    texts = bindings.raw_texts(spark, sf_dir).select(
        "text_id",
        "seq",
        F.floor(F.col("seq") / 50).alias("batch"),
        costs.extract_tokens(F.col("text"), len(FIELDS)).alias("tokens"),
    )
    return texts, texts.agg(F.sum("tokens")).first()[0] * 3 // 5


@query(
    _COSTS + """, r as (select text_id, sum(tokens) over (order by seq rows unbounded preceding) as total from c),
b as (select max(total) > any_value(cap) as breached, max(case when total <= cap then total end) as spent from r, limits)
select text_id, breached, cast(spent as bigint) as spent from r, b, limits where total <= cap"""
)
def within_budget(spark, sf_dir):
    texts, cap = _spending(spark, sf_dir)
    paid = budget.within_budget(texts, ["seq"], F.col("tokens"), cap)
    return paid.rows.select(
        "text_id", F.lit(paid.breached).alias("breached"), F.lit(paid.spent).cast("bigint").alias("spent")
    )


@query(
    _COSTS + """, r as (select batch, tokens, sum(tokens) over (order by batch, tokens rows unbounded preceding) as total from c)
select batch, count(*) as calls, cast(sum(tokens) as bigint) as charged,
  (select cast(max(total) as bigint) from r, limits where total <= cap) as spent
from r, limits where total <= cap group by batch"""
)
def within_budget_ties(spark, sf_dir):
    """Calls of a batch share their place in the order; those charged before the breach stay."""
    texts, cap = _spending(spark, sf_dir)
    paid = budget.within_budget(texts, ["batch"], F.col("tokens"), cap)
    return paid.rows.groupBy("batch").agg(
        F.count("*").alias("calls"),
        F.sum("tokens").alias("charged"),
        F.first(F.lit(paid.spent).cast("bigint")).alias("spent"),
    )


@query(
    _COSTS + """, r as (select text_id, sum(tokens) over (order by seq rows unbounded preceding) as total from c)
select text_id, cast(total as bigint) as running_tokens, total <= cap as within from r, limits"""
)
def running_spend(spark, sf_dir):
    texts, cap = _spending(spark, sf_dir)
    return budget.running_spend(texts, ["seq"], F.col("tokens"), cap).select(
        "text_id", "running_tokens", "within"
    )


_LETTERS = f"""with p as ({bindings.PROPOSALS}), {_JOINT_P}, l as (
  select *, concat('Draft a polite rejection letter. Reasons: premium: premium is not above zero. Risk context: ',
    cast(score as varchar), '.') as prompt from violations where not (rules = '' and score < 1e0))
select proposal_id, case when rules = '' then 'No violations found.' else concat('[mock-completion] ', prompt) end as explanation,
  cast(case when rules = '' then 0 else greatest(1, length(prompt) // 4) end as bigint) as explanation_tokens from l"""


@query(_LETTERS)
def rejection_letters(spark, sf_dir):
    rejections = outcomes.split_outcomes(joint_proposals(spark, sf_dir)).rejections
    return letters.rejection_letters(rejections).select(
        "proposal_id", "explanation", "explanation_tokens"
    )


@query(_LETTERS.replace("select proposal_id, case", "select proposal_id, prompt, case").replace("prompt, case when rules = '' then 'No", "case when rules = '' then null else prompt end as prompt, case when rules = '' then 'No"))
def letter_prompts(spark, sf_dir):
    rejections = outcomes.split_outcomes(joint_proposals(spark, sf_dir)).rejections
    violations, risk = F.col("payload.violations"), letters.number_text(F.col("payload.score"))
    letter = letters.explain(violations, risk)
    return rejections.select(
        "proposal_id",
        F.when(F.size(violations) > 0, letters.prompt(violations, risk)).alias("prompt"),
        letter["text"].alias("explanation"),
        letter["tokens"].alias("explanation_tokens"),
    )
