"""The whole batch, from texts to written tables, reported as rows."""

from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.functions import costs
from adjudica.operators import regimes
from adjudica.operators.decisions import adm_joint
from adjudica.plans import intake
from adjudica.registry import query
from adjudica.registry.texts import _EXTRACTED
from adjudica.sources import bindings, scratch

_BATCH = _EXTRACTED + """, c as (select * from x where holder_name is not null and premium is not null and zip_code is not null and age is not null),
j as (select *, (case when zip_code like '9%' then 5e-1 else 0e0 end) + (case when age < 25 then 6e-1 else 0e0 end) as score from c)
select count(*) as extracted, cast((select sum(tokens) from x) as bigint) as tokens, cast(0 as bigint) as quarantined,
  count(*) filter (premium > 0 and score < 1e0) as contracts, count(*) filter (not (premium > 0 and score < 1e0)) as rejections,
  count(*) filter (premium <= 0) as premium_rule from j"""


def _total(texts):
    tokens = costs.extract_tokens(F.col("text"), len(schemas.extraction_fields(schemas.PROPOSAL)))
    return texts.agg(F.sum(tokens)).first()[0]


@query(_EXTRACTED + " select true as refused, cast(sum(tokens) as bigint) as tokens, 0 as written from x")
def batch_refused(spark, sf_dir):
    """A batch that costs one token more than its cap is refused and leaves nothing behind."""
    texts, out = bindings.raw_texts(spark, sf_dir), scratch.new_path(spark, "refused")
    total, refused = _total(texts), False
    try:
        intake.run(texts, out, regimes.proposal_joint(0.5, 0.6).decisions, adm_joint(1.0), max_tokens=total - 1)
    except intake.BudgetExceeded:
        refused = True
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    written = int(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))
    return spark.createDataFrame([(refused, total, written)], "refused boolean, tokens bigint, written int")


@query(_BATCH)
def batch_run(spark, sf_dir):
    result = intake.run(
        bindings.raw_texts(spark, sf_dir),
        scratch.new_path(spark, "batch"),
        regimes.proposal_joint(0.5, 0.6).decisions,
        adm_joint(1.0),
        max_tokens=_total(bindings.raw_texts(spark, sf_dir)),
        tokenise=True,
    )
    row = (
        result.extracted,
        result.tokens,
        result.quarantined,
        result.contracts,
        result.rejections,
        result.rule_breakdown.get("premium", 0),
    )
    return spark.createDataFrame(
        [row],
        "extracted bigint, tokens bigint, quarantined bigint, contracts bigint, rejections bigint, premium_rule bigint",
    )


@query(
    _EXTRACTED + """, o as (select x.*, t.seq, sum(x.tokens) over (order by t.seq rows unbounded preceding) as total from x join t using (text_id)),
limits as (select sum(tokens) * 3 // 5 as cap from x),
paid as (select o.* from o, limits where total <= cap),
c as (select * from paid where holder_name is not null and premium is not null and zip_code is not null and age is not null)
select count(*) as extracted, cast((select sum(tokens) from paid) as bigint) as tokens, true as breached,
  count(*) filter (premium <= 0) as premium_rule from c"""
)
def batch_stopped(spark, sf_dir):
    """A batch with three fifths of what it costs stops at the first call that it cannot pay."""
    texts = bindings.raw_texts(spark, sf_dir)
    result = intake.run(
        texts,
        scratch.new_path(spark, "stopped"),
        regimes.proposal_joint(0.5, 0.6).decisions,
        adm_joint(1.0),
        max_tokens=_total(texts) * 3 // 5,
        stop_in_order=["seq"],
    )
    row = (result.extracted, result.tokens, result.breached, result.rule_breakdown.get("premium", 0))
    return spark.createDataFrame([row], "extracted bigint, tokens bigint, breached boolean, premium_rule bigint")
