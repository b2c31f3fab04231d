"""Streaming forms, drained once; their results equal the batch ones."""

from pyspark.sql import functions as F

from adjudica.operators import regimes
from adjudica.operators.decisions import adm_joint
from adjudica.registry import names, query, r6
from adjudica.registry.learners import _COMPOSED, _O, _POSTERIOR, ETA
from adjudica.registry.tables import _JOINT_P
from adjudica.sources import bindings, scratch
from adjudica.streaming import intake, state, stateful


def _source(spark, sf_dir, table):
    """A test table as a file stream. The pattern matches that table's file alone."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}*.parquet")


def _proposals(stream):
    """The proposals binding over a streamed customer table."""
    view = "customer_stream"
    stream.createOrReplaceTempView(view)
    return stream.sparkSession.sql(bindings.PROPOSALS.replace("from customer", f"from {view}"))


def _events(spark, sf_dir, binding):
    _source(spark, sf_dir, "events").createOrReplaceTempView("event_stream")
    return spark.sql(binding.replace("from events", "from event_stream"))


def _judged(spark, sf_dir):
    out = scratch.new_path(spark, "stream")
    intake.judge_stream(
        _proposals(_source(spark, sf_dir, "customer")),
        out,
        f"{out}/checkpoint",
        regimes.proposal_joint(0.5, 0.6).decisions,
        adm_joint(1.0),
        keep=["proposal_id"],
    ).awaitTermination()
    return out


@query(
    f"with p as (select * from ({bindings.PROPOSALS}) where schema_version = 1), {_JOINT_P} "
    "select proposal_id, rules, round(score, 6) as score, rules = '' and score < 1e0 as admitted from violations"
)
def stream_outcomes(spark, sf_dir):
    df = spark.read.parquet(f"{_judged(spark, sf_dir)}/outcomes")
    return df.select(
        "proposal_id", names().alias("rules"), r6("payload.score").alias("score"), "admitted"
    )


@query(
    f"with p as ({bindings.PROPOSALS}) select proposal_id, schema_version as schema_version_seen, "
    "case when schema_version is null then 'missing schema_version' else 'unknown schema version' end as reason "
    "from p where schema_version is null or schema_version <> 1"
)
def stream_quarantine(spark, sf_dir):
    df = spark.read.parquet(f"{_judged(spark, sf_dir)}/quarantine")
    return df.select("proposal_id", "schema_version_seen", "reason")


@query(_O + f" select learner_id, {_POSTERIOR} as posterior_mean, count(*) as n from o group by learner_id")
def stream_credibility(spark, sf_dir):
    observed = _events(spark, sf_dir, bindings.OBSERVATIONS)
    out = scratch.new_path(spark, "stream")
    states = state.running_credibility(observed)
    state.write_states(states, f"{out}/states", f"{out}/checkpoint").awaitTermination()
    newest = state.current_states(spark.read.parquet(f"{out}/states"))
    return newest.select("learner_id", r6("posterior_mean").alias("posterior_mean"), "n")


@query(
    _O + ", once as (select learner_id, ts, min(observation) as observation from o group by learner_id, ts) "
    f"select learner_id, {_POSTERIOR} as posterior_mean, count(*) as n from once group by learner_id"
)
def stream_distinct_credibility(spark, sf_dir):
    """Every third event is delivered twice; repeats of (learner, time) count once."""
    observed = _events(spark, sf_dir, bindings.OBSERVATIONS)
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = scratch.new_path(spark, "stream")
    once = stateful.distinct_observations(observed.withColumn("delivery", F.explode(again)))
    stateful.write_sums(once, f"{out}/sums", f"{out}/checkpoint").awaitTermination()
    states = stateful.credibility_of_sums(spark.read.parquet(f"{out}/sums"))
    return states.select("learner_id", r6("posterior_mean").alias("posterior_mean"), "n")


@query(
    _COMPOSED + "select f.learner_id, round(a, 6) as a, round(b, 6) as b, round(g, 6) as g, m.n "
    "from f join m on m.learner_id = f.learner_id and m.n = f.rn"
)
def stream_composed_learner(spark, sf_dir):
    both = stateful.compose(stateful.linear(ETA, [0.5]), stateful.linear(ETA, [0.1, 0.2]))
    results = stateful.running_learner(
        _events(spark, sf_dir, bindings.POINTS), both, F.col("ts"), F.col("event_id"),
        F.array("x0", "x1"), F.col("y"), delay_seconds=3600,
    )
    out = scratch.new_path(spark, "stream")
    stateful.write_learner(results, f"{out}/results", f"{out}/checkpoint").awaitTermination()
    log = spark.read.schema(stateful.RESULT).parquet(f"{out}/results")
    numbers = {name: F.col("state")[i] for i, name in enumerate("abg")}
    return stateful.newest_learners(log).select(
        "learner_id", *[r6(value).alias(name) for name, value in numbers.items()], "n"
    )
