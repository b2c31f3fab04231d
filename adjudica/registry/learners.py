"""Credibility states, online regression, learner algebra and snapshots."""

from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.operators import learners, ordered, parallel_fold
from adjudica.registry import query, r6
from adjudica.sources import bindings, observation_log, scratch

ORDER = ["ts", "event_id"]
ETA = 0.01

_O = f"with o as ({bindings.OBSERVATIONS})"
_POSTERIOR = """round((5e-1 * 5e1 + sum(observation) / 25e0) / (5e-1 + count(*) / 25e0), 6)"""


@query(
    _O + f" select learner_id, round(5e-1 + count(*) / 25e0, 6) as posterior_precision, {_POSTERIOR} as posterior_mean, "
    "count(*) as n from o group by learner_id"
)
def credibility_state(spark, sf_dir):
    states = learners.credibility_state(bindings.observations(spark, sf_dir))
    return states.select(
        "learner_id",
        r6("posterior_precision").alias("posterior_precision"),
        r6("posterior_mean").alias("posterior_mean"),
        "n",
    )


@query(
    "select concat('u', cast(user_id as varchar)) as learner_id from events group by user_id "
    "having count(distinct event_type = 'purchase') > 1"
)
def credibility_prior_conflicts(spark, sf_dir):
    bindings.tables(spark, sf_dir, "events")
    mixed = spark.sql(
        "select concat('u', cast(user_id as string)) as learner_id, case when event_type = 'purchase' then 50e0 else 10e0 end as mu0, "
        "5e-1 as kappa0, 25e0 as sigma2 from events"
    )
    return learners.prior_conflicts(mixed)


_WANTED = "select distinct concat('u', cast(user_id * 2 as varchar)) as learner_id from events where event_type = 'error'"


def _lookup_frames(spark, sf_dir):
    states = learners.credibility_state(bindings.observations(spark, sf_dir))
    wanted = spark.sql(
        "select concat('u', cast(user_id * 2 as string)) as learner_id from events where event_type = 'error'"
    )
    return states, wanted


@query(
    _O + f", s as (select learner_id, {_POSTERIOR} as posterior_mean from o group by learner_id) "
    f"select * from s where learner_id in ({_WANTED})"
)
def credibility_lookup(spark, sf_dir):
    found = learners.lookup(*_lookup_frames(spark, sf_dir))
    return found.select("learner_id", r6("posterior_mean").alias("posterior_mean"))


@query(_O + f" select * from ({_WANTED}) w where learner_id not in (select learner_id from o)")
def credibility_unknown(spark, sf_dir):
    return learners.unknown(*_lookup_frames(spark, sf_dir))


_REPLAY = f"""with recursive o as (select *, row_number() over (partition by learner_id order by ts, event_id) as rn from ({bindings.OBSERVATIONS}) q),
f as (select distinct learner_id, cast(0 as bigint) as rn, 5e1 as mean, 5e-1 as precision from o
  union all
  select f.learner_id, o.rn, (f.precision * f.mean + o.observation / 25e0) / (f.precision + 1e0 / 25e0), f.precision + 1e0 / 25e0
  from f join o on o.learner_id = f.learner_id and o.rn = f.rn + 1)
"""
_LAST = "f where (learner_id, rn) in (select learner_id, max(rn) from f group by learner_id)"


@query(
    _REPLAY + f"select learner_id, round(mean, 6) as mean, round(precision, 6) as precision, rn as n from {_LAST}"
)
def credibility_replay(spark, sf_dir):
    out = learners.credibility_replay(bindings.observations(spark, sf_dir), ORDER)
    return out.select("learner_id", r6("mean").alias("mean"), r6("precision").alias("precision"), "n")


@query(
    _REPLAY + f"select learner_id, round(mean, 6) as mean, round(precision, 6) as precision, rn as n from {_LAST}"
)
def credibility_fold(spark, sf_dir):
    """The same replay, folded update by update through the learner algebra."""
    out = learners.fit_in_order(
        bindings.observations(spark, sf_dir),
        learners.credibility(50.0, 0.5, 25.0),
        ORDER,
        F.lit(0.0),
        F.col("observation"),
    )
    return out.select(
        "learner_id", r6("state.mean").alias("mean"), r6("state.precision").alias("precision"), "n"
    )


# A third of all rows is one learner's, and a part of them has no learner.
SKEWED = f"""select case when event_id % 7 = 0 then null when event_id % 3 = 0 then 'hot' else learner_id end as learner_id,
  ts, event_id, case when event_id % 5 = 0 then null else observation end as observation from ({bindings.OBSERVATIONS}) q"""


@query(
    f"""with o as ({SKEWED.replace("case when event_id % 5 = 0 then null else observation end", "observation")})
select learner_id, round((5e-1 * 5e1 + sum(observation) / 25e0) / (5e-1 + count(*) / 25e0), 6) as mean, count(*) as n from o group by learner_id"""
)
def credibility_fold_sliced(spark, sf_dir):
    """Folded in many slices, over one learner with a third of the rows and rows without a learner."""
    bindings.tables(spark, sf_dir, "events")
    rows = spark.sql(SKEWED.replace("case when event_id % 5 = 0 then null else observation end", "observation"))
    longest = rows.groupBy("learner_id").count().agg(F.max("count")).first()[0]
    out = learners.fit_in_order(
        rows, learners.credibility(50.0, 0.5, 25.0), ORDER, F.lit(0.0), F.col("observation"),
        slice_rows=max(1, longest // 4),
    )
    return out.select("learner_id", r6("state.mean").alias("mean"), "n")


@query(
    f"""with o as ({SKEWED}) select event_id,
  round(sum(observation) over (partition by learner_id order by ts, event_id rows unbounded preceding), 6) as total from o"""
)
def running_sum_with_nulls(spark, sf_dir):
    """Running sums of values of which every fifth is NULL, over a hot and a NULL key."""
    bindings.tables(spark, sf_dir, "events")
    summed = ordered.running_sums(spark.sql(SKEWED), ["learner_id"], ORDER, {"total": F.col("observation")}, segments=16)
    return summed.select("event_id", r6("total").alias("total"))


@query(
    _REPLAY + "select o.event_id, f.learner_id, round(f.mean, 6) as mean, f.rn as n from f join o on o.learner_id = f.learner_id and o.rn = f.rn"
)
def credibility_path(spark, sf_dir):
    path = learners.credibility_path(bindings.observations(spark, sf_dir), ORDER)
    return path.select("event_id", "learner_id", r6("mean").alias("mean"), "n")


@query(
    _O + """, s as (select learner_id, count(*) as n, avg(observation) as x, count(*) / (count(*) + 5e-1 * 25e0) as z from o group by learner_id)
select learner_id, n, round(z, 6) as z, round(z * x + (1e0 - z) * 5e1, 6) as mean from s"""
)
def credibility_factor(spark, sf_dir):
    out = learners.credibility_factor(bindings.observations(spark, sf_dir))
    return out.select("learner_id", "n", r6("z").alias("z"), r6("mean").alias("mean"))


@query(
    _O + f" select learner_id, {_POSTERIOR} as posterior_mean, count(*) as n from o where ts <= timestamp '2024-01-15 12:00:00' group by learner_id"
)
def state_as_of(spark, sf_dir):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    states = learners.state_as_of(bindings.observations(spark, sf_dir), at)
    return states.select("learner_id", r6("posterior_mean").alias("posterior_mean"), "n")


@query(
    _O + """, q as (select event_id as question, concat('u', cast(user_id as varchar)) as learner_id, ts from events where event_type = 'signup')
select q.question, q.learner_id, count(o.observation) as n,
  round((5e-1 * 5e1 + coalesce(sum(o.observation), 0e0) / 25e0) / (5e-1 + count(o.observation) / 25e0), 6) as mean
from q left join o on o.learner_id = q.learner_id and o.ts <= q.ts group by q.question, q.learner_id"""
)
def state_as_of_each(spark, sf_dir):
    observed = bindings.observations(spark, sf_dir)
    questions = spark.sql(
        "select event_id as question, concat('u', cast(user_id as string)) as learner_id, ts from events where event_type = 'signup'"
    )
    out = learners.credibility_as_of(observed, questions, "question", (50.0, 0.5, 25.0))
    return out.select("question", "learner_id", "n", r6("mean").alias("mean"))


def _stored_log(spark, sf_dir):
    """The log in four appends, one of them given twice, the last not yet in the index."""
    rows = bindings.observations(spark, sf_dir)
    log = observation_log.ObservationLog(spark, scratch.new_path(spark, "observations"))
    columns = schemas.OBSERVATIONS.names
    for part in (0, 1, 1, 2):
        log.append(rows.where(F.col("event_id") % 4 == part).select(*columns), f"part-{part}")
        log.refresh()
    log.append(rows.where(F.col("event_id") % 4 == 3).select(*columns), "part-3")
    return log


@query(_O + " select learner_id, count(*) as n, round(sum(observation), 4) as total, min(ts) as first_ts from o group by learner_id")
def observations_stored(spark, sf_dir):
    """The stored log after its appends, read back: a repeated append adds nothing."""
    return _stored_log(spark, sf_dir).read().groupBy("learner_id").agg(
        F.count("*").alias("n"), F.round(F.sum("observation"), 4).alias("total"), F.min("ts").alias("first_ts")
    )


@query(
    _O + """, q as (select event_id as question, concat('u', cast(user_id as varchar)) as learner_id, ts from events where event_type = 'signup')
select q.question, q.learner_id, count(o.observation) as n,
  round((5e-1 * 5e1 + coalesce(sum(o.observation), 0e0) / 25e0) / (5e-1 + count(o.observation) / 25e0), 6) as mean
from q left join o on o.learner_id = q.learner_id and o.ts <= q.ts group by q.question, q.learner_id"""
)
def state_from_index(spark, sf_dir):
    """States as of each question's instant, from one bucket of the index and of the log."""
    log = _stored_log(spark, sf_dir)
    bindings.tables(spark, sf_dir, "events")
    questions = spark.sql(
        "select event_id as question, concat('u', cast(user_id as string)) as learner_id, ts from events where event_type = 'signup'"
    )
    out = log.state_as_of(questions, "question", (50.0, 0.5, 25.0))
    return out.select("question", "learner_id", "n", r6("mean").alias("mean"))


_SGD = f"""with recursive p as (select *, row_number() over (partition by learner_id order by ts, event_id) as rn from ({bindings.POINTS}) q),
m as (select learner_id, max(rn) as n from p group by learner_id),
f as (select learner_id, cast(0 as bigint) as rn, 0e0 as w0, 0e0 as w1 from m
  union all
  select f.learner_id, f.rn + 1, f.w0 - 1e-2 * (f.w0 * p.x0 + f.w1 * p.x1 - p.y) * p.x0, f.w1 - 1e-2 * (f.w0 * p.x0 + f.w1 * p.x1 - p.y) * p.x1
  from f join m on m.learner_id = f.learner_id join p on p.learner_id = f.learner_id and p.rn = 1 + f.rn % m.n where f.rn < PASSES * m.n),
w as (select f.learner_id, w0, w1, m.n from f join m on m.learner_id = f.learner_id and f.rn = PASSES * m.n)
"""


def _weights(points, **kwargs):
    return learners.sgd_fit(points, ORDER, ["x0", "x1"], "y", ETA, **kwargs)


def _two(frame):
    return frame.select(
        "learner_id", r6(F.col("w")[0]).alias("w0"), r6(F.col("w")[1]).alias("w1"), "n"
    )


_TWO = "select learner_id, round(w0, 6) as w0, round(w1, 6) as w1, n from w"


@query(_SGD.replace("PASSES", "1") + _TWO)
def sgd_fit(spark, sf_dir):
    return _two(_weights(bindings.points(spark, sf_dir)))


@query(_SGD.replace("PASSES", "5") + _TWO)
def sgd_fit_epochs(spark, sf_dir):
    return _two(_weights(bindings.points(spark, sf_dir), epochs=5))


@query(_SGD.replace("PASSES", "1") + _TWO)
def sgd_fold(spark, sf_dir):
    """The same fit, folded point by point through the learner algebra."""
    points = bindings.points(spark, sf_dir)
    out = learners.fit_in_order(
        points, learners.linear(ETA, [0.0, 0.0]), ORDER, F.array("x0", "x1"), F.col("y")
    )
    return _two(out.withColumnRenamed("state", "w"))


@query(
    _SGD.replace("PASSES", "1") + "select p.event_id, round(w.w0 * p.x0 + w.w1 * p.x1, 6) as prediction from p join w using (learner_id)"
)
def linear_predict(spark, sf_dir):
    points = bindings.points(spark, sf_dir)
    scored = learners.linear_scores(points, _weights(points), ["x0", "x1"], "y", ETA)
    return scored.select("event_id", r6("prediction").alias("prediction"))


@query(
    _SGD.replace("PASSES", "1") + """select p.event_id,
  round(p.x0 - 1e-2 * (w.w0 * p.x0 + w.w1 * p.x1 - p.y) * w.w0, 6) as x0, round(p.x1 - 1e-2 * (w.w0 * p.x0 + w.w1 * p.x1 - p.y) * w.w1, 6) as x1
from p join w using (learner_id)"""
)
def linear_request(spark, sf_dir):
    points = bindings.points(spark, sf_dir)
    scored = learners.linear_scores(points, _weights(points), ["x0", "x1"], "y", ETA)
    return scored.select(
        "event_id", r6(F.col("request")[0]).alias("x0"), r6(F.col("request")[1]).alias("x1")
    )


@query("select event_id, round(value, 6) as prediction, round(value / 2e0, 6) as request from events")
def identity_learner(spark, sf_dir):
    bindings.tables(spark, sf_dir, "events")
    same = learners.identity()
    state = same.initial()
    return spark.table("events").select(
        "event_id",
        r6(same.implement(state, F.col("value"))).alias("prediction"),
        r6(same.request(state, F.col("value"), F.col("value") / 2)).alias("request"),
    )


# f: two inputs to one number, started at (0.1, 0.2); g: one number to one number, started at 0.5.
_COMPOSED = f"""with recursive p as (select *, row_number() over (partition by learner_id order by ts, event_id) as rn from ({bindings.POINTS}) q),
m as (select learner_id, max(rn) as n from p group by learner_id),
f as (select learner_id, cast(0 as bigint) as rn, 1e-1 as a, 2e-1 as b, 5e-1 as g from m
  union all
  select learner_id, rn + 1, a - 1e-2 * (out - target) * x0, b - 1e-2 * (out - target) * x1, g - 1e-2 * (g * out - y) * out
  from (select s.*, out - 1e-2 * (g * out - y) * g as target from
    (select f.learner_id, f.rn, f.a, f.b, f.g, p.x0, p.x1, p.y, f.a * p.x0 + f.b * p.x1 as out
     from f join p on p.learner_id = f.learner_id and p.rn = f.rn + 1) s) t)
"""


@query(
    _COMPOSED + "select f.learner_id, round(a, 6) as a, round(b, 6) as b, round(g, 6) as g, m.n from f join m on m.learner_id = f.learner_id and m.n = f.rn"
)
def composed_learner(spark, sf_dir):
    both = learners.compose(
        learners.linear_scalar(ETA, 0.5), learners.linear(ETA, [0.1, 0.2])
    )
    out = learners.fit_in_order(
        bindings.points(spark, sf_dir), both, ORDER, F.array("x0", "x1"), F.col("y")
    )
    return out.select(
        "learner_id",
        r6(F.col("state.f")[0]).alias("a"),
        r6(F.col("state.f")[1]).alias("b"),
        r6("state.g").alias("g"),
        "n",
    )


@query(
    _COMPOSED + "select f.learner_id, round(a, 6) as a, round(b, 6) as b, round(g, 6) as g, m.n from f join m on m.learner_id = f.learner_id and m.n = f.rn"
)
def composed_learner_parallel(spark, sf_dir):
    """The composed learner with all chunks of a learner's history folded at once."""
    both = learners.compose(learners.linear_scalar(ETA, 0.5), learners.linear(ETA, [0.1, 0.2]))
    out = parallel_fold.fit_in_parallel(
        bindings.points(spark, sf_dir), both, ORDER, F.array("x0", "x1"), F.col("y"), chunk_rows=64
    )
    numbers = {"a": F.col("state.f")[0], "b": F.col("state.f")[1], "g": F.col("state.g")}
    return out.select("learner_id", *[r6(c).alias(n) for n, c in numbers.items()], "n")


@query(
    f"""with p as ({bindings.POINTS})
select learner_id, round((1e0 * 1e0 + sum(y) / 4e0) / (1e0 + count(*) / 4e0), 6) as first_mean,
  round((2e0 * 3e0 + sum(x0) / 9e0) / (2e0 + count(*) / 9e0), 6) as second_mean, count(*) as n from p group by learner_id"""
)
def parallel_learners(spark, sf_dir):
    both = learners.parallel(
        learners.credibility(1.0, 1.0, 4.0), learners.credibility(3.0, 2.0, 9.0)
    )
    nothing = F.lit(0.0)
    out = learners.fit_in_order(
        bindings.points(spark, sf_dir),
        both,
        ORDER,
        F.struct(nothing.alias("f"), nothing.alias("g")),
        F.struct(F.col("y").alias("f"), F.col("x0").alias("g")),
    )
    return out.select(
        "learner_id",
        r6("state.f.mean").alias("first_mean"),
        r6("state.g.mean").alias("second_mean"),
        "n",
    )


def _snapshots(spark, sf_dir):
    """One snapshot per learner and event type: the state after that type's events."""
    bindings.tables(spark, sf_dir, "events")
    typed = spark.sql(
        "select concat('u', cast(user_id as string)) as learner_id, event_type, sum(value) as total, count(*) as n, "
        "max(ts) as ts from events group by user_id, event_type"
    )
    return learners.snapshot(typed, F.length("event_type"), F.col("ts"), ["total", "n"])


# The version is the length of the event type's name; only the longest is a single type.
_SNAP = """with s as (select concat('u', cast(user_id as varchar)) as learner_id, length(event_type) as version, event_type,
  sum(value) as total, count(*) as n from events group by user_id, event_type)
"""


@query(_SNAP + "select learner_id, cast(version as bigint) as version, round(total, 4) as total, n from s")
def learner_snapshots(spark, sf_dir):
    rows = _snapshots(spark, sf_dir)
    return rows.select(
        "learner_id",
        "version",
        F.round(F.get_json_object("state_json", "$.total").cast("double"), 4).alias("total"),
        F.get_json_object("state_json", "$.n").cast("bigint").alias("n"),
    )


@query(
    _SNAP + "select learner_id, cast(version as bigint) as version, n from s where (learner_id, version) in "
    "(select learner_id, max(version) from s group by learner_id)"
)
def latest_snapshot(spark, sf_dir):
    newest = learners.latest_snapshot(_snapshots(spark, sf_dir))
    return newest.select(
        "learner_id", "version", F.get_json_object("state_json", "$.n").cast("bigint").alias("n")
    )


@query(
    _SNAP + "select learner_id, cast(version as bigint) as version, round(total + 1e0, 4) as total, n + 1 as n from s "
    "where (learner_id, version) in (select learner_id, max(version) from s group by learner_id)"
)
def snapshot_restore(spark, sf_dir):
    """The newest stored state of each learner as typed columns, and one more observation on it."""
    state = learners.restore(_snapshots(spark, sf_dir), "total double, n bigint")
    return state.select(
        "learner_id", "version", F.round(F.col("total") + 1, 4).alias("total"), (F.col("n") + 1).alias("n")
    )
