"""Extraction, costs, budgets and letters against plain Python on small texts."""

import re

import pytest
from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.functions import costs
from adjudica.functions.text import extract_field
from adjudica.operators import budget, extraction, letters, regimes
from adjudica.operators.decisions import adm_joint
from adjudica.plans import intake

TEXTS = [
    "Age: 41. The holder is Mira, premium: 120.5 and ZIP 20002.",
    "Holder: Jonas; ZIP 95110; age is 33; premium is -75.",
    "Premium: $310, age: 19, holder: Petra, zip code 96001.",
    "Nothing here can be read as a proposal.",
]

ODD = [
    "",
    "HOLDER IS mary-jane o neil;premium is 12.50 and 1234567 then 12345, age is 7",
    "holder: Ann\nPremium: $7",
    "holder: Zed\n",
    "policyholder: Al, premium: 3.",
    "age:300 age: 41",
    "wage: 50 age: 1234 Age:\t99",
    "premium: -0.5 premium: 9",
    "zip_12345 12345x x12345 54321",
    "Age: ٣٤. ZIP ١٢٣٤٥. Premium: ٧.٥",
    "Holder ıſ Ann. premıum İs 4",
    "é12345 ü99999 67890",
    "holder: A1. holder: Bee;",
    "holder: trailing blanks   , 00000",
    "age: 5² age: 6",
]


def _python_patterns():
    """The vocabulary as plain ``re`` patterns, to compare with."""
    name = re.compile(r"holder\s*(?:is|:)\s*([A-Za-z][A-Za-z\- ]*?)(?:[.,;]|$)", re.I)
    return {
        "holder_name": (name, str),
        "premium": (re.compile(r"premium\s*(?:is|:)\s*\$?(-?\d+(?:\.\d+)?)", re.I), float),
        "zip_code": (re.compile(r"\b(\d{5})\b"), str),
        "age": (re.compile(r"\bage\s*(?:is|:)\s*(\d{1,3})\b", re.I), int),
    }


def test_patterns_read_text_like_python(spark):
    rows = list(enumerate(TEXTS + ODD))
    df = spark.createDataFrame(rows, "i int, text string")
    fields = list(_python_patterns())
    got = {
        r["i"]: r
        for r in df.select("i", *[extract_field(F.col("text"), f).alias(f) for f in fields]).collect()
    }
    for i, text in rows:
        for name, (pattern, convert) in _python_patterns().items():
            match = pattern.search(text)
            want = convert(match.group(1).strip()) if match else None
            assert got[i][name] == want, (name, text)


def test_unknown_field_is_null(spark):
    df = spark.createDataFrame([(TEXTS[0],)], "text string")
    row = extraction.extract_fields(df, ["holder", "colour"]).first()
    assert row["holder"] == "Mira" and row["colour"] is None
    assert row["tokens"] == len(TEXTS[0]) // 4 + 10


def test_incomplete_rows_are_dropped(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert extraction.extract_proposals(df, schemas.PROPOSAL).count() == 3


def test_costs(spark):
    df = spark.createDataFrame([("",), ("abc",), ("x" * 2000,)], "t string")
    got = df.select(
        costs.extract_tokens(F.col("t"), 0), costs.complete_tokens(F.col("t"), 256), costs.complete_text(F.col("t"), 60)
    ).collect()
    assert [tuple(r)[:2] for r in got] == [(1, 1), (1, 1), (500, 256)]
    assert got[2][2] == "[mock-completion] " + "x" * 60


def calls(spark, tokens):
    return spark.createDataFrame(list(enumerate(tokens)), "i int, tokens int").repartition(3)


@pytest.mark.parametrize(
    "cap, want, spent, breached",
    [(0, 0, 0, True), (9, 0, 0, True), (10, 1, 10, True), (29, 1, 10, True), (30, 2, 30, True), (99, 3, 60, True), (100, 4, 100, False), (500, 4, 100, False)],
)
@pytest.mark.parametrize("segments", [1, 3])
def test_budget_stops_before_the_cap(spark, cap, want, spent, breached, segments):
    out = budget.within_budget(calls(spark, [10, 20, 30, 40]), ["i"], F.col("tokens"), cap, segments)
    assert sorted(r["i"] for r in out.rows.collect()) == list(range(want))
    assert (out.spent, out.breached) == (spent, breached)


def test_budget_where_a_third_of_the_calls_share_a_key(spark):
    """Ties are paid from the cheapest on, and alike calls as often as the cap allows; nothing goes through one task."""
    rows = [(i, 0 if i % 3 == 0 else i, 1 + i % 4, "x") for i in range(900)] + [(-1, 0, 7, "same")] * 50
    df = spark.createDataFrame(rows, "i int, k int, tokens int, t string").repartition(4)
    costs = sorted((k, tokens) for _, k, tokens, _ in rows)
    for cap in (0, 1, 300, 749, 750, 780, 1000, 1100, 2000, 10**6):
        total, want = 0, []
        for k, tokens in costs:
            if total + tokens > cap:
                break
            total += tokens
            want.append((k, tokens))
        out = budget.within_budget(df, ["k"], F.col("tokens"), cap, segments=5)
        assert sorted((r["k"], r["tokens"]) for r in out.rows.collect()) == want
        assert (out.spent, out.breached) == (total, len(want) < len(rows))
        if out.breached:
            assert "Window" not in out.rows._jdf.queryExecution().executedPlan().toString()


def test_budget_orders_missing_keys_first(spark):
    df = spark.createDataFrame([(None, 5), (2, 5), (1, 5), (None, None)], "k int, tokens int")
    out = budget.within_budget(df, ["k"], F.col("tokens"), 11)
    assert sorted(map(str, (tuple(r) for r in out.rows.collect()))) == ["(1, 5)", "(None, 5)", "(None, None)"]
    assert out.spent == 10


def test_budget_of_nothing(spark):
    out = budget.within_budget(calls(spark, [1]).where("false"), ["i"], F.col("tokens"), 5)
    assert out.rows.count() == 0 and not out.breached and out.spent == 0


def test_budget_over_many_segments_and_two_keys(spark):
    tokens = [(i // 7, i % 7, 1 + i * 37 % 11) for i in range(500)]
    df = spark.createDataFrame(tokens, "a int, b int, tokens int").repartition(5)
    total, want = 0, []
    for a, b, t in tokens:
        if total + t > 1500:
            break
        total += t
        want.append((a, b))
    out = budget.within_budget(df, ["a", "b"], F.col("tokens"), 1500, segments=9)
    assert sorted((r["a"], r["b"]) for r in out.rows.collect()) == want
    assert out.spent == total
    running = budget.running_spend(df, ["a", "b"], F.col("tokens"), 1500)
    assert running.where("within").count() == len(want)


def test_letter_without_violations_is_free(spark):
    none = F.array().cast("array<struct<rule_name:string,message:string,context:map<string,string>>>")
    letter = spark.range(1).select(letters.explain(none, F.lit("0.8")).alias("l")).first()["l"]
    assert tuple(letter) == ("No violations found.", 0)


def test_letter_lists_reasons(spark):
    df = spark.sql(
        "select array(struct('a' as rule_name, 'x' as message), struct('b' as rule_name, 'y' as message)) as v"
    )
    text = df.select(letters.prompt(F.col("v"), F.lit("0.5"))).first()[0]
    assert text == "Draft a polite rejection letter. Reasons: a: x; b: y. Risk context: 0.5."


def texts_frame(spark):
    return spark.createDataFrame(
        [(f"t{i}", t) for i, t in enumerate(TEXTS)], "text_id string, text string"
    )


def test_whole_batch(spark, tmp_path):
    system = regimes.proposal_joint(0.5, 0.6).decisions
    out = str(tmp_path / "batch")
    result = intake.run(texts_frame(spark), out, system, adm_joint(1.0), max_tokens=10_000, tokenise=True)
    assert (result.extracted, result.contracts, result.rejections, result.quarantined) == (3, 1, 2, 0)
    assert result.rule_breakdown == {"premium": 1}
    assert result.tokens == sum(max(1, len(t) // 4 + 20) for t in TEXTS)
    written = spark.read.parquet(f"{out}/outcomes")
    assert "Mira" not in {r["holder_name"] for r in written.collect()}
    assert spark.read.parquet(f"{out}/raw_quarantine").count() == 0


def test_batch_stops_at_the_first_call_it_cannot_pay(spark, tmp_path):
    costs_ = [max(1, len(t) // 4 + 20) for t in TEXTS]
    result = intake.run(
        texts_frame(spark), str(tmp_path / "batch"), regimes.proposal_joint().decisions, adm_joint(1.0),
        max_tokens=costs_[0] + costs_[1], stop_in_order=["text_id"],
    )
    assert result.breached and result.tokens == costs_[0] + costs_[1] and result.extracted <= 2
    assert {r["text_id"] for r in spark.read.parquet(str(tmp_path / "batch/extracted")).collect()} <= {"t0", "t1"}


def test_batch_over_budget_stops(spark, tmp_path):
    with pytest.raises(intake.BudgetExceeded):
        intake.run(
            texts_frame(spark),
            str(tmp_path / "batch"),
            regimes.proposal_joint().decisions,
            adm_joint(1.0),
            max_tokens=50,
        )
