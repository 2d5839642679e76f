"""Texts, statistics, control, streams and files."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.operators import control, keywords, stats
from ripplegraph.plans.runtime import stored, with_ordinal
from ripplegraph.sources import readers, sinks
from ripplegraph.streaming import transitions


@pytest.mark.parametrize(
    "reply,want",
    [
        ('[{"start_node": "a", "end_node": "b"}]', 1),
        ("```json\n[{'start_node': 'a', 'end_node': 'b'}]\n```", 1),
        ('{"results": [{"start_node": "a", "end_node": "b"}, {"start_node": "a"}]}', 1),
        ('{start_node: "a", end_node: "b"} /* x */', 1),
        ('[{"start_node": "a", "end_node": "b"}, {"start_node": "c", "end_n', 1),
        ('{"results": [{"start_node": "a", "end_node": "b"}, {"start_node": "c", "end_node": "d"}, {"sta', 2),
        ("Two: {'start_node': \"it's\", 'end_node': 'b\\'s'} and {start_node: x, end_node: y,}.", 2),
        ("[(" * 3000, None),
        ("nothing", None),
        ("", None),
        (None, None),
        ("[1, 2]", 0),
        ("}{", None),
    ],
)
def test_damaged_replies(reply, want):
    found = text.repaired(reply)
    assert found is None if want is None else len(found) == want


def test_highlight(spark):
    row = spark.createDataFrame([("Heat stress and heatStress of CoralBleaching", "HeatStress", "CoralBleaching")], "t string, a string, b string")
    got = row.select(text.highlighted(F.col("t"), F.col("a"), F.col("b")).alias("t")).first().t
    assert got == text.highlight("Heat stress and heatStress of CoralBleaching", "HeatStress", "CoralBleaching") == "HEAT STRESS and HEATSTRESS of CORALBLEACHING"


def test_keywords_are_plain():
    assert all(keywords.literal(words) for words in (keywords.HEALTH, keywords.ECOLOGICAL, *keywords.BY_KEYWORD.values()))


def test_p_values():
    assert stats.chi2_p(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi2_p(18.307038053275146, 10) == pytest.approx(0.05)
    assert stats.t_p(2.2281388519649385, 10) == pytest.approx(0.05)
    assert stats.normal_p(1.6448536269514722) == pytest.approx(0.05)
    assert stats.chi2_p(0, 3) == 1 and stats.t_p(0, 5) == pytest.approx(1)


def test_tied_ranks_and_signed_ranks(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(9), draw.randrange(9)) for _ in range(60)]
    d = [a - b for a, b in rows if a != b]
    rank = {v: (sum(abs(x) < v for x in d) + 1 + sum(abs(x) <= v for x in d)) / 2 for v in set(map(abs, d))}
    plus, minus = (sum(rank[abs(x)] for x in d if s * x > 0) for s in (1, -1))
    got = stats.wilcoxon(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert got.n == len(d) and got.w == min(plus, minus)
    none = stats.wilcoxon(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()
    assert (none.n, none.w, none.z) == (0, 0.0, 0.0)


def test_edge_cases_of_tests(spark):
    pairs = spark.createDataFrame([], "a boolean, b boolean")
    assert stats.mcnemar(pairs).first().chi2 is None
    assert stats.kappa(spark.createDataFrame([], "a int, b int"), "a", "b").first().kappa == 0
    assert stats.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first().kappa == 1
    two = spark.createDataFrame([("r", "x", 10), ("r", "y", 20), ("s", "x", 30), ("s", "y", 5)], "r string, c string, n long")
    assert stats.chi2(two, "r", "c").first().chi2 == pytest.approx(65 * (abs(10 * 5 - 20 * 30) - 65 / 2) ** 2 / (30 * 35 * 40 * 25))


def test_bootstrap_covers_the_mean(spark):
    sums = np.array([[50, 1.0], [50, 3.0]])
    got = stats.interval(stats.bootstrap(spark, sums, lambda s, n: s[0] / n, 500)).first()
    assert got.n == 500 and abs(got.mean - 2) < 0.05 and 1.7 < got.low < 1.9 and 2.1 < got.high < 2.3


def test_ordinals(spark):
    rows = [(x,) for x in random.Random(1).sample(range(1000), 300)]
    got = {r.x: r.ordinal for r in with_ordinal(spark.createDataFrame(rows, "x int").repartition(5), "x").collect()}
    assert got == {x: i for i, x in enumerate(sorted(got), 1)}
    assert with_ordinal(spark.createDataFrame([], "x int"), "x").count() == 0


def test_stages():
    ran = []

    def fail():
        raise RuntimeError("no")

    make = lambda: control.Pipeline([control.Stage("a", lambda: ran.append("a")), control.Stage("b", fail), control.Stage("c", lambda: ran.append("c"))])
    assert not make().run() and ran == ["a"]
    p = make()
    assert not p.run(skip_on_fail=True) and [s["status"] for s in p.status()] == ["done", "failed", "done"]
    assert make().run(start_from="c") and ran == ["a", "a", "c", "c"]
    with pytest.raises(ValueError):
        make().run(start_from="z")


def test_rate_limit():
    now = [0.0]
    limit = control.RateLimit(2, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limit.acquire()
    assert now[0] == 120


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": 3}}))
    c = control.Config.read(str(tmp_path / "none.json"), str(tmp_path / "c.json"))
    assert c.get("a.b") == 3 and c.get("a.x", 7) == 7 and control.Config.read(str(tmp_path / "none")).get("a") is None


def test_stream_is_the_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"n{i % 5}", "causes", f"m{i % 3}", "", "high", " Physical" if i % 2 else "bogus", "economic", f"p{i}", base + dt.timedelta(hours=i)) for i in range(200)]
    schema = readers.TRIPLE + ", at timestamp"
    spark.createDataFrame(rows + rows[:20], schema).write.json(str(tmp_path / "in"))
    transitions.into_table(transitions.windowed_transitions(transitions.stream_triples(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.window_start, r.sl, r.el): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want: dict = {}
    for r in rows:
        if r[5] != "bogus":
            day = r[8].replace(hour=0)
            want[day, "physical", "economic"] = want.get((day, "physical", "economic"), 0) + 1
    last = max(r[8] for r in rows) - dt.timedelta(hours=1)
    assert got == {k: n for k, n in want.items() if k[0] + dt.timedelta(days=1) <= last}


def test_clients_that_fail(spark):
    def client(prompt):
        if prompt == "bad":
            raise OSError
        return prompt.upper()

    out = readers.ask(spark.createDataFrame([(1, "x"), (2, "bad")], "id long, prompt string"), client).collect()
    assert {r.id: r.reply for r in out} == {1: "X", 2: ""}


def test_reports(spark):
    df = spark.createDataFrame([(1, math.inf), (2, math.nan)], "a int, b double")
    assert json.loads(sinks.json_report({"t": df})) == {"t": [{"a": 1, "b": "inf"}, {"a": 2, "b": None}]}
    assert sinks.markdown_table(df.limit(1)).split("\n")[0] == "| a | b |"
    assert stored(df).count() == 2
