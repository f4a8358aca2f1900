"""What queries read, join and draw once."""

from tideglass.operators import resampling
from tideglass.plans import temporal_queries

SF = "/root/testdata/sf0.001"


def test_deliveries_join_no_players_with_players(spark):
    plan = temporal_queries.deliveries(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_groups_are_drawn_once_for_both_scores(spark, monkeypatch):
    rows = spark.createDataFrame([(h, h * 10 + i, int(h % 3 == 0), (h * 7 + i) % 11 / 11, None if h == 5 else (h + i) % 5 / 5, i == 0) for h in range(40) for i in range(4)], "hand_id long, row_id long, label int, one double, two double, fired boolean")
    made = []
    monkeypatch.setattr(resampling, "_draw", lambda *a, draw=resampling._draw, **k: made.append(draw(*a, **k)) or made[-1])
    got = {x.metric: (x.lower, x.median, x.upper) for x in resampling.paired_differences(rows, "one", "two", 8, 3).collect()}
    assert len(made) == 1 and made[0][1] == [40, 39]
    one, two = ({x.replicate: x for x in resampling.replicate_metrics(rows, 8, 3, score=s).collect()} for s in ("one", "two"))
    for metric in resampling.METRICS:
        d = sorted(one[k][metric] - two[k][metric] for k in one if one[k][metric] is not None and two[k][metric] is not None)
        assert not d or d[0] <= got[metric][0] <= got[metric][1] <= got[metric][2] <= d[-1]
