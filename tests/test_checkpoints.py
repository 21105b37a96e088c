from labelweave.plans import replay


def test_checkpoints_are_spread_over_hosts(spark, sf, monkeypatch):
    runs, fold = [], replay.fold
    monkeypatch.setattr(replay, "fold", lambda rows, run, *rest: runs.append(rows.select(*run).distinct().count()) or fold(rows, run, *rest))
    hosts = replay.t.events(spark, sf).select("corpus", "host").distinct().count()
    assert replay.t5_checkpoints(spark, sf).count() == replay.t.events(spark, sf).count()
    assert runs == [hosts] and hosts > 2
