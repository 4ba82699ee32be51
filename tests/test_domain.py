import numpy as np
import pytest

from rateloom import cli, config
from rateloom.functions import levels, synth
from rateloom.operators import listening, material, relational
from rateloom.sources import recordings


def test_level_algebra():
    a, b = levels.Level((0.0, 1.0), (0.0, -10.0)), levels.Level((0.5, 2.0), (-6.0, -6.0))
    both = levels.product([a, b])
    assert both.seconds == (0.0, 0.5, 1.0, 2.0) and both.db(0.5) == pytest.approx(-11)
    assert both.over(b).distance(a) == pytest.approx(0) and a.scaled(3).peak == 3
    high = a.at_pitch(12)
    assert high.seconds[-1] == 0.5 and high.clock == "played"
    with pytest.raises(ValueError):
        high.times(a)
    with pytest.raises(ValueError):
        levels.product([])
    assert levels.trend(levels.constant(0)) is None and levels.trend(a) == pytest.approx((-10, 0))


def test_envelope_follows_a_decay():
    decay = levels.Level((0.0, 2.0), (0.0, -30.0))
    nodes = levels.envelope(decay, 0.0, 50, 100)
    got = levels.played(nodes, 100)
    want = decay.gains(100, 50)
    assert len(nodes) <= 12 and nodes[0][1] == 64 and np.abs(got - want).max() < 0.03
    assert levels.played(nodes, 100, floor=8).min() == 8 / 64
    assert levels.balanced_gains([1.0, 0.5, 0.001]) == [64, 32, 1]
    x = np.concatenate([np.full(200, 0.1), np.full(200, 1.0)])
    assert np.abs(levels.held_back(x, 0.5, np.hanning(33)))[250:350].max() <= 0.5 + 1e-6


def test_synth_decays_and_sustains():
    p, s = synth.render("piano", 60, 100, 1.0, 8000), synth.render("sustained", 60, 100, 1.0, 8000)
    rms = lambda x: np.sqrt((x**2).mean())
    assert rms(p[6000:7500]) < 0.5 * rms(p[500:2000]) and rms(s[5000:6500]) > 0.8 * rms(s[1000:2500])
    assert (synth.render("piano", 60, 100, 1.0, 8000) == p).all()
    with pytest.raises(KeyError):
        synth.render("drum", 60, 100, 1.0)


@pytest.mark.parametrize("n,k,want", [(5, 1, [2]), (5, 2, [0, 4]), (5, 3, [0, 2, 4]), (3, 9, [0, 1, 2]), (7, 0, [])])
def test_even_ranks(spark, n, k, want):
    from pyspark.sql import functions as F

    rows = spark.range(n).withColumn("g", F.lit("a"))
    assert [r["id"] for r in relational.even_ranks(rows, ["g"], ["id"], F.lit(k)).orderBy("id").collect()] == want


def test_material(spark):
    recs = spark.createDataFrame([(60, "a"), (64, "b")], "pitch int, file string")
    events = spark.createDataFrame([(61, 2), (63, 1), (62, 1)], "pitch int, count int")
    got = sorted((r["pitch"], r["nearest_key"]) for r in material.note_records(events, recs).collect())
    assert got == [(61, 60), (61, 60), (62, 60), (63, 64)]
    with pytest.raises(Exception, match="no recording"):
        material.tasks(events, recs).collect()
    swept = material.sweep(spark.createDataFrame([(1, 22050)], "id int, own int"), [8000, 11025, 44100], [8, 16], "own").collect()
    assert [(r["rate"], r["depth"]) for r in swept] == [(r, d) for r in (22050, 11025, 8000) for d in (8, 16)]
    assert material.offered_rates(11025, [8000, 11025, 16000, 22050], 1) == [11025, 16000]
    rows = spark.createDataFrame([("g", k, s) for k, s in enumerate([3, 4, 2, 5, 1])], "g string, k int, s int")
    assert [(r["pattern"], r["row"]) for r in material.packed(rows, "g", "k", "s", 8).orderBy("k").collect()] == [(0, 0), (0, 3), (1, 0), (1, 2), (1, 7)]
    zones = spark.createDataFrame([(0, 1)], "start int, stop int")
    assert [(r["start"], r["stop"]) for r in material.combined_options([zones, zones], [3, 2]).orderBy("start").collect()] == [(0, 1), (3, 4)]
    with pytest.raises(ValueError):
        material.gathered([])


def test_listening(spark):
    rows = [("c", 1, 8000, 8, 100), ("c", 2, 8000, 16, 200), ("c", 3, 16000, 8, 202), ("d", 4, 8000, 8, 100)]
    r = spark.createDataFrame(rows, "clip string, id int, rate int, depth int, size int")
    got = {(x["a"], x["b"]): x["axis"] for x in listening.questions(r, "clip", ["rate", "depth"], "size", 0.05).collect()}
    assert got == {(1, 2): "depth", (1, 3): "rate", (2, 3): "trade"}
    q = listening.blinded(list(range(10)), 1, 3, 4)
    assert len(q) == 13 and q == listening.blinded(list(range(10)), 1, 3, 4)
    for k, x in enumerate(q):
        if x["repeat"]:
            assert k - next(i for i, y in enumerate(q) if y["question"] == x["question"]) >= 4
    j = spark.createDataFrame([("loop", 2, 0.5), ("loop", -1, 0.1), ("rate", 0, 0.2)], "axis string, heard int, gap double")
    rep = {x["axis"]: (x["decided"], x["matched"]) for x in listening.report(j, "gap").collect()}
    assert rep == {"loop": (2, 1), "rate": (0, 0), None: (2, 1)}
    pairs = spark.createDataFrame([("loop", float(k), k) for k in range(9)], "axis string, margin double, id int")
    assert sorted(x["id"] for x in listening.quota(pairs, "axis", "margin", 3, ["id"]).collect()) == [0, 3, 6]


def test_config_and_cli(spark, tmp_path):
    (tmp_path / "budget.yaml").write_text("budget_kib: 96\nmax_layers: 2\n")
    (tmp_path / "sweep.yaml").write_text("rates: [8000, 16000]\n")
    s = config.load(tmp_path)
    assert s.budget.budget_kib == 96 and s.sweep.rates == (8000, 16000) and s.loop.periods == 4
    (tmp_path / "loop.yaml").write_text("unknown: 1\n")
    with pytest.raises(ValueError, match="unknown"):
        config.load(tmp_path)
    with pytest.raises(ValueError):
        config.Settings(sweep=config.Sweep(rates=(2, 1)))
    assert cli.main(["synth", "piano", str(tmp_path / "wav"), "--pitches", "60", "64", "--velocities", "90", "--seconds", "0.2", "--rate", "8000"]) == 0
    takes = recordings.resolved_velocities(recordings.recordings(spark, str(tmp_path / "wav"))).collect()
    assert sorted((t["index"], t["pitch"], t["velocity"], t["frames"]) for t in takes) == [(1, 60, 90, 1600), (2, 64, 90, 1600)]
    assert cli.main(["list"]) == 0


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_nearest_join_and_totals_do_not_depend_on_the_ranges(spark, buckets):
    import random

    rng = random.Random(3)
    left = [(k, rng.choice("ab"), rng.choice([None, *range(60)])) for k in range(300)] + [(999, "none", 5)]
    right = [(k, rng.choice("ab"), rng.randrange(0, 60, 7)) for k in range(40)]
    a, b = spark.createDataFrame(left, "id int, g string, v int"), spark.createDataFrame(right, "k int, g string, w int")
    got = {r["id"]: r["nearest_key"] for r in relational.nearest_join(a, b, ["g"], "v", "w", "k", buckets).collect()}
    for k, g, v in left:
        near = [(abs(w - v), w, i) for i, h, w in right if h == g] if v is not None else []
        assert got[k] == (min(near)[2] if near else None)
    rows = spark.createDataFrame([(x, 1) for x in (5, 1, 3, 3, 9, 1)], "x int, n int")
    assert sorted((r["x"], r["t"]) for r in relational.running_total(rows, "x", "n", "t", buckets).collect()) == [(1, 2), (1, 2), (3, 4), (3, 4), (5, 5), (9, 6)]
