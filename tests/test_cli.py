"""Command line smoke test over a small lake."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helpers import events_df, ms
from tickerlake.cli import main
from tickerlake.sources import lake


def test_commands_over_one_morning(spark, tmp_path, capsys):
    """Three companies, one post every 90 seconds; figures follow from the inputs."""
    root = str(tmp_path / "lake")
    open_ = datetime(2023, 12, 29, 8, 45)
    said = ["$ORCL is AMAZING", "INTC suffered a crash", "the weather is fine", "$CSCO filed its numbers"]
    rows = [("desk", f"p{k}", open_ + timedelta(seconds=90 * k), said[k % 4]) for k in range(24)]
    lake.land_events(spark, events_df(spark, rows), root)
    prints = [(t, ms(open_ + timedelta(seconds=30 * k)) * 1000, 7 * k, 50.0 + k % 9, 3) for k in range(100) for t in ("ORCL", "AMD")]
    spark.createDataFrame(prints, "ticker string, trade_us long, trade_id long, price double, qty long").write.parquet(str(tmp_path / "prints"))

    def run(*args):
        assert main([args[0], "--lake", root, *args[1:]]) == 0
        return capsys.readouterr().out

    assert "scored 24 events" in run("score")
    assert "wrote 50 bars" in run("market", "--prints", str(tmp_path / "prints"))  # AMD is not mentioned
    assert {r.ticker for r in lake.read_market(spark, root).select("ticker").distinct().collect()} == {"ORCL"}
    out = str(tmp_path / "signal")
    run("signal", "--out", out)
    signal = spark.read.parquet(out)
    assert {r.ticker: r.n for r in signal.groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {"ORCL": 6, "INTC": 6, "CSCO": 6}
    assert signal.where("ticker = 'ORCL' AND close_now IS NULL").count() == 0 == signal.where("ticker <> 'ORCL' AND close_now IS NOT NULL").count()
    report = run("report")
    assert "n_signals" in report and "usd_per_month" in report
    assert run("query").count("desk") == 24


def test_cli_ingest_and_views(spark, tmp_path, capsys):
    from tickerlake.sources import fixtures

    fixtures.write_time_chunks(fixtures.item_json_lines(spark, "/root/testdata/sf0.001"), str(tmp_path / "in"), chunks=2)
    root = str(tmp_path / "lake")
    args = ["--lake", root]
    assert main(["ingest", *args, "--items", str(tmp_path / "in" / "*"), "--checkpoint", str(tmp_path / "ck")]) == 0
    n = lake.read_events(spark, root).count()
    assert n > 0
    assert main(["score", *args]) == 0
    assert main(["tickers", *args, "--grain", "hour", "--show", "3"]) == 0
    assert main(["metrics", *args]) == 0
    out = capsys.readouterr().out
    assert f"scored {n} events" in out and "sink.events_out" in out
