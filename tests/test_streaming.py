from datetime import datetime

from nuntia.schema import FINDINGS
from nuntia.streaming import stream


def land(spark, path, *texts, hour=8):
    rows = [("d", i, 1, t, "", "o", "BOC", f"u{t[:20]}", datetime(2026, 5, 21, hour)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, stream.LANDED).write.mode("append").parquet(path)


def test_findings_come_once_and_runs_continue(spark, tmp_path):
    landing, check, got = str(tmp_path / "in"), str(tmp_path / "check"), []

    def run():
        findings = stream.fresh_findings(stream.read_landing(spark, landing))
        assert [f.name for f in findings.schema][:-1] == [f.name for f in FINDINGS]
        stream.run_available(findings, lambda df, i: got.extend(r["description"] for r in df.collect()), check).awaitTermination(120)

    land(spark, landing, "plaza de informático", "nada", "bases: programador")
    run()
    assert sorted(got) == ["bases: programador", "plaza de informático"]
    land(spark, landing, "plaza de informático", "plaza de desarrollador", hour=9)
    run()
    assert sorted(got) == ["bases: programador", "plaza de desarrollador", "plaza de informático"]
