"""Totals that are observed while masked rows are written."""

from cloakframe import Policy
from cloakframe.plans.run import StreamTotals, mask_and_report, observed_stream
from cloakframe.streaming.streams import mask_stream, read_stream, write_stream

POLICY = Policy.only("s", "email", "ip_address")
ROWS = [(1, "a@mail.ru and 10.0.0.1"), (2, None), (3, "b@mail.ru"), (4, "")]
TOTALS = {"texts": 4, "matches_found": 3, "matches_applied": 3, "matches_skipped": 0, "detector_totals": {"email": 2, "ip_address": 1}}


def test_one_pass_writes_and_reports(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, "id long, text string").repartition(3)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    assert mask_and_report(df.mapInArrow(counted, df.schema), POLICY, lambda rows: rows.write.parquet(out)) == TOTALS
    assert reads.value == len(ROWS)
    written = spark.read.parquet(out)
    assert written.columns == ["id", "text"] and written.count() == 4
    empty = mask_and_report(df.limit(0), POLICY, lambda rows: rows.write.parquet(f"{out}2"), with_stats=True)
    assert empty == {"texts": 0, "matches_found": 0, "matches_applied": 0, "matches_skipped": 0, "detector_totals": {}}


def test_a_stream_reports_its_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame(ROWS, "id long, text string")
    df.coalesce(1).write.parquet(source)
    df.coalesce(1).write.mode("append").parquet(source)
    listener = StreamTotals("masked")
    spark.streams.addListener(listener)
    try:
        stream = read_stream(spark, source, "id long, text string", maxFilesPerTrigger="1")
        masked = observed_stream(mask_stream(stream, POLICY), POLICY, "masked")
        write_stream(masked, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals()["texts"] == 8 and listener.totals()["detector_totals"] == {"email": 4, "ip_address": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
