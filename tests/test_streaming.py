from failtriage.operators.parse import parse_logs
from failtriage.sources import derived
from failtriage.streaming.arrivals import append_parsed, arriving_logs


def test_arriving_logs_give_the_same_rows_as_batch(spark, tmp_path):
    logs = derived.logs(spark, "/root/testdata/sf0.001")
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    logs.where("job_id < 500").write.mode("append").parquet(folder)
    append_parsed(arriving_logs(spark, folder), table, checkpoint)
    logs.where("job_id >= 500").write.mode("append").parquet(folder)
    append_parsed(arriving_logs(spark, folder), table, checkpoint)
    append_parsed(arriving_logs(spark, folder), table, checkpoint)

    def rows(df):
        return sorted(map(repr, df.select("job_id", "group_key", "error_patterns", "affected_files").collect()))

    assert rows(spark.read.parquet(table)) == rows(parse_logs(logs))
