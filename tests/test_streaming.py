from pyspark.sql import functions as F

from cloakspark.operators import detect
from cloakspark.streaming import detection


def test_findings_and_crosswalk_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "mail a@b.example"), (2, "mail A@b.example and c@d.example"), (3, "none")]
    spark.createDataFrame(rows, "text_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("text_id long, text string").parquet(str(src))
    found = detection.pattern_findings(stream, lambda t: detect.by_pattern(t, "EMAIL_ADDRESS", detect.EMAIL)).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    master = spark.createDataFrame([("EMAIL_ADDRESS", "c@d.example", "EML-7")], "entity_type string, norm_name string, pseudonym string")
    q = detection.crosswalk_stream(found, master).writeStream.format("memory").queryName("cw").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.norm_name: (r.pseudonym, r.auto) for r in spark.table("cw").collect()}
    assert got["c@d.example"] == ("EML-7", False) and got["a@b.example"][1] and len(got) == 2


def test_redacted_batches(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, "write to a@b.example"), (1, 1, "x")], "doc_id long, unit_idx int, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, unit_idx int, text string").parquet(str(src))
    out = []
    q = detection.redact_batches(stream, lambda t: detect.patterns(t, ("EMAIL_ADDRESS",)), None, lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.redacted.split("-")[0] for r in out) == ["write to EML", "x"]
