"""The ingest stream gives what the batch path gives, once per text."""

from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.operators.chunk import overlap_chunks
from docsift.streaming import ingest


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    text = " ".join(f"This is sentence number {i} and it goes on for a while." for i in range(30))
    (src / "a.txt").write_text(text)
    (src / "b.txt").write_text(text)
    (src / "c.txt").write_text("Another text with a sentence that is long enough.")
    q = ingest.run(ingest.uploads(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = overlap_chunks(spark.createDataFrame([(text,), ("Another text with a sentence that is long enough.",)], "text string").withColumn("text", X.clean_ingest("text")), "text")
    assert sorted(r.chunk for r in got.select("chunk").collect()) == sorted(r.chunk for r in want.select("chunk").collect())
    assert got.filter(F.size("embedding") != 384).count() == 0


def test_windowed_counts(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "e").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "e" / "x"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e" / "x"))
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(events) from counts").first()[0] == spark.read.parquet(f"{small}/events.parquet").count()
