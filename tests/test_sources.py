import gzip

import pytest
from pyspark.sql import functions as F

from veilgram.sources import people, samples
from veilgram.streaming import encoding

TEXT = b'id,status_code,fn,ln\n1,A,Jo\xffhn,Smith\n2,a,,Lee\n3,a,"An ""x"" n","Multi\nline"\n4,a,short\n 5 , A , Ann , Lee \n6,i,Bob,Ray\n'


@pytest.mark.parametrize("zipped", [False, True])
def test_person_file(spark, tmp_path, zipped):
    path = tmp_path / ("p.csv.gz" if zipped else "p.csv")
    path.write_bytes(gzip.compress(TEXT) if zipped else TEXT)
    good, bad = people.people(people.scan(spark, str(path)), 0, 1, [2, 3])
    norm = people.normalised(good)
    got = [tuple(r) for r in norm.orderBy("ord").select("rec_id", "attr1", "attr2", "complete").collect()]
    assert got == [("1", "john", "smith", True), ("2", "", "lee", False), ("3", 'an"x"n', "multi\nline", True), ("5", "ann", "lee", True)]
    assert bad.count() == 1
    with pytest.raises(ValueError):
        people.people(people.scan(spark, str(path)), 0, 2, [3])


def test_sample_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", 0, ["ab", "o'"], "f_h"), ("2", 1, ["a{", 'b"'], "b")], "rec_id string, ord long, qs array<string>, type string")
    samples.write(rows, str(tmp_path / "p"))
    samples.write_csv(rows, str(tmp_path / "c"))
    want = [("1", ["ab", "o'"], "f_h"), ("2", sorted(["a{", 'b"']), "b")]
    for got in (samples.read(spark, str(tmp_path / "p")), samples.read_csv(spark, str(tmp_path / "c"))):
        assert sorted((r.rec_id, sorted(r.qs), r.type) for r in got.collect()) == want
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        samples.read_csv(spark, str(tmp_path / "x.csv"))


def test_stream_equals_batch(spark, tmp_path):
    src = spark.createDataFrame([("1", 0, "a", "john", "smith"), ("2", 1, "i", "ann", "lee")], "rec_id string, ord long, status_code string, attr1 string, attr2 string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    rows = encoding.hardened(encoding.encoded(stream, 64, 3), 64, "ala", 0.1, 1)
    q = rows.writeStream.format("memory").queryName("enc").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = encoding.hardened(encoding.encoded(src, 64, 3), 64, "ala", 0.1, 1)
    assert spark.table("enc").select("rec_id", F.to_json("pos")).collect() == want.select("rec_id", F.to_json("pos")).collect()
