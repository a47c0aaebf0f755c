import csv
import random

import pytest

from veilgram import cli
from veilgram.sources import people


@pytest.fixture
def people_file(tmp_path):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    path = tmp_path / "people.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "last", "first", "status_code"])
        for i in range(400):
            out.writerow([f"R{i}", name(), name(), "A" if i % 10 else "I"])
        out.writerow(["R900", "x", "name", "A"])
        f.write("R901,short\n")
    return str(path)


def test_sample_and_link(spark, people_file, tmp_path, capsys):
    out = str(tmp_path / "sample")
    cli.main(["sample", people_file, "1,2", "3", out, "--subset", "5", "--base", "60"])
    said = capsys.readouterr().out
    assert "1 rows quarantined" in said and "1 of 361 active rows have a missing value" in said
    cli.main(["link", out, "bf", "256,1.0", "blip", "ala,0.05", "--subset", "5", "--base", "60"])
    assert "1-1-correct" in capsys.readouterr().out
    with pytest.raises(ValueError, match="records, not"):
        cli.main(["link", out, "bf", "256,1.0", "blip", "ala,0.05"])


def test_a_record_without_grams_raises(spark):
    src = spark.createDataFrame([("1", 0, "a", "ab", "cd")], "rec_id string, ord long, status_code string, attr1 string, attr2 string")
    norm = people.normalised(src)
    assert people.qgram_rows(norm, 2).first().qs == ["ab", "cd"]
    with pytest.raises(Exception, match="no q-gram in record 1"):
        people.qgram_rows(norm, 3).collect()
