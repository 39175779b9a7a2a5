import numpy as np
import pandas as pd
import pytest

from riskloom.functions.columns import CORE_NUMERIC
from riskloom.sources import csv_source, sample


def test_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,x,flag,text,gaps,none\n1,1.5,True,"a, ""b""",7,\n2,NA,False,nan,,\n3,-2e3,True,é,9,NA\n', encoding="utf-8")
    df = csv_source.load_dataset(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "text": "string", "gaps": "bigint", "none": "double"}
    rows = df.orderBy("id").collect()
    assert rows[0]["text"] == 'a, "b"' and rows[1]["x"] is None and rows[1]["text"] is None and rows[1]["gaps"] is None
    want = pd.read_csv(path)
    assert np.array_equal(df.toPandas().x.to_numpy(float), want.x.to_numpy(float), equal_nan=True)


def test_encoding_is_chosen_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,Zürich\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,name\n2,Málaga\n".encode("latin-1"))
    sides = csv_source.files_by_encoding(spark, str(tmp_path))
    assert {e: len(f) for e, f in sides.items()} == {"utf-8": 1, "iso-8859-1": 1}
    got = {r["id"]: r["name"] for r in csv_source.read_csv(spark, str(tmp_path)).collect()}
    assert got == {1: "Zürich", 2: "Málaga"}


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError):
        csv_source.load_dataset(spark, "/tmp/x.parquet")


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('id,t\n1,"a\nb"\n')
    assert csv_source.read_csv(spark, str(path), multiline=True).first()["t"] == "a\nb"


@pytest.fixture(scope="module")
def samples(spark):
    return sample.generate_sample(spark).toPandas()


def test_sample_distributions(samples):
    assert samples.shape == (1_000, 16) and list(samples.columns) == sample.ORDER
    assert samples.Sample_ID.is_unique and samples.Sample_ID.iloc[0].startswith("MP_0")
    assert abs(samples.pH.mean() - 7) < 0.1 and abs(samples.Temperature_C.std() - 5) < 0.6
    assert abs((samples.Risk_Type == "Type_A").mean() - 0.5) < 0.06
    assert abs(samples.MP_Count_per_L[samples.MP_Count_per_L < 120].mean() - 50) < 1.5
    missing = samples.drop(columns=["Sample_ID"]).select_dtypes("number").isna().mean()
    assert missing.between(0.02, 0.09).all()
    assert not samples.drop(columns=missing.index).isna().any().any()


def test_sample_outliers(spark):
    df = sample.sample_for(spark.range(2_000), "id").toPandas()
    for c, floor in zip(CORE_NUMERIC, [120, 150, 10, 1.5]):
        far = (df[c] >= floor).sum()
        assert 80 <= far <= 100, c  # 100 rows, of which about one in twenty is then missing
    assert sample.generate_sample(spark, 1_000).exceptAll(sample.generate_sample(spark, 1_000)).isEmpty()
    assert sample.generate_sample(spark, 5).count() == 5
