import pytest
from pyspark.errors import AnalysisException

from tabscope import load, profile, read_csv
from tabscope.session import shared_folder


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_types_and_missing_words(spark, tmp_path):
    path = write(tmp_path / "a.csv", (
        "i,gap,f,b,bt,t,d,void,day,q\n"
        '1,1,1.5,True,t,5d,1e3,NA,2024-01-01,"a, ""b"""\n'
        "-2,NA,.5,FALSE,f,6d,-inf,,2024-01-02,null\n"
        " 3 ,n/a,2.,true,t,7,+4,None,NaN,x\n"))
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "gap": "bigint", "f": "double", "b": "boolean", "bt": "string", "t": "string",
                               "d": "double", "void": "double", "day": "string", "q": "string"}
    rows = df.orderBy("i").collect()
    assert [r.i for r in rows] == [-2, 1, 3] and rows[1].q == 'a, "b"' and rows[0].q is None and rows[2].day is None
    assert rows[0].d == float("-inf") and [r.gap for r in rows] == [None, 1, None]
    kinds = {r["column"]: r.semantic_type for r in profile(df).collect()}
    assert kinds["bt"] == "boolean" and kinds["day"] == "datetime" and kinds["gap"] == "integer" and kinds["void"] == "float"


def test_large_whole_numbers_fall_back_to_double(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "b.csv", "n\n99999999999999999999\n1\n"))
    assert df.dtypes == [("n", "double")]


def test_line_breaks_inside_values(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'k,s\n1,"one\ntwo"\n2,plain\n')
    assert {(r.k, r.s) for r in read_csv(spark, path).collect()} == {(1, "one\ntwo"), (2, "plain")}


def test_untyped_and_own_words(spark, tmp_path):
    path = write(tmp_path / "e.csv", "a.b\n-\nNA\n")
    df = read_csv(spark, path, infer=False, na_tokens=["-"])
    assert [r[0] for r in df.collect()] == [None, "NA"] and df.columns == ["a.b"]


def test_surplus_fields_raise_and_short_records_are_filled(spark, tmp_path):
    with pytest.raises(Exception, match="more than the 2 fields"):
        read_csv(spark, write(tmp_path / "f.csv", "a,b\n1,2\n3,4,5\n"))
    assert [tuple(r) for r in read_csv(spark, write(tmp_path / "g.csv", "a,b\n1,2\n3\n")).orderBy("a").collect()] == [(1, 2), (3, None)]


def test_surplus_fields_raise_whatever_column_is_read(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "h.csv", "a,b\n1,2\n3,4,5\n"), infer=False)
    with pytest.raises(Exception, match="more than the 2 fields"):
        df.select("b").collect()


def test_missing_sources(spark):
    with pytest.raises(AnalysisException):
        read_csv(spark, "/tmp/there-is-no-such-file.csv")
    with pytest.raises(ValueError):
        load(spark)
    assert load(spark, "/root/testdata/sf0.001/part.parquet").columns[0] == "p_partkey"


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder and (configured is None or folder == configured)
