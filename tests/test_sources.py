import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from cohortline.session import durable
from cohortline.sources import schemas
from cohortline.sources.delimited import read_delimited, snake_case, write_table
from cohortline.sources.schemas import NUMBER, TEXT, WHOLE


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def schema(**kinds):
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


@pytest.mark.parametrize(
    "header, name",
    [("Patient.Name..MRN.", "patient_name_mrn"), ("Patient Name (MRN)", "patient_name_mrn"),
     ("gNomen", "g_nomen"), ("S.", "s"), ("SAMPLE", "sample"), ("rsID", "rs_id"),
     ("P.Nom.R", "p_nom_r"), ("OncoTree.Primary.Tumor.Site", "onco_tree_primary_tumor_site")],
)
def test_snake_case(header, name):
    assert snake_case(header) == name


def test_tab_delimited_by_name_in_any_order(spark, tmp_path):
    path = put(tmp_path, "v.txt", "Extra\tName\tAssembly\tClinicalSignificance\tOriginSimple\tPhenotypeList\n"
               "1\tNM_1(G):c.1A>T (p)\tGRCh37\tBenign\tgermline\tx|y\n")
    row = read_delimited(spark, path, schemas.CLINVAR, sep="\t").first()
    assert (row.assembly, row.name, row.clinical_significance) == ("GRCh37", "NM_1(G):c.1A>T (p)", "Benign")
    assert "extra" not in row.asDict()


def test_types_and_null_policies(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b,c,d\nx,1,0.5,2020-01-31\n,,,\nNA,NA,oops,31/01/2020\n")
    kinds = schema(a=T.StringType(), b=T.LongType(), c=T.DoubleType(), d=T.DateType())
    got = [tuple(r) for r in read_delimited(spark, path, kinds).collect()]
    assert got == [("x", 1, 0.5, dt.date(2020, 1, 31)), ("", None, None, None), (None, None, None, None)]


def test_null_tokens(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n999,5\nNA,999\n"",7\n')
    kinds = schema(a=T.StringType(), b=T.LongType())
    one = [tuple(r) for r in read_delimited(spark, path, kinds, null_tokens=["999"]).collect()]
    assert one == [(None, 5), ("NA", None), ("", 7)]
    many = [tuple(r) for r in read_delimited(spark, path, kinds, null_tokens=["", "NA"]).collect()]
    assert many == [("999", 5), (None, 999), (None, 7)]


def test_ragged_rows_are_padded_with_nulls(spark, tmp_path):
    path = put(tmp_path, "r.txt", "a\tb\tc\n1\t2\t3\n4\n5\t\t6\n7\t8\t9\t10\n")
    kinds = schema(a=T.StringType(), b=T.StringType(), c=T.StringType())
    got = [tuple(r) for r in read_delimited(spark, path, kinds, sep="\t", ragged=True).collect()]
    assert got[:3] == [("1", "2", "3"), ("4", None, None), ("5", "", "6")]
    assert got[3][:3] == ("7", "8", "9")


def test_missing_column_is_named(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a\n1\n")
    with pytest.raises(ValueError, match="no column b"):
        read_delimited(spark, path, schema(b=T.LongType()))


def test_several_files_at_once(spark, tmp_path):
    paths = [put(tmp_path, f"{i}.csv", f"a\n{i}\n") for i in range(3)]
    assert read_delimited(spark, paths, schema(a=T.LongType())).count() == 3


def test_written_parts_follow_the_order(spark, tmp_path):
    out = str(tmp_path / "out")
    write_table(spark.range(1000).selectExpr("1000 - id AS id", "'a,b' AS t"), out, ["id"])
    back = spark.read.csv(out, header=True)
    assert back.count() == 1000 and back.filter("t = 'a,b'").count() == 1000
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    ids = [int(line.split(",")[0]) for p in parts for line in p.read_text().splitlines()[1:]]
    assert ids == sorted(ids)


def test_durable_rows_read_back_from_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "cast(id AS string) s")
    cut = durable(df)
    assert sorted(cut.collect()) == sorted(df.collect())
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder.rstrip("/") in f for f in cut.inputFiles())


def test_doubled_quotes_commas_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n1,"say ""hi"", you",5\n2,"two\nlines",6\n3,plain,7\n', encoding="utf-8")
    kinds = schema(id=WHOLE, name=TEXT, x=NUMBER)
    got = read_delimited(spark, str(tmp_path), kinds, multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'say "hi", you', 5.0), (2, "two\nlines", 6.0), (3, "plain", 7.0)]


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,one,10\n")
    (tmp_path / "b.csv").write_text("x,extra,id,name\n20,-,2,two\n")
    kinds = schema(id=WHOLE, name=TEXT, x=NUMBER)
    for path in (str(tmp_path), [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]):
        got = read_delimited(spark, path, kinds).orderBy("id").collect()
        assert [tuple(r) for r in got] == [(1, "one", 10.0), (2, "two", 20.0)]


def test_written_quotes_are_doubled(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    write_table(frame([(1, 'say "hi", you')], "id long, name string"), path, ["id"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"say ""hi"", you"' in text
    assert read_delimited(spark, path, schema(id=WHOLE, name=TEXT)).first().name == 'say "hi", you'


def test_release_deletes_what_was_written(spark, frame):
    from cohortline.session import durable, release

    kept = durable(frame([(1,)], "a int"))
    folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    assert release(spark) >= 1 and not os.path.exists("/" + folder.lstrip("/"))


def test_scratch_releases_its_own(spark, frame):
    """A block deletes what it wrote, other sessions' folders and earlier ones stay."""
    import os

    from cohortline.session import durable, release, scratch

    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    kept = durable(frame([(1,)], "x int"))
    other = spark.newSession()
    theirs = durable(other.createDataFrame([(3,)], "x int"))
    with scratch(spark):
        inner = folder(durable(frame([(2,)], "x int")))
        assert os.path.isdir(inner)
    assert not os.path.exists(inner) and kept.collect()[0].x == 1
    release(spark)
    assert theirs.collect()[0].x == 3 and release(other) == 1
