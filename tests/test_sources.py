import pytest

from helpers import rows
from cohortspark.plans.align import with_mutation_patient
from cohortspark.operators import dedup as D
from cohortspark.session import shared_folder
from cohortspark.sources import checkpoints as K
from cohortspark.sources import delimited as S

TSV = """#version 1
Hugo_Symbol\tTumor_Sample_Barcode\tVariant_Classification
KRAS\tTCGA-BH-A0B1-01A\tMissense_Mutation
NA\tTCGA-BH-A0B1-01A\tSilent
TP53\t\tSilent
EGFR\tTCGA-AA-0001-01A#x\tSilent
"""


def test_mutation_scan_cuts_comments_and_missing_values(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text(TSV)
    out = with_mutation_patient(S.read_mutations(spark, str(path)))
    assert rows(out.select("Hugo_Symbol", "Variant_Classification", "Patient_ID")) == sorted(
        [
            ("KRAS", "Missense_Mutation", "TCGA-BH-A0B1"),
            (None, "Silent", "TCGA-BH-A0B1"),
            ("EGFR", None, "TCGA-AA-0001"),
        ],
        key=repr,
    )


def test_mutation_scan_without_inline_comments_keeps_the_mark(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text(TSV)
    out = S.read_mutations(spark, str(path), inline_comments=False)
    assert ("EGFR", "TCGA-AA-0001-01A#x", "Silent") in rows(out)
    assert out.count() == 4


def test_single_column_scan(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text(TSV)
    out = S.read_mutations(spark, str(path), columns=["Tumor_Sample_Barcode"])
    assert out.columns == ["Tumor_Sample_Barcode"] and out.count() == 4
    with pytest.raises(ValueError):
        S.read_mutations(spark, str(path), columns=["Nowhere"])


def test_report_scan_keeps_line_breaks_quotes_and_order(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('patient_filename,x,text\na,1,"one\ntwo, ""three"""\nb,2,plain\nc,3,NA\n')
    out = S.read_reports(spark, str(path)).orderBy("row_order").drop("row_order").collect()
    assert [tuple(r) for r in out] == [("a", 'one\ntwo, "three"'), ("b", "plain"), ("c", None)]


def test_tsv_trims_names_and_reads_empty_as_missing(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text(" id \tn\tgenes\nA\t1\t\nB\tNaN\tKRAS|TP53\n")
    assert rows(S.read_tsv(spark, str(path), "id string, n int, genes string")) == [
        ("A", 1, None),
        ("B", None, "KRAS|TP53"),
    ]


def test_tsv_roundtrip_in_one_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"', 1.5), ("b", None, None)], "k string, t string, v double")
    path = str(tmp_path / "out")
    S.write_tsv(df, path, single_file=True)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    assert rows(S.read_tsv(spark, path, df.schema)) == rows(df)


def test_lines_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}") for i in range(50)], "ord int, line string").repartition(8)
    S.write_lines(df, str(tmp_path / "lines"))
    (part,) = (tmp_path / "lines").glob("part-*")
    assert part.read_text().splitlines() == [f"line {i}" for i in range(50)]


def test_materialize_rebuilds_only_what_is_missing(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert K.materialize(spark, path, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "t" / "_SUCCESS").unlink()  # as a job that died would leave it
    K.materialize(spark, path, build)
    K.materialize(spark, path, build, overwrite=True)
    assert len(calls) == 3


def test_shared_folder_is_the_one_the_cluster_names(spark):
    class Conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.checkpoint.dir": "hdfs:///shared"}.get(key, default)

    class Session:
        conf = Conf

    assert shared_folder(Session) == "hdfs:///shared"


def test_cluster_without_shared_folder_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_comments_end_lines_outside_quotes_only(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text(
        "#v1\nHugo_Symbol\tTumor_Sample_Barcode\tVariant_Classification\n"
        '"K#R"\tTCGA-AA-0001-01A\tSilent\nTP53\t"TCGA-""x""#-1"\tSilent#cut\n'
        + "EGFR\t" + "x" * 100_000 + "\tSilent # tail\n"
    )
    rows = S.read_mutations(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [
        ("K#R", "TCGA-AA-0001-01A", "Silent"),
        ("TP53", 'TCGA-"x"#-1', "Silent"),
        ("EGFR", "x" * 100_000, "Silent "),
    ]


def test_rows_of_several_report_files_follow_the_file_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("patient_filename,text\np1,first\np2,second\n")
    (tmp_path / "b.csv").write_text("patient_filename,text\n" + "".join(f'p{i},"{"long " * 50}\n{i}"\n' for i in range(1, 60)))
    reports = S.read_reports(spark, str(tmp_path))
    kept = {r.patient_filename: r.text for r in D.dedup_first(reports, "patient_filename", "row_order").collect()}
    assert kept["p1"] == "first" and kept["p2"] == "second" and len(kept) == 59
