import pytest

from tarnwork.sources.files import ContractError, checked_read, coerce_numbers, content_hash, content_manifest, export_csv, read_gmt, read_wide


def test_wide_source_and_coercion(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("id,P1N,P1T,note\nA;B, 1.5 ,,x\nC,bad,2e3,y\n")
    long = coerce_numbers(read_wide(spark, str(p), "id"), "text").collect()
    assert {(r.id, r.sample_id): (r.value, r.failed) for r in long} == {("A;B", "P1N"): (1.5, False), ("A;B", "P1T"): (None, False), ("C", "P1N"): (None, True), ("C", "P1T"): (2000.0, False)}
    with pytest.raises(ContractError):
        read_wide(spark, str(p), "missing")


def test_gmt(spark, tmp_path):
    p = tmp_path / "sets.gmt"
    p.write_text("S1\tR-1\tA\tB\tA\nshort\tonly\nS2\tR-2\tC\n")
    assert [(r.name, r.stable_id, r.genes) for r in read_gmt(spark, str(p)).collect()] == [("S1", "R-1", ["A", "B"]), ("S2", "R-2", ["C"])]


def test_manifest_hash_and_export(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("hello")
    row = content_manifest(spark, str(tmp_path), "*.txt").first()
    assert row.bytes == 5 and row.sha256 == "2CF24DBA5FB0A30E26E83B2AC5B9E29E1B161E5C1FA7425E73043362938B9824"
    assert checked_read(spark, str(p), row.sha256.lower()).first()[0] == "hello"
    with pytest.raises(ContractError):
        checked_read(spark, str(p), "00")
    df = spark.createDataFrame([(1, ["x", "y"]), (2, None)], "a int, b array<string>")
    assert content_hash(df) == content_hash(df.repartition(3).select("b", "a")) != content_hash(df.limit(1))
    export_csv(df, str(tmp_path / "out"), compressed=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).where("a = 1").first().b == "x;y"
