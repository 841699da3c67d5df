import gzip
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from helixframe.sources import matrix, splits

FASTA = ">t1|g1|Abc first\nACGT\nac gt\n>t2\n\n>t3 x\r\nAAAA\r\nCC\r\n>\nGGGG\n>>t4\nTT\n>t5|g5|s5\nA>C\n\n>t6\nTTTT"
MATRIX = "ensembl_transcript_id\tsym\tensembl_peptide_id\ts1\ts2\ts3\nt1\tAbc\tp1\t1.5\tx\t-2\nt2\t\tp2\t\tNaN\t1e3\n\n\"t3\"\tDef\t\t7\t8\nt4\tGhi\tp4\t1\t2\t3\t4\n"


@given(st.text("a\n>", max_size=40), st.integers(1, 9), st.integers(1, 5), st.sampled_from([b"\n", b"\n>"]))
def test_ranges_have_every_piece_once(text, step, read, mark):
    data = text.encode()
    out = []
    for a in range(0, max(1, len(data)), step):
        f = io.BytesIO(data)
        f.seek(a)
        out += splits.pieces(f, a, a + step, mark, read)
    assert out == data.split(mark)


@pytest.mark.parametrize("split", [1, 5, 17, 1000])
def test_fasta_equals_the_plain_reader(spark, tmp_path, split):
    (tmp_path / "f.fa").write_text(FASTA, newline="")
    path = str(tmp_path / "f.fa")
    got = splits.fasta(spark, path, split)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, matrix.read_fasta(spark, path).collect()))
    assert got.rdd.getNumPartitions() == -(-len(FASTA.encode()) // split)


def test_fasta_folders_compressed_and_empty(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAC\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "none.fa").write_text("")
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">y\nGT\n>z\nTT\n"))
    assert sorted(map(tuple, splits.fasta(spark, "file://" + str(tmp_path), 3).collect())) == [("x", "AC"), ("y", "GT"), ("z", "TT")]
    assert splits.fasta(spark, str(tmp_path / "*.gz"), 3).count() == 2
    assert splits.fasta(spark, str(tmp_path / "none.fa")).count() == 0
    with pytest.raises(Exception, match="absent"):
        splits.fasta(spark, str(tmp_path / "absent.fa")).count()


@pytest.mark.parametrize("split", [4, 31, 1000])
def test_matrix_equals_the_plain_reader(spark, tmp_path, split):
    (tmp_path / "m.tsv").write_text(MATRIX)
    path = str(tmp_path / "m.tsv")
    got, want = splits.expression(spark, path, split_bytes=split), matrix.read_expression(spark, path)
    assert got.schema == want.schema
    key = lambda rows: sorted(map(str, rows))
    assert key(got.collect()) == key(want.collect())
    some = splits.expression(spark, path, ["s3", "s1"], split_bytes=split)
    assert some.columns == [*matrix.META, "s3", "s1"]
    assert key(some.collect()) == key(want.select(*some.columns).collect())


def test_matrix_files_in_other_orders_and_errors(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ensembl_transcript_id\tsym\ts1\ts2\nt1\ta\t1\t2\n")
    (tmp_path / "b.tsv").write_text("sym\tensembl_transcript_id\ts2\nb\tt2\t4\n")
    rows = splits.expression(spark, str(tmp_path), ["s2", "s1"], split_bytes=7).collect()
    assert sorted(map(tuple, rows)) == [("t1", "a", 2.0, 1.0), ("t2", "b", 4.0, None)]
    with pytest.raises(Exception, match="missing columns"):
        splits.expression(spark, str(tmp_path), ["s9"]).count()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.tsv").write_text("sym\ts1\n")
    with pytest.raises(Exception, match="missing columns"):
        splits.expression(spark, str(tmp_path / "c")).count()
