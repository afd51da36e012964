import random

from orfweave.streaming.annotate_stream import annotate


def test_files_arrive(spark, tmp_path):
    rng = random.Random(1)
    seq = lambda: "atg" + "".join(rng.choices("acg", k=297)) + "taa"
    folder, target = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def run():
        annotate(spark, str(folder), str(target), str(tmp_path / "state")).awaitTermination()
        return sorted({r.contig_id.rpartition("/")[2] for r in spark.read.parquet(str(target)).collect()})

    (folder / "a.fa").write_text(f">one x\n{seq()}\n>two\n{seq()}\n")
    assert run() == ["a.fa#one", "a.fa#two"]
    (folder / "b.fa").write_text(f"lost\n>one\n{seq()}\n")
    assert run() == ["a.fa#one", "a.fa#two", "b.fa#one"]
