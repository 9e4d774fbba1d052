"""Registered queries against SQL, and the generator, streaming and compatibility layers."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import compat
from strandlake.plans import catalog
from strandlake.sources.fastx import read_fastx
from strandlake.sources.generator import FastxGen, as_text, generate, line_length_sweep, write


def table(rows, columns):
    fix = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(fix(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(found.fetchall(), columns)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["k", "header", "seq", "quality"]
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_rest_stands_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "strandlake.llm", None)
    for name in [m for m in sys.modules if m.startswith("strandlake.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.SQL)


@pytest.mark.parametrize("gen", [FastxGen.illumina(20), FastxGen.wrapped_fasta(20, 130, 50), FastxGen.protein(5, 40), FastxGen("fastq", 10, 80, 9.0, crlf=True), FastxGen(records=20, mean_len=100, alphabet="iupac", other_chance=0.2)])
def test_generator_round_trip(spark, tmp_path, gen):
    truth = generate(spark, gen, 3)
    write(spark, gen, str(tmp_path / "x"), partitions=2)
    columns = ["header", "seq", "quality"]
    got = read_fastx(spark, str(tmp_path / "x"), columns=columns)
    key = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert key(got) == key(truth) == key(generate(spark, gen, 1))


def test_generator_rates_and_corruption(spark):
    gen = FastxGen(records=50, mean_len=400, alphabet="dna_n", other_chance=0.05)
    n = generate(spark, gen).agg(F.avg((F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))) / F.length("seq"))).first()[0]
    assert 0.04 < n < 0.06
    for kind in ("bad_marker", "short_quality", "no_plus", "truncated"):
        bad = FastxGen.illumina(40).with_(corrupt=kind, corrupt_chance=0.5)
        changed = as_text(generate(spark, bad), bad).exceptAll(as_text(generate(spark, bad), bad.with_(corrupt=None))).count()
        assert 8 < changed < 32
    assert line_length_sweep(spark, 3, 5, 7).first()["value"].count("\n") == 5


def test_generator_in_memory(spark):
    from strandlake.sources.generator import to_bytes, to_text

    gen = FastxGen.illumina(3).with_(crlf=True)
    assert to_text(spark, gen).encode() == to_bytes(spark, gen)
    got = list(compat.iterate_bytes(spark, to_bytes(spark, gen)))
    assert [r.id for r in got] == ["record_0", "record_1", "record_2"] and all(len(r.seq) == 150 == len(r.qual) for r in got)


def test_generator_command_line(spark, tmp_path):
    from strandlake.sources.generator import main

    main([str(tmp_path / "out"), "-f", "fastq", "-n", "7", "-l", "30", "--prefix", "x"])
    assert sorted(r["header"] for r in read_fastx(spark, str(tmp_path / "out"), columns=["header"]).collect()) == [f"x{i}" for i in range(7)]


def test_compat_iterators_and_folds(spark, tmp_path):
    data = b"@read1 some description\nACGTACGT\n+\nIIIIIIII\n@b\nAC\n+\nII\n"
    first, second = compat.iterate_bytes(spark, data)
    assert (first.id, first.seq, first.raw_seq, first.qual, first.num_bases, first.format) == ("read1 some description", "ACGTACGT", "ACGTACGT", "IIIIIIII", 8, "fastq")
    path = tmp_path / "a.fq"
    path.write_bytes(data)
    assert [r.id for r in compat.iterate_fastx(spark, str(path))] == [first.id, second.id]
    rows = read_fastx(spark, str(path), columns=["file", "header", "seq", "quality", "byte_start"])
    assert compat.record_view(rows).columns == ["id", "seq", "seq_raw", "qual", "index"]
    lengths = compat.fold_partitions(rows, lambda: 0, lambda n, b: n + sum(len(s) for s in b.column("seq").to_pylist()), lambda n: {"n": n}, "n long")
    assert lengths.agg(F.sum("n")).first()[0] == 10

    assert compat.reduce_partitions(rows, list, lambda s, b: s + b.column("header").to_pylist(), lambda a, b: a + b) == [first.id, second.id]
    assert compat.reduce_partitions(rows.where("false"), lambda: 7, lambda s, b: s, lambda a, b: max(a, b)) == 7

    def fail(batch):
        raise RuntimeError("no")

    compat.for_each(rows, lambda batch: None)
    with pytest.raises(Exception, match="no"):
        compat.for_each(rows, fail)


def test_batch_processor_keeps_order(spark, tmp_path):
    class Longest(compat.BatchProcessor):
        schema = "header string, n int"
        requires_ordering = True

        def process_record(self, record):
            return {"header": record["header"], "n": len(record["seq"])}

    path = tmp_path / "a.fa"
    path.write_bytes(b"".join(b">r%d\n%s\n" % (i, b"A" * (i % 7)) for i in range(50)))
    rows = read_fastx(spark, str(path), columns=["file", "header", "seq", "byte_start"], split_bytes=64)
    assert [r["header"] for r in compat.process_parallel(rows, Longest()).collect()] == [f"r{i}" for i in range(50)]


def test_stream_of_arriving_files(spark, tmp_path):
    from strandlake.streaming.arrivals import stream_fastx, windowed_totals

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_bytes(b">a\nACGT\n>b\nNN\n")
    query = stream_fastx(spark, str(folder)).writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    (folder / "b.fq").write_bytes(b"@q\nA\n+\nI\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r["header"] for r in spark.sql("select header from arrived").collect()) == ["a", "b", "q"]
    totals = windowed_totals(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    totals.processAllAvailable()
    totals.stop()
    assert spark.sql("select sum(n_records) n, sum(n_bases) b from totals").first().asDict() == {"n": 3, "b": 7}
