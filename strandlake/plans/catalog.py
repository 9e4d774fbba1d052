"""Registered queries: the engine's operators over reads that are derived from `orders`, and the SQL for the same rows.

Reads are a function of the order key: sequences of 0 to 96 residues with Ns and lower case, qualities with @ and +. The
Spark side writes them as FASTA or FASTQ text, about 64 reads to a text, and parses them back; the SQL works on the derived
columns, so a parser's fault shows as a difference.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import aggregates as agg
from ..operators.compat import BatchProcessor, fold_partitions, process_parallel, record_view
from ..operators.intervals import asof, overlaps
from ..operators.ordering import with_record_index
from ..operators.parse import parse_fastx
from ..operators.project import apply_options, split_runs
from ..options import FastxOptions
from ..sources import sink
from ..sources.chunks import read_chunked
from ..sources.fastx import read_fastx, read_numbered
from ..streaming.ranges import stream_ranges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many reads a task derives at most; text of theirs is some 15 MB.
TASK_READS = 1 << 17


def spread(spark: SparkSession, sf_dir: str, by: str = "k", ranges: bool = False) -> DataFrame:
    """k and text_id of all reads, dealt by a hash of `by` or by its ranges. The table's splits follow its bytes, of which a key has
    few, but a read is derived and coded at many times that cost: so there are some tasks for each core, and none is large."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 64).alias("text_id"))
    n = max(4 * spark.sparkContext.defaultParallelism, -(-keys.count() // TASK_READS))
    return keys.repartitionByRange(n, by).sortWithinPartitions(by) if ranges else keys.repartition(n, by)


def reads(keys: DataFrame) -> DataFrame:
    """keys with header, seq and quality of the reads that are derived from k."""
    key = F.col("k").cast("string")

    def line(salts: str, letters: str) -> Column:
        hexes = F.concat(*[F.md5(F.concat(F.lit(s), key).cast("binary")) for s in salts])
        return F.translate(F.substring(hexes, F.lit(1), (F.col("k") % 97).cast("int")), "0123456789abcdef", letters)

    return keys.select("*", F.concat(F.lit("r"), key).alias("header"), line("abc", "ACGTACGTACGTacgN").alias("seq"), line("qrs", "!#+5:?@BDFHIJKLM").alias("quality"))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, header, seq and quality of the derived reads."""
    return reads(spread(spark, sf_dir)).drop("text_id")


def derived_texts(spark: SparkSession, sf_dir: str, text: Column, end: str = "\n") -> DataFrame:
    """text_id and content of the texts that the derived reads make up. Keys are dealt by text, so no read is shuffled."""
    return sink.concatenated(reads(spread(spark, sf_dir, "text_id")), text, ["k"], "text_id", end=end)


def parsed(spark: SparkSession, sf_dir: str, kind: str = "fastq", columns: tuple[str, ...] = ("header", "seq", "quality"), width: int = 0, crlf: bool = False) -> DataFrame:
    """The derived reads after a turn as text, with their k; text_id tells the texts apart."""
    text = sink.fastq_text(crlf=crlf) if kind == "fastq" else sink.fasta_text(width=width, crlf=crlf)
    files = derived_texts(spark, sf_dir, text, "\r\n" if crlf else "\n")
    return parse_fastx(files, "content", keys=("text_id",), columns=columns).withColumn("k", F.substring("header", 2, 20).cast("long"))


READS = """reads as (select o_orderkey as k, 'r' || o_orderkey as header,
  substr(translate(md5('a' || o_orderkey) || md5('b' || o_orderkey) || md5('c' || o_orderkey), '0123456789abcdef', 'ACGTACGTACGTacgN'), 1, (o_orderkey % 97)::int) as seq,
  substr(translate(md5('q' || o_orderkey) || md5('r' || o_orderkey) || md5('s' || o_orderkey), '0123456789abcdef', '!#+5:?@BDFHIJKLM'), 1, (o_orderkey % 97)::int) as quality
  from orders)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; `with` stands for the reads in its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("with reads", f"with {READS}")
        return f

    return put


@query("with reads select k, header, seq, quality from reads")
def q_reads(spark, sf_dir):
    return parsed(spark, sf_dir).select("k", "header", "seq", "quality")


@query("with reads select k, seq, seq as lines from reads")
def q_fasta_wrapped(spark, sf_dir):
    return parsed(spark, sf_dir, "fasta", ("header", "seq"), width=20).select("k", "seq", F.col("seq").alias("lines"))


@query("with reads select k, seq from reads")
def q_fasta_crlf(spark, sf_dir):
    return parsed(spark, sf_dir, "fasta", ("header", "seq"), width=20, crlf=True).select("k", "seq")


@query("with reads select k, seq, quality from reads")
def q_fastq_crlf(spark, sf_dir):
    return parsed(spark, sf_dir, crlf=True).select("k", "seq", "quality")


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder for files that a query writes and reads: in the folder that the cluster shares, or, on a local master that
    has none, a temporary one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder or tempfile.mkdtemp(prefix='spark-')}/reads-{uuid.uuid4().hex}".removeprefix("file:")


@query("with reads select k, seq, quality, length(seq)::bigint as dna_len from reads")
def q_source_fastq(spark, sf_dir):
    """By way of files that are read in small ranges."""
    path = _files(spark, sf_dir)
    sink.write_fastq(derived(spark, sf_dir), path)
    return read_fastx(spark, path, columns=["header", "seq", "quality", "dna_len"], split_bytes=1 << 16).select(F.substring("header", 2, 20).cast("long").alias("k"), "seq", "quality", "dna_len")


@query("with reads select k, seq from reads")
def q_source_fasta_gzip(spark, sf_dir):
    path = _files(spark, sf_dir)
    sink.write_fasta(derived(spark, sf_dir), path, width=60, compression="gzip")
    return read_fastx(spark, path, columns=["header", "seq"]).select(F.substring("header", 2, 20).cast("long").alias("k"), "seq")


def _chunked(name: str):
    """Registers a query by way of files of one compressed stream, whose chunks many tasks parse."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _files(spark, sf_dir)
        sink.write_fastx(derived(spark, sf_dir), path, compression=name)
        rows = read_chunked(spark, path, columns=["header", "seq", "quality", "byte_start", "byte_end"], chunk_bytes=1 << 16)
        return rows.select(F.substring("header", 2, 20).cast("long").alias("k"), "seq", "quality", (F.col("byte_end") - F.col("byte_start")).alias("n_bytes"))

    run.__name__ = f"q_chunked_{name}"
    query("with reads select k, seq, quality, (length('@r' || k) + 2 * length(seq) + 5)::bigint as n_bytes from reads")(run)


for _name in ("gzip", "bzip2", "xz"):
    _chunked(_name)


def _ranged(name: str):
    """Registers a query by way of files that the writer makes of blocks or frames, and that are read in small ranges."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _files(spark, sf_dir)
        sink.write_fastx(derived(spark, sf_dir), path, kind="fasta", width=30, compression=name, block_bytes=1 << 14)
        rows = read_fastx(spark, path, columns=["header", "seq", "dna_len"], split_bytes=1 << 16)
        return rows.select(F.substring("header", 2, 20).cast("long").alias("k"), "seq", "dna_len")

    run.__name__ = f"q_{name}_ranges"
    query("with reads select k, seq, length(seq)::bigint as dna_len from reads")(run)


for _name in ("bgzf", "zstd"):
    _ranged(_name)


@query("with reads select k, translate(seq, 'ACac', '@+@+') as seq, quality from reads")
def q_fastq_any_letters(spark, sf_dir):
    """Sequences, as qualities, of which many begin with @ or +, in files that are read in small ranges."""
    path = _files(spark, sf_dir)
    sink.write_fastx(derived(spark, sf_dir).withColumn("seq", F.translate("seq", "ACac", "@+@+")), path, compression=None)
    rows = read_fastx(spark, path, columns=["header", "seq", "quality"], split_bytes=1 << 14)
    return rows.select(F.substring("header", 2, 20).cast("long").alias("k"), "seq", "quality")


@query("with reads select k, seq, quality, length(seq)::bigint as dna_len from reads")
def q_stream_ranges(spark, sf_dir):
    """Files read as a stream of small ranges until there are no more."""
    path = _files(spark, sf_dir)
    sink.write_fastx(derived(spark, sf_dir), path, compression=None)
    rows = stream_ranges(spark, path, columns=["header", "seq", "quality", "dna_len"], split_bytes=1 << 16)
    out = _files(spark, sf_dir)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").select(F.substring("header", 2, 20).cast("long").alias("k"), "seq", "quality", "dna_len")


@query("with reads select k, length(seq)::bigint as dna_len from reads")
def q_dna_len(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "dna_len")).select("k", "dna_len")


@query("""with reads, parts as (select k, string_split(regexp_replace(seq, '([ACGTacgt]+)', '\\1' || chr(1), 'g'), chr(1)) as p from reads),
numbered as (select k, p, unnest(generate_series(1, len(p) - 1)) as i from parts)
select k, (i - 1)::int as run_index, (list_sum(list_transform(p[1:i], lambda x: length(x))) - length(regexp_extract(p[i], '[ACGTacgt]+$')))::bigint as run_start,
list_sum(list_transform(p[1:i], lambda x: length(x)))::bigint as run_end, regexp_extract(p[i], '[ACGTacgt]+$') as run from numbered""")
def q_split_runs(spark, sf_dir):
    return split_runs(parsed(spark, sf_dir, columns=("header", "seq"))).select("k", "run_index", "run_start", "run_end", "run")


@query("with reads select k, regexp_replace(seq, '[^ACGTacgt]', '', 'g') as seq from reads")
def q_skip(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "seq")).select("k", dna.skip_non_actg("seq").alias("seq"))


@query("""with reads, bad as (select k, length(regexp_extract(seq, '^[ACGTacgt]*')) as pos, seq from reads where regexp_matches(seq, '[^ACGTacgt]'))
select k, pos::bigint as pos, ascii(substr(seq, (pos + 1)::int, 1))::int as byte from bad""")
def q_reject_first_bad(spark, sf_dir):
    rows = parsed(spark, sf_dir, columns=("header", "seq")).select("k", dna.base_error("seq").alias("e")).where("e is not null")
    return rows.select("k", "e.pos", "e.byte")


SIGNED = "cast(case when {0} >= 9223372036854775808 then {0} - 18446744073709551616 else {0} end as bigint)"


def words_sql(value: str, width: int, bits: int) -> str:
    return f"list_sum(list_transform(generate_series(0, {width - 1}), lambda j: case when i * {width} + j < length(seq) then ({value})::hugeint << ({bits} * j)::int else 0::hugeint end))"


BASE = "ascii(substr(seq, (i * {w} + j + 1)::int, 1))"
PACKED = words_sql("(" + BASE.format(w=32) + " >> 1) & 3", 32, 2)


@query(f"""with reads, w as (select k, i, {PACKED} as w from (select k, seq, unnest(generate_series(0, length(seq) // 32)) as i from reads) t)
select k, i::int as i, {SIGNED.format("w")} as w from w""")
def q_pack_words(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "seq")).select("k", F.posexplode(dna.pack_words("seq")).alias("i", "w"))


HIGH, LOW = (words_sql(f"({BASE.format(w=64)} >> {s}) & 1", 64, 1) for s in (2, 1))


@query(f"""with reads, w as (select k, i, {HIGH} as hi, {LOW} as lo from (select k, seq, unnest(generate_series(0, length(seq) // 64)) as i from reads) t)
select k, i::int as i, {SIGNED.format("hi")} as hi, {SIGNED.format("lo")} as lo from w""")
def q_planes(spark, sf_dir):
    planes = parsed(spark, sf_dir, columns=("header", "seq")).select("k", dna.columnar_dna("seq").alias("p"))
    return planes.select("k", F.posexplode(F.arrays_zip("p.hi", "p.lo")).alias("i", "w")).select("k", "i", "w.hi", "w.lo")


def mask_sql(test: str) -> str:
    words = words_sql(f"case when {test} then 1 else 0 end", 64, 1).replace("{c}", "substr(seq, (i * 64 + j + 1)::int, 1)")
    return f"with reads, w as (select k, i, {words} as w from (select k, seq, unnest(generate_series(0, length(seq) // 64)) as i from reads) t) select k, i::int as i, {SIGNED.format('w')} as w from w"


@query(mask_sql("not regexp_matches({c}, '[ACGTacgt]')"))
def q_mask_non_actg(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "seq")).select("k", F.posexplode(dna.mask_non_actg("seq")["words"]).alias("i", "w"))


@query(mask_sql("upper({c}) = 'N'"))
def q_mask_n(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "seq")).select("k", F.posexplode(dna.mask_n("seq")["words"]).alias("i", "w"))


@query("with reads select k, upper(regexp_replace(seq, '[^ACGTacgt]', '', 'g')) as seq from reads")
def q_unpack_roundtrip(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "seq")).select("k", dna.unpack_dna(dna.pack_dna(dna.skip_non_actg("seq"))).alias("seq"))


@query("with reads select k, upper(regexp_replace(seq, '[^ACGTacgt]', '', 'g')) as seq from reads")
def q_columnar_roundtrip(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "seq")).select("k", dna.unpack_columnar(dna.columnar_dna(dna.skip_non_actg("seq"))).alias("seq"))


@query("with reads select k, substr('ACTG', (((ascii(substr(seq, (length(seq) // 2 + 1)::int, 1)) >> 1) & 3) + 1)::int, 1) as middle from reads where length(seq) > 0")
def q_base_at(spark, sf_dir):
    middle = F.floor(F.octet_length("seq") / 2).cast("int")
    return parsed(spark, sf_dir, columns=("header", "seq")).where("seq <> ''").select("k", dna.base_at(dna.pack_words("seq"), middle).alias("middle"))


@query("""with reads select 'fastq' as format, count(*)::bigint as num_seqs, sum(length(seq))::bigint as sum_len, min(length(seq))::bigint as min_len, avg(length(seq)) as avg_len, max(length(seq))::bigint as max_len from reads""")
def q_seq_stats(spark, sf_dir):
    return agg.seq_stats(parsed(spark, sf_dir, columns=("header", "format", "dna_len")), "format")


@query("with reads select " + ", ".join(f"sum(length(seq) - length(replace(upper(seq), '{b}', '')))::bigint as {b.lower()}" for b in "ACTG") + " from reads")
def q_base_histogram(spark, sf_dir):
    return agg.base_histogram(parsed(spark, sf_dir, columns=("header", "seq")))


@query("with reads select count(*)::bigint as n_records, sum(length(seq))::bigint as n_bases, sum(length(regexp_replace(seq, '[^ACGTacgt]', '', 'g')))::bigint as n_actg from reads")
def q_total_actg(spark, sf_dir):
    return agg.totals(parsed(spark, sf_dir, columns=("header", "seq")))


@query("with reads select header, length(seq)::bigint as dna_len from reads")
def q_header_lengths(spark, sf_dir):
    return agg.header_lengths(parsed(spark, sf_dir, columns=("header", "dna_len", "byte_start")))


@query("""with reads, runs as (select upper(unnest(regexp_extract_all(seq, '([ACGTacgt]+)', 1))) as run from reads),
words as (select unnest(list_transform(generate_series(1, length(run) - 3), lambda i: substr(run, i::int, 4))) as w from runs where length(run) >= 4)
select least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as kmer, count(*)::bigint as n from words group by 1""")
def q_canonical_kmers(spark, sf_dir):
    return agg.kmer_counts(parsed(spark, sf_dir, columns=("header", "seq")), 4)


@query("with reads select k, sum(length(seq)) over (partition by k // 64 order by k rows unbounded preceding)::bigint as merged_len from reads")
def q_merge_running(spark, sf_dir):
    rows = parsed(spark, sf_dir, columns=("header", "dna_len", "record_index"))
    return agg.running_length(rows, ["record_index"], "text_id").select("k", "merged_len")


@query("with reads select k // 64 as text_id, string_agg(seq, '' order by k) as seq from reads group by 1")
def q_merge_records(spark, sf_dir):
    return agg.merge_sequences(parsed(spark, sf_dir, columns=("header", "seq", "record_index")), ["record_index"], "text_id")


@query("with reads select header as record, 0 as line_no, '>' || header as line from reads union all select header, 1, seq from reads")
def q_fq_to_fa(spark, sf_dir):
    return sink.fastq_to_fasta(parsed(spark, sf_dir))


@query("with reads select k, (length('@r' || k) + 2 * length(seq) + 5)::bigint as n_bytes from reads")
def q_ranges(spark, sf_dir):
    return parsed(spark, sf_dir, columns=("header", "byte_start", "byte_end")).select("k", (F.col("byte_end") - F.col("byte_start")).alias("n_bytes"))


@query("""select doc_id, strlen(text)::bigint as n_bytes, len(regexp_extract_all(text, '[ACGTacgt]+'))::bigint as n_runs, length(regexp_replace(text, '[^ACGTacgt]', '', 'g'))::bigint as n_actg from documents""")
def q_doc_residues(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", dna.dna_len("text").alias("n_bytes"), F.size(dna.actg_runs("text")).cast("long").alias("n_runs"), dna.actg_len("text").alias("n_actg"))


@query("""with reads select k, sum(ascii(c) - 33) / count(*) as phred from (select k, unnest(string_split(quality, '')) as c from reads where length(quality) > 0) t group by k""")
def q_phred_mean(spark, sf_dir):
    return parsed(spark, sf_dir).where("quality <> ''").select("k", dna.phred_mean("quality").alias("phred"))


@query("with reads select r.k, r.seq from reads r where r.k in (select l_orderkey from lineitem where l_quantity >= 49)")
def q_join_semi(spark, sf_dir):
    """Built-in semi join on parsed reads."""
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("k"))
    return parsed(spark, sf_dir, columns=("header", "seq")).join(wanted, "k", "left_semi").select("k", "seq")


@query("with reads select k, length(seq)::bigint as dna_len from reads order by length(seq) desc, k limit 100")
def q_topk(spark, sf_dir):
    """Built-in top-k on parsed reads."""
    return parsed(spark, sf_dir, columns=("header", "dna_len")).select("k", "dna_len").orderBy(F.desc("dna_len"), "k").limit(100)


@query("with reads select k, seq from reads where k % 2 = 0 union all select k, seq from reads where k % 3 = 0")
def q_union(spark, sf_dir):
    """Built-in union of two scans."""
    rows = parsed(spark, sf_dir, columns=("header", "seq")).select("k", "seq")
    return rows.where("k % 2 = 0").unionByName(rows.where("k % 3 = 0"))


@query("with reads select k, seq, row_number() over (partition by k // 64 order by length(seq) desc, k) as place from reads")
def q_rank_window(spark, sf_dir):
    """Built-in ranking within each text."""
    rows = parsed(spark, sf_dir, columns=("header", "seq", "dna_len"))
    return rows.select("k", "seq", F.row_number().over(Window.partitionBy("text_id").orderBy(F.desc("dna_len"), "k")).cast("long").alias("place"))


@query("""with reads, r as (select k, list_transform(regexp_extract_all(seq, '([ACGTacgt]+)', 1), lambda x: upper(x)) as rs from reads),
runs as (select k, i - 1 as run_index, rs[i] as run from (select k, rs, unnest(generate_series(1, len(rs))) as i from r) t where length(rs[i]) >= 31),
words as (select k, run_index, p as position, substr(run, (p + 1)::int, 21) as m from (select k, run_index, run, unnest(generate_series(0, length(run) - 21)) as p from runs) t),
hashed as (select *, md5(least(m, reverse(translate(m, 'ACGT', 'TGCA')))) as h from words),
spread as (select a.k, a.run_index, a.position as first, b.position, b.m, b.h from hashed a join hashed b on a.k = b.k and a.run_index = b.run_index and b.position between a.position and a.position + 10),
least_of as (select k, run_index, first, arg_min(position, (h, position)) as position, arg_min(m, (h, position)) as minimizer, count(*) as n from spread group by all)
select distinct k, run_index::int as run_index, position::int as position, minimizer from least_of where n = 11""")
def q_minimizers(spark, sf_dir):
    """k = 21, w = 11, by the MD5 digests of canonical words."""
    rows = parsed(spark, sf_dir, columns=("header", "seq"))
    return agg.minimizers(rows, 21, 11).select("k", "run_index", "position", "minimizer")


@query("with reads select k // 64 as text_id, string_agg(seq, '' order by k) as seq from reads group by 1")
def q_merged_parts(spark, sf_dir):
    """The merged sequences in parts of 16 records, put together again."""
    parts = agg.merged_parts(parsed(spark, sf_dir, columns=("header", "seq", "record_index")), ["record_index"], "text_id", block=16)
    whole = F.sort_array(F.collect_list(F.struct("merged_start", "seq")))
    return parts.groupBy("text_id").agg(F.array_join(F.transform(whole, lambda p: p["seq"]), "").alias("seq"))


def _coded(name: str):
    """Registers a query by way of texts that are compressed with a codec, two streams to a text, and told by their bytes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = compressor(name)
            for b in (batch.slice(at, 128) for batch in batches for at in range(0, len(batch), 128)):  # a batch is up to 10,000 texts
                halves = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x) + pack(y) for x, y in halves], pa.binary())], ["text_id", "content"])

        texts = derived_texts(spark, sf_dir, sink.fastq_text())
        coded = texts.select("text_id", F.col("content").cast("binary").alias("content")).mapInArrow(encode, "text_id long, content binary")
        rows = parse_fastx(coded, "content", keys=("text_id",), columns=("header", "seq", "quality"), decompress=True)
        return rows.select(F.substring("header", 2, 20).cast("long").alias("k"), "seq", "quality")

    run.__name__ = f"q_codec_{name}"
    query("with reads select k, seq, quality from reads")(run)


def compressor(name: str) -> Callable[[bytes], bytes]:
    import bz2
    import gzip
    import lzma

    import zstandard

    return {"gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress, "bzip2": bz2.compress, "xz": lzma.compress}[name]


for _name in ("gzip", "zstd", "bzip2", "xz"):
    _coded(_name)


@query("with reads select k, (row_number() over (partition by k // 64 order by k) - 1)::bigint as record_index from reads")
def q_record_index(spark, sf_dir):
    """Dense numbers in two levels, by blocks of 512 bytes."""
    rows = parsed(spark, sf_dir, columns=("header", "byte_start")).withColumn("file", F.col("text_id").cast("string"))
    return with_record_index(rows, 512).select("k", F.col("record_index").cast("long").alias("record_index"))


@query("""with reads select k, ((length(seq) // 32 + 1) * 8)::bigint as n_bytes,
(select coalesce(sum(((ascii(substr(seq, j::int, 1)) >> 1) & 3) << (2 * (j - 1))::int), 0) from generate_series(1, 4) t(j) where j <= length(seq))::bigint as first_byte, true as same from reads""")
def q_packed_bytes(spark, sf_dir):
    """Packed words as bytes, and back."""
    rows = parsed(spark, sf_dir, columns=("header", "seq")).withColumn("words", dna.pack_words("seq")).withColumn("packed", dna.packed_bytes("words"))
    first = F.conv(F.hex(F.substring("packed", 1, 1)), 16, 10).cast("long")
    return rows.select("k", F.octet_length("packed").cast("long").alias("n_bytes"), first.alias("first_byte"), (dna.words_from_bytes("packed") == F.col("words")).alias("same"))


@query("""with reads select k, case when k % 4 < 2 then null else header end as header,
case k % 4 when 0 then 'InvalidRecordStart' when 1 then 'TruncatedRecord' end as kind, case when k % 4 = 0 then 33 end::int as byte from reads""")
def q_errors(spark, sf_dir):
    """Inputs with a false first byte, inputs that end within a record, and good ones, read permissively."""
    good = F.concat(sink.fastq_text(), F.lit("\n"))
    text = F.when(F.col("k") % 4 == 0, F.concat(F.lit("!"), good)).when(F.col("k") % 4 == 1, F.concat(F.lit("@"), "header", F.lit("\n"), "seq")).otherwise(good)
    rows = parse_fastx(derived(spark, sf_dir).select("k", text.alias("content")), "content", keys=("k",), columns=("header", "error"), mode="PERMISSIVE")
    return rows.select("k", "header", "error.kind", "error.byte")


@query("""with reads select k, header, regexp_replace(seq, '[^ACGTacgt]', '', 'g') as seq, length(regexp_replace(seq, '[^ACGTacgt]', '', 'g'))::bigint as dna_len from reads""")
def q_options_skip(spark, sf_dir):
    """An option set turned into columns: headers, sequences without other residues, and their lengths."""
    options = FastxOptions().compute_headers().ignore_quality().compute_dna_len().dna_string().skip_non_actg()
    rows = parsed(spark, sf_dir, columns=("header", "seq", "byte_start")).withColumn("file", F.col("text_id").cast("string"))
    return apply_options(rows, options).select(F.substring("header", 2, 20).cast("long").alias("k"), "header", "seq", "dna_len")


@query("""with reads, runs as (select k, unnest(regexp_extract_all(seq, '([ACGTacgt]+)', 1)) as run from reads)
select 'chunk' as event, k, run from runs union all select 'record', k, array_to_string(regexp_extract_all(seq, '([ACGTacgt]+)', 1), '|') from reads""")
def q_options_events(spark, sf_dir):
    """Split mode with both events: a row for each run, and one for each record with its runs."""
    options = FastxOptions().compute_headers().ignore_quality().dna_string().split_non_actg().return_record(True).return_dna_chunk(True)
    rows = parsed(spark, sf_dir, columns=("header", "seq", "byte_start")).withColumn("file", F.col("text_id").cast("string"))
    events = apply_options(rows, options)
    names = rows.select("file", "byte_start", "k")
    shown = F.when(F.col("event") == "chunk", F.col("seq")).otherwise(F.array_join("runs", "|"))
    return events.join(names, ["file", "byte_start"]).select("event", "k", shown.alias("run"))


PLACED = """with reads, l as (select k, k // 64 as t, (k % 64) * 20 as s, (k % 64) * 20 + length(seq) as e from reads),
r as (select k, k // 64 as t, (k * 7) % 1500 as s, (k * 7) % 1500 + length(seq) // 2 as e from reads)"""


def placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The reads as two sets of intervals on each text."""
    rows = parsed(spark, sf_dir, columns=("header", "dna_len")).select("k", "dna_len")
    text = F.floor(F.col("k") / 64).alias("t")
    left, right = F.col("k") % 64 * 20, F.col("k") * 7 % 1500
    return (
        rows.select("k", text, left.alias("start"), (left + F.col("dna_len")).alias("end")),
        rows.select("k", text, right.alias("start"), (right + F.floor(F.col("dna_len") / 2)).alias("end")),
    )


@query(PLACED + """ select l.k, r.k as k_right, least(l.e, r.e) - greatest(l.s, r.s) as shared from l join r on l.t = r.t and l.s < r.e and r.s < l.e and l.s < l.e and r.s < r.e""")
def q_overlaps(spark, sf_dir):
    """Intervals that share a coordinate, found by bins of 64 coordinates."""
    pairs = overlaps(*placed(spark, sf_dir), ["t"], width=64)
    return pairs.select("k", "k_right", (F.least("end", "end_right") - F.greatest("start", "start_right")).alias("shared"))


@query(PLACED + """ select l.k, max(r.s) as start_right, arg_max(r.k, (r.s, r.e, r.k)) as k_right from l left join r on l.t = r.t and r.s <= l.e group by l.k""")
def q_asof(spark, sf_dir):
    """The interval that begins last at or before another's end."""
    left, right = placed(spark, sf_dir)
    return asof(left, right.select("t", "start", "end", "k"), ["t"], at="end", width=64).select("k", "start_right", "k_right")


@query("""with reads select k % 8 as part, k % 3 as third, ((1 - grouping(k % 8)) + (1 - grouping(k % 3)))::int as level, count(*) as num_seqs, sum(length(seq))::bigint as sum_len, min(length(seq))::bigint as min_len, avg(length(seq)) as avg_len, max(length(seq))::bigint as max_len from reads group by rollup (k % 8, k % 3)""")
def q_stats_rollup(spark, sf_dir):
    """Statistics of groups, of their parts and of all at once."""
    rows = parsed(spark, sf_dir, columns=("header", "dna_len")).select((F.col("k") % 8).alias("part"), (F.col("k") % 3).alias("third"), "dna_len")
    return agg.seq_rollup(rows, "part", "third")


@query("""with reads, runs as (select k % 8 as part, unnest(regexp_extract_all(upper(seq), '([ACGT]+)', 1)) as run from reads),
words as (select part, unnest(list_transform(generate_series(1, length(run) - 6), lambda i: substr(run, i::int, 7))) as w from runs where length(run) >= 7)
select part, count(distinct least(w, reverse(translate(w, 'ACGT', 'TGCA')))) as n, true as near from words group by rollup (part)""")
def q_distinct_kmers(spark, sf_dir):
    """Distinct words from merged sketches, held against exact counts: within 4 %, five standard errors."""
    rows = parsed(spark, sf_dir, columns=("header", "seq")).select((F.col("k") % 8).alias("part"), (F.col("k") % 5).alias("fifth"), "seq")
    estimates = agg.merged_kmers(agg.kmer_sketches(rows, 7, "part", "fifth"), "part", rollup=True)
    words = rows.select("part", F.explode(dna.actg_runs(F.upper("seq"))).alias("run")).select("part", F.explode(dna.kmers("run", 7)).alias("w"))
    distinct = words.select("part", dna.canonical("w").alias("w")).distinct()  # of few groups, before the rollup takes each row twice
    exact = distinct.rollup("part").agg(F.count_distinct("w").alias("n")).withColumnRenamed("part", "p")
    both = estimates.join(exact, estimates["part"].eqNullSafe(exact["p"]))
    return both.select("part", "n", (F.abs(F.col("distinct_kmers") - F.col("n")) <= 0.04 * F.col("n")).alias("near"))


@query("with reads select k, length(seq)::bigint as dna_len from reads where header like 'r1%' and length(seq) >= 40 and header not in ('r1', 'r10')")
def q_pushed_filters(spark, sf_dir):
    """Filters that the scan tests before it builds columns."""
    path = _files(spark, sf_dir)
    sink.write_fastx(derived(spark, sf_dir), path)
    rows = read_fastx(spark, path, columns=["format", "header", "dna_len"], push_filters=True)
    rows = rows.where("header like 'r1%' and dna_len >= 40 and format = 'fastq' and header not in ('r1', 'r10')")
    return rows.select(F.substring("header", 2, 20).cast("long").alias("k"), "dna_len")


@query("with reads select k, (row_number() over (order by k) - 1)::bigint as record_index from reads")
def q_numbered_ranges(spark, sf_dir):
    """Record numbers in one long file that is cut, from counts of its ranges; the file is put together of sorted part files."""
    path = _files(spark, sf_dir)
    sink.write_fastx(reads(spread(spark, sf_dir, ranges=True)), path, compression=None)
    rows = read_numbered(spark, path, columns=["file", "header", "record_index"], split_bytes=1 << 14)
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    # The files' own numbers, of which there are as many as the writer had tasks.
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("file", before.alias("base"))
    return rows.join(F.broadcast(bases), "file").select(F.substring("header", 2, 20).cast("long").alias("k"), (F.col("record_index") + F.col("base")).alias("record_index"))


class _Lengths(BatchProcessor):
    """Of each batch of records, their keys and lengths, by Arrow functions."""

    schema = "k long, dna_len long"
    requires_ordering = True

    def process_batch(self, batch):
        keys = pc.cast(pc.utf8_slice_codeunits(batch.column("header"), 1, 20), pa.int64())
        return pa.RecordBatch.from_arrays([keys, pc.cast(pc.binary_length(batch.column("seq")), pa.int64())], ["k", "dna_len"])


@query("with reads select k, length(seq)::bigint as dna_len, row_number() over (partition by k // 64 order by k) as place from reads")
def q_ordered_batches(spark, sf_dir):
    """What a processor of batches gives, in the order of the input by the tickets of its batches."""
    rows = parsed(spark, sf_dir, columns=("header", "seq", "byte_start")).withColumn("file", F.col("text_id").cast("string"))
    done = process_parallel(rows.select("file", "byte_start", "header", "seq"), _Lengths())
    order = Window.partitionBy("ticket.file").orderBy("ticket")
    return done.select("k", "dna_len", F.row_number().over(order).cast("long").alias("place"))


@query("with reads select k, seq, quality, null as kind from reads union all select null, null, null, 'Io'")
def q_io_errors(spark, sf_dir):
    """Files of which one isn't there, read permissively."""
    path = _files(spark, sf_dir)
    sink.write_fastx(derived(spark, sf_dir), path)
    rows = read_fastx(spark, [path, f"{path}/none.fq"], columns=["header", "seq", "quality", "error"], mode="PERMISSIVE")
    return rows.select(F.substring("header", 2, 20).cast("long").alias("k"), "seq", "quality", "error.kind")


@query("with reads select k as id, seq as seq_raw, quality as qual, (row_number() over (partition by k // 64 order by k) - 1)::bigint as index from reads")
def q_record_view(spark, sf_dir):
    """The columns that record-by-record readers have, by their names."""
    rows = record_view(parsed(spark, sf_dir, columns=("header", "seq", "quality", "record_index")))
    return rows.select(F.substring("id", 2, 20).cast("long").alias("id"), "seq_raw", "qual", "index")


@query("with reads select count(*)::bigint as n, sum(length(seq))::bigint as n_bases, max(length(seq))::bigint as longest from reads")
def q_fold_partitions(spark, sf_dir):
    """A state for each partition, led through its batches, and the states merged by an aggregation."""

    def step(state, batch):
        sizes = pc.binary_length(batch.column("seq"))
        return (state[0] + len(batch), state[1] + (pc.sum(sizes).as_py() or 0), max(state[2], pc.max(sizes).as_py() or 0))

    states = fold_partitions(parsed(spark, sf_dir, columns=("header", "seq")).select("seq"), lambda: (0, 0, 0), step, lambda s: dict(zip(("n", "n_bases", "longest"), s, strict=True)), "n long, n_bases long, longest long")
    return states.agg(F.sum("n").alias("n"), F.sum("n_bases").alias("n_bases"), F.max("longest").alias("longest"))


@query("""select l_returnflag, count(*) as repeats, round(avg(l_extendedprice / l_quantity), 6) as mean_gbs, round(stddev_pop(l_extendedprice / l_quantity), 6) as stdev_gbs from lineitem group by 1""")
def q_throughput_stats(spark, sf_dir):
    """Mean and deviation of rates, price as 10**9 bytes and quantity as seconds."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("seconds"), (F.col("l_extendedprice").cast("double") * 1e9).alias("bytes"))
    return agg.throughput_stats(items, "l_returnflag").select("l_returnflag", "repeats", F.round("mean_gbs", 6).alias("mean_gbs"), F.round("stdev_gbs", 6).alias("stdev_gbs"))
