"""FASTQ and FASTA sources, sample storage."""

import gzip
import random

import numpy as np

from strandframe.sources import fasta, fastq
from strandframe.sources import tables as T
from strandframe.sources.fasta import read_fasta, sequence_text
from strandframe.sources.fastq import read_fastq
from strandframe.sources.files import Range


def records(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        m = rng.randrange(1, 40)
        # qualities that look like headers and separators
        qual = rng.choice("@+I") + "".join(rng.choice("@+!I") for _ in range(m - 1))
        out.append((f"@r{i}/{1 + i % 2}", "".join(rng.choice("ACGTN") for _ in range(m)), qual))
    return out


def text(rows, end="\n"):
    return "".join(f"{i}{end}{s}{end}+{end}{q}{end}" for i, s, q in rows)


def test_fastq_ranges_find_every_record_once(spark, tmp_path):
    rows = records(300)
    folder = tmp_path / "sample_a"
    folder.mkdir()
    (folder / "x.fq").write_text(text(rows))
    for size in (7, 64, 1000, 1 << 20):
        got = read_fastq(spark, str(folder), split_bytes=size).collect()
        assert sorted((r.read_id, r.read) for r in got) == sorted(r[:2] for r in rows)
        assert {r.sample_id for r in got} == {"sample_a"} and {r.pair for r in got} == {"1", "2"}


def test_fastq_gzip_members_and_cut_tail(spark, tmp_path):
    rows = records(50)
    joined = gzip.compress(text(rows[:20]).encode()) + gzip.compress(text(rows[20:], "\r\n").encode())
    (tmp_path / "a.fq.gz").write_bytes(joined)
    (tmp_path / "notes.txt").write_text("ignored")
    (tmp_path / "b.fastq").write_text("@cut/2\nACGT\n")
    got = read_fastq(spark, str(tmp_path), sample_id="s", num_partitions=3)
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r.read_id, r.read) for r in got.collect()) == sorted([r[:2] for r in rows] + [("@cut/2", "ACGT")])
    assert read_fastq(spark, f"file://{tmp_path}", limit=7).count() == 7


def test_fasta_ranges(spark, tmp_path):
    rng = random.Random(1)
    want, lines = [], []
    for i in range(40):
        lines.append(f">rec{i} some words")
        for n in range(rng.randrange(0, 5)):
            seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 30)))
            want.append((f"rec{i}", n, seq))
            lines += [seq, ""] if rng.random() < 0.2 else [seq]
    (tmp_path / "g.fna").write_text("\n".join(lines) + "\n")
    for size in (16, 333, 1 << 20):
        got = read_fasta(spark, str(tmp_path), split_bytes=size).collect()
        assert sorted((r.record_id, r.line_no, r.sequence) for r in got) == sorted(want)
        assert {r.fasta for r in got} == {"g.fna"}
    assert sorted(r.sequence for r in sequence_text(spark, str(tmp_path)).collect()) == sorted(w[2] for w in want)


def test_samples_are_skipped_or_replaced(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = lambda v, *s: spark.createDataFrame([(x, v) for x in s], "sample_id string, v int")
    T.write_samples(rows(1, "a", "b"), path)
    T.write_samples(rows(2, "b", "c"), path)
    state = lambda: {r.sample_id: r.v for r in T.read_sample(spark, path).collect()}
    assert state() == {"a": 1, "b": 1, "c": 2}
    T.write_samples(rows(3, "b"), path, overwrite=True)
    assert state() == {"a": 1, "b": 3, "c": 2}
    assert T.read_sample(spark, path, "c").count() == 1


def test_single_csv(spark, tmp_path):
    df = spark.range(10).repartition(4)
    T.write_single_csv(df, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    T.write_single_csv(df, str(tmp_path / "many"), single=False)
    back = spark.read.csv(str(tmp_path / "many"), header=True, schema="id bigint")
    assert sorted(r.id for r in back.collect()) == list(range(10))


def test_run_table(spark, tmp_path):
    (tmp_path / "runs.tsv").write_text("study\tsample\turl\nx\ts1\ta;b\ny\ts2\tc\n")
    got = T.read_run_table(spark, str(tmp_path / "runs.tsv"), 1, 2).orderBy("url").collect()
    assert [tuple(r) for r in got] == [("s1", "a"), ("s1", "b"), ("s2", "c")]


def test_embeddings_drop_and_renumber(spark, tmp_path):
    v = spark.createDataFrame([("</s>", 0, [1.0, float("nan")]), ("AAA", 1, [2.0, None]), ("CCC", 2, [3.0, None])], "kmer string, id int, vector array<double>")
    T.save_embeddings(v, str(tmp_path / "v"))
    got = T.load_embeddings(spark, str(tmp_path / "v"), ["</s>"]).orderBy("id").collect()
    assert [(r.kmer, r.id, r.vector) for r in got] == [("AAA", 0, [2.0]), ("CCC", 1, [3.0])]
    assert T.vocab_lines(spark.createDataFrame([("AC", 3)], "kmer string, count bigint")).first()[0] == "AC 3"


def test_a_long_record_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(9)
    seq = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    # lines before any header, a record over ten ranges and more, an empty one, one of a single line
    parts = [(None, [seq(20)] * 7), ("long", [seq(17) for _ in range(400)]), ("empty", []), ("b", [seq(3)]), ("", [seq(5)] * 2), ("c", [seq(30)] * 40)]
    text = "".join((f">{r} of\tsome kind\r\n" if r is not None else "") + "".join(x + "\n" for x in lines) for r, lines in parts)
    (tmp_path / "g.fasta").write_text(text.rstrip("\n"))
    (tmp_path / "h.fna").write_text(">only\nAC\n\nGT\n")
    want = [("g.fasta", r, i, x) for r, lines in parts for i, x in enumerate(lines)] + [("h.fna", "only", 0, "AC"), ("h.fna", "only", 1, "GT")]
    for size in (64, 701, 1 << 20):
        got = read_fasta(spark, str(tmp_path), split_bytes=size)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    raw = spark.read.format("fasta").options(splitBytes=701, glob="*.fasta").load(str(tmp_path))
    assert raw.filter("start > 0 AND record_id IS NULL").select("start").distinct().count() >= 10


def test_blocks_of_any_size_give_the_same_records(tmp_path):
    rows = records(120, 3)
    path = tmp_path / "x.fastq"
    path.write_text(text(rows, "\r\n") + "@cut\nAC\n+")
    want = [r[0] for r in rows] + ["@cut"]
    for split in (50, 777, 1 << 20):
        size = path.stat().st_size
        for block in (3, 64, 1 << 20):
            got = []
            for start in range(0, size, split):
                for lines, first, number, whole in fastq.records(Range(str(path), start, min(start + split, size)), block):
                    got += lines.text(first + 4 * np.arange(number)).to_pylist()
            assert got == want
    state = fasta.State()
    (tmp_path / "f.fna").write_text(">a\nAC\nGT\n>b x\n\nT")
    got = []
    for part in fasta.sequence_lines(Range(str(tmp_path / "f.fna"), 0, 1000), state, 2):
        got += zip(*(x.to_pylist() for x in part))
    assert got == [("a", 0, "AC"), ("a", 1, "GT"), ("b", 0, "T")] and (state.record, state.number) == ("b", 1)


def test_short_ranges_read_little_and_share_tasks(tmp_path):
    from strandframe.sources import files
    from strandframe.sources.fastq import FastqReader

    text = "".join(f"@r{i}/1\nACGT{'ACGT' * (i % 9)}\n+\n@+@+{'IIII' * (i % 9)}\n" for i in range(4000))
    (tmp_path / "x.fq").write_text(text)
    reader = FastqReader({"path": str(tmp_path), "splitbytes": "64"}, False)
    parts = files.ranges(str(tmp_path), ["*.fq"], 64)
    assert len(next(files.blocks(parts[3]))) < 64 + 2 * files.BEYOND
    dealt = reader.partitions()
    assert len(dealt) <= 2 * files.MOST_TASKS < len(parts) and [p for t in dealt for p in t.parts] == parts
    ids = [r for t in dealt for batch in reader.read(t) for r in batch["read_id"].to_pylist()]
    assert ids == [f"@r{i}/1" for i in range(4000)]
    # long ranges and whole files keep a task each
    many = [files.Range("x", i * files.SPLIT_BYTES, (i + 1) * files.SPLIT_BYTES) for i in range(3000)]
    assert len(files.tasks(many)) == len(files.tasks([files.Range("x.gz", 0, None)] * 3000)) == 3000
