import gzip

import pytest

from methylake.sources import readers, sinks

COV = """chr1 1000 1001 30.0 30 70
chr1 2000 2001 35.0 35 65
chr1 3000 3001 28.0 14 36
chr1 5000 5001 60.0 30 20
chr1 8000 8001 75.0 45 15
chr2 500 501 50.0 25 25
chr2 1500 1501 20.0 4 16
chr2 4000 4001 80.0 32 8
chr3 100 101 5.0 1 19
chr3 9999 10000 90.0 9 1
""".replace(" ", "\t")


@pytest.fixture
def files(tmp_path):
    (tmp_path / "s1.bismark.cov").write_text(COV)
    (tmp_path / "s2.bismark.cov").write_text(COV)
    with gzip.open(tmp_path / "z.cov.gz", "wt") as f:
        f.write("".join(COV.splitlines(True)[:2]))
    (tmp_path / "sheet.csv").write_text(f"sample_id,path,group,batch\nctrl_1,{tmp_path}/s1.bismark.cov,control,A\ntreat_1,{tmp_path}/s2.bismark.cov,treatment,B\n")
    return tmp_path


def test_bismark(spark, files):
    read = lambda **k: readers.read_bismark_coverage(spark, str(files / "s1.bismark.cov"), **k)
    assert read().count() == 10
    assert read(min_coverage=30).count() == 7
    assert read(max_coverage=50).count() == 7
    assert [r.start for r in read(regions=[("chr1", 0, 3000)]).orderBy("start").collect()] == [1000, 2000]
    assert read(regions=[("chr1", 0, 10_000), ("chr1", 5, 6)]).count() == 5  # overlapping regions are merged
    assert read(regions=spark.createDataFrame([], "chr string, start long, end long")).count() == 0
    assert readers.read_bismark_coverage(spark, str(files / "z.cov.gz")).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_bismark_coverage(spark, str(files / "no.cov"))


def test_cx(spark, tmp_path):
    p = tmp_path / "a.CX_report.txt"
    p.write_text("chr1\t10\t+\t5\t5\tCpG\tAAA\nchr1\t20\t-\t0\t0\tCpG\tAAA\nchr1\t30\t-\t1\t0\tCHG\tAAA\n")
    (r,) = readers.read_bismark_cx_report(spark, str(p)).collect()
    assert (r.start, r.end, r.beta, r.coverage) == (9, 10, 50.0, 10)
    assert readers.read_bismark_cx_report(spark, str(p), context=None).count() == 2


def test_bedgraph(spark, tmp_path):
    p = tmp_path / "a.bedgraph"
    p.write_text("chr1\t1\t2\t0.5\nchr1\t2\t3\t1.0\nchr1\t3\t4\t37.0\nchr1\t4\t5\t0.0\n")
    assert [r.beta for r in readers.read_bedgraph(spark, str(p)).orderBy("start").collect()] == [50.0, 100.0, 37.0, 0.0]
    assert [r.beta for r in readers.read_bedgraph(spark, str(p), beta_scale="percent").orderBy("start").collect()] == [0.5, 1.0, 37.0, 0.0]


def test_generic(spark, tmp_path):
    p = tmp_path / "g.tsv"
    p.write_text("#note\nseq\tpos\tstop\tmeth\tdepth\textra\nchr1\t5\t6\t3\t12\tx\nchr1\t7\t8\t0\t0\ty\n")
    df = readers.read_generic_methylation(spark, str(p), chr_col="seq", start_col="pos", end_col="stop", beta_col=None, methylated_col="meth", coverage_col="depth", min_coverage=0)
    assert df.columns == ["chr", "start", "end", "strand", "beta", "methylated", "unmethylated", "coverage", "context", "extra"]
    a, b = df.orderBy("start").collect()
    assert (a.beta, a.unmethylated, a.strand, a.context) == (25.0, 9, "*", "CpG")
    assert b.beta is None
    with pytest.raises(ValueError):
        readers.read_generic_methylation(spark, str(p))


@pytest.mark.parametrize(("name", "fmt"), [("x.cov", "bismark"), ("x.bismark.cov.gz", "bismark"), ("a.CX_report.txt", "cx"), ("a.bdg", "bedgraph"), ("a.tsv", "generic")])
def test_detect(name, fmt):
    assert readers.detect_format(f"/d/{name}") == fmt


def test_samples_round_trip(spark, files):
    m = readers.read_samples(spark, str(files / "sheet.csv"))
    assert (m.n_samples, m.n_sites, m.calls.count()) == (2, 10, 20)
    assert {"group", "batch"} <= set(m.samples.columns)
    out = str(files / "store")
    m2 = readers.read_samples(spark, str(files / "sheet.csv"), output="parquet", out_path=out, validate_output=True)
    assert sorted(map(tuple, m2.calls.select("sample_id", "chr", "start", "coverage").collect())) == sorted(map(tuple, m.calls.select("sample_id", "chr", "start", "coverage").collect()))
    assert len(m2) == 2
    with pytest.raises(ValueError):
        readers.read_samples(spark, str(files / "sheet.csv"), output="parquet")
    with pytest.raises(ValueError):
        sinks.save(m, out, "h5ad")
    (files / "bad.csv").write_text("sample_id,group\na,b\n")
    with pytest.raises(ValueError):
        readers.read_samples(spark, str(files / "bad.csv"))


def test_build_cohort(spark):
    schema = "chr string, start bigint, end bigint, strand string, context string, methylated bigint, unmethylated bigint, coverage bigint, beta double"
    a = spark.createDataFrame([("chr1", 1, 9, "+", "CpG", 1, 1, 2, 50.0), ("chr1", 1, 9, "+", "CpG", 3, 1, 4, 75.0), ("chr1", 5, 6, "+", "CpG", 1, 0, 1, 100.0)], schema)
    b = spark.createDataFrame([("chr1", 1, 2, "-", "CpG", 0, 4, 4, 0.0)], schema)
    m = readers.build_cohort(spark, ["a", "b"], [a, b])
    got = {(r.sample_id, r.start): (r.end, r.methylated, r.coverage) for r in m.calls.collect()}
    assert got == {("a", 1): (2, 4, 6), ("a", 5): (6, 1, 1), ("b", 1): (2, 0, 4)}
    assert {(r.start, r.strand) for r in m.sites.collect()} == {(1, "*"), (5, "+")}
    assert [r.start for r in readers.build_cohort(spark, ["a", "b"], [a, b], join_type="inner").sites.collect()] == [1]
    for bad in (([], []), (["a"], [a, b])):
        with pytest.raises(ValueError):
            readers.build_cohort(spark, *bad)
    with pytest.raises(ValueError):
        readers.build_cohort(spark, ["a"], [a], join_type="cross")


def test_bed_and_stream(spark, tmp_path):
    from methylake.streaming import ingest

    d = spark.createDataFrame([("chr1", 5, 9, -250.0, "hypo")], "chr string, start long, end long, mean_diff double, direction string")
    sinks.dmrs_to_bed(d, str(tmp_path / "o.bed"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "o.bed"), sep="\t").collect()] == [("chr1", "5", "9", "hypo", "1000", ".")]
    src = tmp_path / "in"
    src.mkdir()
    (src / "s1.cov").write_text(COV)
    q = ingest.append(ingest.call_stream(spark, str(src), min_coverage=30), str(tmp_path / "st"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "st/calls"))
    assert got.count() == 7 and {r.sample_id for r in got.collect()} == {"s1"}


def test_store_validation_and_streaming_entry(spark, tmp_path):
    from dataclasses import replace

    from pyspark.sql import functions as F

    lines = ["chr2\t5\t6\t50.0\t5\t5", "chr1\t9\t10\t20.0\t2\t8", "chr10\t1\t2\t10.0\t1\t9"]
    for s in "ab":
        (tmp_path / f"{s}.cov").write_text("\n".join(lines if s == "a" else lines[:2]) + "\n")
    (tmp_path / "sheet.csv").write_text("sample_id,path,group\n" + "".join(f"{s},{tmp_path}/{s}.cov,g{s}\n" for s in "ab"))
    m = readers.read_samples_streaming(spark, str(tmp_path / "sheet.csv"), min_coverage=5)
    assert {(r.chr, r.start): r.locus_id for r in m.sites.collect()} == {("chr1", 9): 0, ("chr2", 5): 1, ("chr10", 1): 2}
    assert [r["group"] for r in m.samples.orderBy("sample_id").collect()] == ["ga", "gb"]
    sinks.validate(m)
    for bad, what in ((replace(m, sites=m.sites.where("chr <> 'chr1'")), "without a site"), (replace(m, samples=m.samples.where("sample_id = 'a'")), "without a sample"), (replace(m, calls=m.calls.unionAll(m.calls)), "repeated"), (replace(m, calls=m.calls.withColumn("coverage", F.col("coverage") + 1)), "add up")):
        with pytest.raises(RuntimeError, match=what):
            sinks.validate(bad)
    assert readers.build_cohort_chunked is readers.build_cohort
