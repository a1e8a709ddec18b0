import duckdb
import pytest
from test_sources import as_fastq
from test_stages import random_reads

import __spark_entry__ as entry
from strandlake.config import Config
from strandlake.plans import runner

SF = "/root/testdata/sf0.001"


def test_commands():
    assert runner.parse("count:run,stats;filter:run") == [("count", ["run", "stats"]), ("filter", ["run"])]
    assert runner.parse("count:run;count:stats") == [("count", ["stats"]), ("count", ["stats"])]
    assert runner.parse("") == []


def test_needs():
    assert runner.unmet(runner.parse("count:run,stats;filter:run,dump;merge:run;group_rocks:run,stats")) == []
    assert runner.unmet(runner.parse("count:restore,export;merge:run")) == [("merge:run", "filter:dump")]
    assert runner.unmet(runner.parse("group:stats")) == [("group:stats", "group:run")]


def test_arguments(tmp_path):
    f = tmp_path / "c.conf"
    f.write_text("[core]\nk = 20\nnum-partitions = 2\n[count]\noutput = /c\n")
    cfg = runner.arguments(["-c", str(f), "--pid", "1", "-o", "/o", "-x", "count:run", "--input-normal", "n", "-l", "3"])
    assert (cfg.k, cfg.pid, cfg.path("count"), cfg.exec, cfg.input_normal, cfg.num_loaders) == (20, 1, "/o", "count:run", "n", 3)
    with pytest.raises(ValueError):
        runner.arguments(["-c", str(f), "--pid", "2"])


def reports(said):
    return [x for x in said if x.startswith(("Size", "Number", "Table", "Histo", "Sum", "Groups"))]


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    data = random_reads(21, 80, 8)
    for kind, name in ((0, "n"), (1, "t")):
        (at / f"{name}.fq").write_bytes(as_fastq([(i, s, q) for i, k, s, q in data if k == kind]))
    return at


def run(spark, cfg, text):
    said = []
    runner.Run(spark, cfg, say=said.append).execute(text)
    return said


def test_all_stages_and_partitions(spark, inputs, tmp_path):
    base = dict(k=8, min_tumor_a=2, min_tumor_b=1, max_normal_a=3, max_normal_b=3, window_min=2, window_len=4, input_normal=str(inputs / "n.fq"), input_tumor=str(inputs / "t.fq"), annotate_input=str(inputs / "t.fq"), export_min=0, export_max=9)
    one = run(spark, Config(output=str(tmp_path / "one"), **base), "prune:run;count:run,dump,stats,export,annotate,oops;filter:run,dump,stats;merge:run,stats,to_fastq;group:run,stats;group_sequential:run,stats;group_rocks:run,dump,stats;nobody:run")
    assert "Skip unknown stage: nobody" in one and "Skip unknown command: count/oops" in one
    sizes = [x for x in one if x.startswith("Size")]
    assert sizes[:3] == sizes[3:6] and len(sizes) == 6
    two = str(tmp_path / "two")
    for pid in (0, 1):
        run(spark, Config(output=two, num_partitions=2, pid=pid, **base), "count:run;filter:run,dump")
    merged = run(spark, Config(output=two, num_partitions=2, **base), "merge:run,stats;group:run,stats")
    assert [x for x in merged if x.startswith("Size")] == sizes[:3]
    # Each process forms the groups of its own leaders; together they are those of one run.
    other = run(spark, Config(output=two, num_partitions=2, pid=1, **base), "group:run,stats")
    count = lambda said: int([x for x in said if x.startswith("Number of groups")][0].split()[-1])
    assert count(merged) + count(other) == count(one)
    ids = lambda path: sorted(r.id for r in spark.read.json(path).select("lead.id").collect()) if count(one) else []
    assert ids(f"{two}/group.*.json") == ids(f"{tmp_path}/one/group.0.json")
    again = run(spark, Config(output=str(tmp_path / "one"), **base), "count:restore,stats;filter:run,stats")
    assert [x for x in again if x.startswith("Size")] == sizes[:3]
    typed = str(tmp_path / "one")
    said = run(spark, Config(output=typed, **base), "merge:run_seq_nn,run_k2i_tn,run_i2p_tm,run_k2i_tm,stats")
    assert "Skip unknown command: merge/run_k2i_tm" in said and [x for x in said if x.startswith("Size")] == sizes[:3]
    for name in ("export.0.csv", "annotate.0.json", "merge-nn.fastq", "group.0.json", "sets.0.txt", "group.0.msgpack", "index-k2i-tn.0.txt"):
        assert (tmp_path / "one" / name).exists(), name


def test_steps_need_their_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        runner.Run(spark, Config(output=str(tmp_path)), say=lambda _: None).execute("count:stats")


def test_streaming_counts(spark, rows, tmp_path):
    from strandlake.operators import kmers
    from strandlake.streaming import kmers as streaming

    cfg = Config(k=6)
    data = random_reads(4, 60)
    folder = str(tmp_path / "in")
    for part in (data[:20], data[20:45], data[45:]):
        rows(part, streaming.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    q = streaming.growing_counts(streaming.arriving(spark, folder, 1), cfg).writeStream.format("memory").queryName("growing").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    q.stop()
    whole = streaming.growing_counts(rows(data, streaming.SCHEMA), cfg)
    pick = lambda df: sorted(map(tuple, df.collect()))
    assert pick(spark.table("growing")) == pick(whole) and kmers.kmers(rows(data, streaming.SCHEMA), 6).count() > 0


CORE = [n for n in entry.core_queries.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values.tolist())) == sorted(map(tuple, want[columns].astype(str).values.tolist()))


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_plans(spark):
    """Columns are pruned at the scan, candidates take one exchange and totals of roots a second."""
    plan = lambda name: entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name, exchanges in (("candidate_kmers", 1), ("kmer_counts", 2), ("prefiltered_roots", 2), ("stem_counts", 2), ("count_stats", 2)):
        text = plan(name)
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and text.count("Exchange hashpartitioning") == exchanges, name
        assert "Python" not in text and "Arrow" not in text
