"""The command language ``stage:step,step;stage:step`` and the command line.

Stages hand tables to the next through the run.  Steps a stage doesn't know, and stages
that nobody knows, are skipped with a message.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, load
from ..operators import count, filter as index, group, kmers, merge, prune
from ..operators.filter import Indexes
from ..sources import fastq, tables
from . import report

#: Which step needs which, within and across stages.
NEEDS = {
    "count:dump": ("count:run",), "count:stats": ("count:run",), "count:export": ("count:run",), "count:annotate": ("count:run",),
    "filter:run": ("count:run",), "filter:dump": ("filter:run",), "filter:stats": ("filter:run",), "merge:run": ("filter:dump",), "merge:stats": ("merge:run",),
    "merge:to_fastq": ("merge:run",), "group:run": ("merge:run",), "group:stats": ("group:run",),
}


def parse(text: str) -> list[tuple[str, list[str]]]:
    """Stages in order; a stage that is named twice has the steps of its last mention both times."""
    order, steps = [], {}
    for command in filter(None, (x.strip() for x in text.split(";"))):
        name, _, rest = command.partition(":")
        order.append(name)
        steps[name] = [x.strip() for x in rest.split(",") if x.strip()]
    return [(name, steps[name]) for name in order]


def unmet(plan: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """(step, need) of steps that rely on an earlier run, as nothing before them in this one gives it."""
    done: set[str] = set()
    out = []
    for stage, steps in plan:
        for name in steps:
            step = f"{stage.removesuffix('_sequential').removesuffix('_rocks')}:{name}"
            out += [(f"{stage}:{name}", need) for need in NEEDS.get(step, ()) if need not in done]
            done.add(step)
            if step == "count:restore":
                done.add("count:run")
    return out


class Run:
    """What the stages of a run share."""

    def __init__(self, spark: SparkSession, cfg: Config, reads: DataFrame | None = None, say: Callable[[str], None] = print):
        self.spark, self.cfg, self.say, self.given = spark, cfg, say, reads
        self.roots: DataFrame | None = None
        self.table: DataFrame | None = None
        self.ix: Indexes | None = None
        self.merged: Indexes | None = None
        self.groups: DataFrame | None = None

    def reads(self) -> DataFrame:
        raw = self.given
        if raw is None:
            # As many loaders as the command line names share a BAM file that has an index.
            options = {"splits": self.cfg.num_loaders} if self.cfg.input_format == "bam" else {}
            raw = fastq.reads(self.spark, self.cfg.input_normal, self.cfg.input_tumor, self.cfg.input_format, **options)
        return kmers.quality_filtered(raw, self.cfg.check_quality)

    def own(self, df: DataFrame, column: str = "root") -> DataFrame:
        """This process's share, where a run is dealt to several."""
        if self.cfg.num_partitions == 1:
            return df
        return df.filter(merge.partition_of(column, self.cfg.num_partitions) == self.cfg.pid)

    def need_table(self) -> DataFrame:
        if self.table is None:
            raise ValueError("there are no counts: run or restore count first")
        return self.table

    def need_indexes(self) -> Indexes:
        ix = self.merged or self.ix
        if ix is None:
            folder = f"{self.cfg.path('merge')}/merge"
            ix = self.merged = tables.restore_indexes(self.spark, folder)
        return ix

    # prune

    def prune_run(self) -> None:
        self.roots = prune.repeated_roots(self.reads(), self.cfg.k).select("root").persist()

    # count

    def count_run(self) -> None:
        table = self.own(count.root_table(self.reads(), self.cfg, roots=self.roots))
        if self.cfg.prefilter:
            table = count.prefiltered(table, self.cfg)
        self.table = table.persist()
        if self.roots is not None:
            self.table.count()  # the set is no longer needed behind it
            self.roots.unpersist()
            self.roots = None

    def count_dump(self) -> None:
        tables.dump(self.need_table(), f"{self.cfg.path('count')}/count.{self.cfg.pid}")

    def count_restore(self) -> None:
        self.table = tables.restore(self.spark, f"{self.cfg.path('count')}/count.{self.cfg.pid}")

    def count_stats(self) -> None:
        self.lines(report.count_lines(self.need_table(), self.cfg))

    def count_export(self) -> None:
        tables.write_counts_csv(count.export_range(self.need_table(), self.cfg), f"{self.cfg.path('count')}/export.{self.cfg.pid}.csv")

    def count_annotate(self) -> None:
        raw = fastq.fastq(self.spark, self.cfg.annotate_input).selectExpr("id", "seq", "qual", "0 kind")
        reads = kmers.quality_filtered(raw, check=False)
        rows = tables.annotation(reads, lambda df, keep: count.annotated(df, self.need_table(), self.cfg, keep))
        tables.write_annotation(rows, f"{self.cfg.path('count')}/annotate.{self.cfg.pid}.json")

    # filter

    def filter_run(self) -> None:
        found = count.candidates(self.need_table(), self.cfg).select("root", "kmer")
        self.ix = index.indexes(self.reads(), found, self.cfg, keep=lambda df: df.persist())

    def filter_dump(self) -> None:
        ix = self.ix or self.need_indexes()
        folder = self.cfg.path("filter")
        tables.dump_indexes(Indexes(ix.seq, index.capped_rows(ix.k2i, self.cfg.max_reads), ix.i2p), f"{folder}/filter.{self.cfg.pid}")
        if self.cfg.index_format == "plain":
            tables.write_plain(ix, folder, self.cfg.max_reads, self.cfg.pid)

    def filter_stats(self) -> None:
        self.lines(report.size_lines(self.ix or self.need_indexes()))

    # merge

    def _parts(self) -> list[Indexes]:
        return [tables.restore_indexes(self.spark, f"{self.cfg.path('filter')}/filter.{p}") for p in range(self.cfg.num_partitions)]

    def _merge(self, kinds: dict[str, tuple[str, ...]]) -> None:
        parts, folder = self._parts(), f"{self.cfg.path('merge')}/merge"
        for kind, sets in kinds.items():
            made = {"seq": lambda: merge.merged_seq([p.seq for p in parts]), "k2i": lambda: merge.merged_k2i([p.k2i for p in parts], self.cfg.max_reads), "i2p": lambda: merge.merged_i2p([p.i2p for p in parts])}[kind]()
            if kind == "i2p":
                tables.dump(made, f"{folder}/i2p")
                continue
            for s in sets:
                tables.dump(made.filter(made["set"] == s).drop("set"), f"{folder}/{kind}/set={s}")

    def merge_run(self) -> None:
        self._merge(tables.VALID)
        self.merged = tables.restore_indexes(self.spark, f"{self.cfg.path('merge')}/merge")

    def merge_stats(self) -> None:
        self.lines(report.size_lines(self.need_indexes()))

    def merge_to_fastq(self) -> None:
        for s in ("nn", "tn"):
            tables.write_fastq(merge.fastq(self.need_indexes().seq, s), f"{self.cfg.path('merge')}/merge-{s}.fastq")

    # group, in its three forms

    def _group(self, last: int | None, per_entry: bool) -> None:
        ix = self.need_indexes()
        self.lines(report.selection_lines(ix, self.cfg))
        self.groups = group.groups(ix, self.cfg, last, per_entry).persist()

    def group_run(self) -> None:
        self._group(50, False)
        tables.write_groups_json(self.groups, f"{self.cfg.path('group')}/group.{self.cfg.pid}.json")

    def group_sequential_run(self) -> None:
        self._group(None, False)
        tables.write_groups_json(self.groups, f"{self.cfg.path('group')}/group.{self.cfg.pid}.json")

    def group_rocks_run(self) -> None:
        self._group(None, True)

    def group_rocks_dump(self) -> None:
        folder = self.cfg.path("group")
        tables.dump(self.groups, f"{folder}/group.{self.cfg.pid}.parquet")
        tables.dump(tables.packed_groups(self.groups), f"{folder}/group.{self.cfg.pid}.msgpack")
        tables.write_sets(group.sets(self.need_indexes(), self.cfg), f"{folder}/sets.{self.cfg.pid}.txt")

    def group_stats(self) -> None:
        self.lines(report.group_lines(self.groups.count() if self.groups is not None else 0))

    group_sequential_stats = group_rocks_stats = group_stats

    # running

    def lines(self, lines: list[str]) -> None:
        for x in lines:
            self.say(x)

    def step(self, stage: str, name: str) -> Callable[[], None] | None:
        if stage == "merge" and name.startswith("run_"):
            _, kind, s = (name.split("_") + [""])[:3]
            return (lambda: self._merge({kind: (s,)})) if s in tables.VALID.get(kind, ()) else None
        found = STEPS.get(stage, {}).get(name)
        return found and (lambda: found(self))

    def execute(self, text: str | None = None) -> None:
        plan = parse(self.cfg.exec if text is None else text)
        known = []
        for stage, steps in plan:
            if stage in STEPS:
                self.say(f"Initialize: {stage}")
                known.append((stage, steps))
            else:
                self.say(f"Skip unknown stage: {stage}")
        for step, need in unmet(known):
            self.say(f"{step} takes {need} from an earlier run")
        for stage, steps in known:
            for name in steps:
                step = self.step(stage, name)
                if step is None:
                    self.say(f"Skip unknown command: {stage}/{name}")
                    continue
                self.say(f"Execute: {stage}/{name}")
                began = time.time()
                step()
                self.say(f"Time {stage}/{name}: {time.time() - began:g}")


STEPS: dict[str, dict[str, Callable[[Run], None]]] = {
    "prune": {"run": Run.prune_run},
    "count": {"run": Run.count_run, "dump": Run.count_dump, "restore": Run.count_restore, "stats": Run.count_stats, "export": Run.count_export, "annotate": Run.count_annotate},
    "filter": {"run": Run.filter_run, "dump": Run.filter_dump, "stats": Run.filter_stats},
    "merge": {"run": Run.merge_run, "stats": Run.merge_stats, "to_fastq": Run.merge_to_fastq},
    "group": {"run": Run.group_run, "stats": Run.group_stats},
    "group_sequential": {"run": Run.group_sequential_run, "stats": Run.group_sequential_stats},
    "group_rocks": {"run": Run.group_rocks_run, "dump": Run.group_rocks_dump, "stats": Run.group_rocks_stats},
}


def arguments(args: list[str] | None = None) -> Config:
    p = argparse.ArgumentParser(prog="strandlake", description="Differential k-mer analytics on Spark")
    p.add_argument("-c", "--config", required=True)
    numbers = {"num_partitions": ("-p", "--partitions"), "pid": ("--pid",), "num_loaders": ("-l", "--loaders"), "num_storers": ("-s", "--storers"), "num_filters": ("-f", "--filters"), "num_mergers": ("-m", "--mergers"), "num_groupers": ("-g", "--groupers")}
    for name, flags in numbers.items():
        p.add_argument(*flags, dest=name, type=int)
    p.add_argument("--input-normal")
    p.add_argument("--input-tumor")
    p.add_argument("-o", "--output")
    p.add_argument("-x", "--exec")
    p.add_argument("-v", "--version", action="version", version="strandlake 0.1")
    got = vars(p.parse_args(args))
    cfg = load(got.pop("config"), **{k: v for k, v in got.items() if v is not None and k in numbers})
    cfg = replace(cfg, **{k: got[k] for k in ("input_normal", "input_tumor", "exec") if got[k] is not None})
    return cfg.with_output(got["output"]) if got["output"] is not None else cfg


def main(args: list[str] | None = None) -> int:
    cfg = arguments(args)
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    Run(spark, cfg).execute()
    return 0
