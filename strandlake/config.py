"""Settings of a run: defaults, an INI loader, derived values and validation."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields, replace

#: Section and key of each setting in an INI file, and its default.
_KEYS = {
    "k": ("core.k", 30),
    "pid": ("core.pid", 0),
    "num_partitions": ("core.num-partitions", 1),
    "num_loaders": ("core.num-loaders", 1),
    "num_storers": ("core.num-storers", 1),
    "num_filters": ("core.num-filters", 1),
    "num_mergers": ("core.num-mergers", 1),
    "num_groupers": ("core.num-groupers", 1),
    "input_format": ("core.input-format", "fastq"),
    "input_normal": ("core.input-normal", ""),
    "input_tumor": ("core.input-tumor", ""),
    "check_quality": ("core.check-quality", True),
    "output": ("core.output", ""),
    "output_count": ("count.output", ""),
    "output_filter": ("filter.output", ""),
    "output_merge": ("merge.output", ""),
    "output_group": ("group.output", ""),
    "data": ("core.data", "data"),
    "exec": ("core.exec", "count:run,stats"),
    "false_positive_rate": ("prune.false-positive-rate", 0.05),
    "enable_cache": ("count.enable-cache", True),
    "conversion_mode": ("count.conversion-mode", "mem"),
    "prefilter": ("count.prefilter", True),
    "export_min": ("count.export-min", 29),
    "export_max": ("count.export-max", 31),
    "annotate_input": ("count.annotate-input", ""),
    "index_format": ("filter.index-format", "plain"),
    "num_indexes": ("filter.num-indexes", 1),
    "max_normal_a": ("filter.max-normal-count-a", 1),
    "min_tumor_a": ("filter.min-tumor-count-a", 4),
    "max_normal_b": ("filter.max-normal-count-b", 1),
    "min_tumor_b": ("filter.min-tumor-count-b", 4),
    "max_reads": ("filter.max-reads", 2000),
    "window_min": ("group.window-min", 7),
    "window_len": ("group.window-len", 10),
    "max_group_reads": ("group.max-reads", 500),
}
INPUT_FORMATS, INDEX_FORMATS, CONVERSION_MODES = ("fastq", "bam"), ("plain", "rocks"), ("mem", "stream", "slice")


@dataclass(frozen=True)
class Config:
    """Thread counts and table sizes are accepted; Spark's own settings take their place."""

    k: int = 30
    pid: int = 0
    num_partitions: int = 1
    num_loaders: int = 1
    num_storers: int = 1
    num_filters: int = 1
    num_mergers: int = 1
    num_groupers: int = 1
    input_format: str = "fastq"
    input_normal: str = ""
    input_tumor: str = ""
    check_quality: bool = True
    output: str = ""
    output_count: str = ""
    output_filter: str = ""
    output_merge: str = ""
    output_group: str = ""
    data: str = "data"
    exec: str = "count:run,stats"
    false_positive_rate: float = 0.05
    enable_cache: bool = True
    conversion_mode: str = "mem"
    prefilter: bool = True
    export_min: int = 29
    export_max: int = 31
    annotate_input: str = ""
    index_format: str = "plain"
    num_indexes: int = 1
    max_normal_a: int = 1
    min_tumor_a: int = 4
    max_normal_b: int = 1
    min_tumor_b: int = 4
    max_reads: int = 2000
    window_min: int = 7
    window_len: int = 10
    max_group_reads: int = 500

    def __post_init__(self) -> None:
        for value, allowed, what in ((self.input_format, INPUT_FORMATS, "input format"), (self.index_format, INDEX_FORMATS, "filter format"), (self.conversion_mode, CONVERSION_MODES, "conversion mode")):
            if value not in allowed:
                raise ValueError(f"Invalid {what} {value}")
        if not 3 <= self.k <= 64:
            raise ValueError(f"k must be from 3 to 64, not {self.k}")
        if self.min_tumor_a < 1:
            raise ValueError("min-tumor-count-a must be 1 at least: k-mers that were never seen can't be candidates")
        if not 0 <= self.pid < self.num_partitions:
            raise ValueError(f"Partition {self.pid} of {self.num_partitions} does not exist")

    @property
    def stem_len(self) -> int:
        return self.k - 2

    def path(self, stage: str) -> str:
        """Output folder of a stage, the common one unless it has its own."""
        return getattr(self, f"output_{stage}") or self.output

    def with_output(self, path: str) -> Config:
        """One folder for all stages, whatever they had."""
        return replace(self, output=path, output_count="", output_filter="", output_merge="", output_group="")


def load(path: str, **overrides) -> Config:
    parser = configparser.ConfigParser(interpolation=None, comment_prefixes=(";", "#"), inline_comment_prefixes=None)
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    values = {}
    kinds = {f.name: type(f.default) for f in fields(Config)}
    for name, (key, default) in _KEYS.items():
        section, _, option = key.partition(".")
        if not parser.has_option(section, option):
            values[name] = default
        elif kinds[name] is bool:
            values[name] = parser.getboolean(section, option)
        else:
            values[name] = kinds[name](parser.get(section, option))
    return Config(**(values | overrides))
