"""Text reports of stages, from their aggregate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Config
from ..operators import count, filter as index, group
from ..operators.filter import Indexes


def count_lines(table: DataFrame, cfg: Config, compat: bool = True) -> list[str]:
    s = count.stats(table, cfg, compat).first()
    out = [f"Table 0: {s['roots']} {s['stems']} {s['once']} {s['kmers']} {s['sum']} {s['hits_roots']} {s['hits_stems']} {s['hits_kmers']}"]
    out += [f"Histo {r['kind']}: {r['bin']} {r['low']} {r['stems']}" for r in count.histograms(table, cfg).orderBy("kind", "bin").collect()]  # at most 64 bins
    names = (("roots", "roots"), ("stems", "stems"), ("stems seen once", "once"), ("kmers", "kmers"))
    out += [f"Number of {text}: {s[key]}" for text, key in names]
    out.append(f"Sum of counters: {s['sum']}")
    return out + [f"Number of filter hits ({x}): {s[f'hits_{x}']}" for x in ("roots", "stems", "kmers")]


def size_lines(ix: Indexes) -> list[str]:
    n = {(r["index"], r["set"]): r["n"] for r in index.sizes(ix).collect()}  # six rows
    of = lambda name, *sets: " ".join(str(n.get((name, s), 0)) for s in sets)
    return [f"Size SEQ: {of('seq', 'nn', 'tn', 'tm')}", f"Size K2I: {of('k2i', 'nn', 'tn')}", f"Size I2P: {of('i2p', 'tm')}"]


def selection_lines(ix: Indexes, cfg: Config) -> list[str]:
    s = group.selection_stats(ix, cfg).first()
    names = (("iterated", "iterated"), ("existing", "existing"), ("mapped", "mapped"), ("A-matching", "match_a"), ("B-matching", "match_b"))
    return [f"Number of {text} I2P: {s[key]}" for text, key in names]


def group_lines(groups: int) -> list[str]:
    return [f"Groups 0: {groups}", f"Number of groups: {groups}"]
