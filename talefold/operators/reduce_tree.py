"""Merging items by a reducer of the user's own, over groups of bounded size, level by level.

A reducer gets the rows of one group (unit, field, pos, text, source_segment_ids, in order of unit
and pos) as a pandas frame and returns field, text, source_segment_ids in the order of its
result. A recording whose items fit `direct` is merged at once; else its units are
packed in order into groups of at most `limit`, each group is one call, and results are
the units of the next level, until what is left fits. No call sees more than a group,
or two neighbouring units where each alone is over half the limit. Each level's results
are written before they are used, so a reducer that calls a model is called once a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import pack_groups
from .kept import kept
from .reduce import CAPS, NO_ID

Reducer = Callable[[pd.DataFrame], pd.DataFrame]
REDUCED = "recording_id long, unit int, field string, pos int, text string, source_segment_ids array<int>"
REDUCED_COLUMNS = [x.split()[0] for x in REDUCED.split(", ")]


def union_reducer(caps: dict[str, int] | None = CAPS) -> Reducer:
    """A stand-in for a model: items that agree in all but case and blanks are united, as `union_items` does."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        met: dict[tuple[str, str], tuple[str, set]] = {}
        for field, text, ids in zip(rows["field"], rows["text"], rows["source_segment_ids"], strict=True):
            key = " ".join((text or "").split()).lower()
            if key:
                met.setdefault((field, key), (text, set()))[1].update(int(i) for i in (ids if ids is not None else ()))
        out = sorted((field, min(ids, default=NO_ID), text, sorted(ids)) for (field, _), (text, ids) in met.items())
        kept_, seen = [], dict.fromkeys({f for f, *_ in out}, 0)
        for field, _, text, ids in out:
            seen[field] += 1
            if caps is None or seen[field] <= caps.get(field, seen[field]):
                kept_.append((field, text, ids))
        return pd.DataFrame(kept_, columns=["field", "text", "source_segment_ids"])

    return run


def _reduced(units: DataFrame, reducer: Reducer) -> DataFrame:
    """One call per recording and group of units(..., group_no).

    Groups stream through sorted partitions, many in a batch: a batch of its own for
    each takes longer than the call. The number of partitions is given, as few bytes may be many calls.
    """
    by, given = ["recording_id", "group_no"], ["unit", "field", "pos", "text", "source_segment_ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts, out = None, [], {c: [] for c in REDUCED_COLUMNS}

        def call() -> None:
            told = reducer(parts[0].reset_index(drop=True) if len(parts) == 1 else pd.concat(parts, ignore_index=True))
            for c in ("field", "text", "source_segment_ids"):
                out[c] += told[c].tolist()
            for c, values in (("recording_id", [key[0]] * len(told)), ("unit", [key[1]] * len(told)), ("pos", range(len(told)))):
                out[c] += values

        for batch in batches:
            keys, rows = list(zip(*(batch[c].tolist() for c in by), strict=True)), batch[given]
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in itertools.pairwise(starts):
                if a == b:  # an empty batch
                    continue
                if parts and keys[a] != key:
                    call()
                    parts = []
                key = keys[a]
                parts.append(rows.iloc[a:b])
            if out["pos"]:
                yield pd.DataFrame(out)
                out = {c: [] for c in REDUCED_COLUMNS}
        if parts:
            call()
        if out["pos"]:
            yield pd.DataFrame(out)

    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, F.asc_nulls_last("unit"), F.asc_nulls_last("pos")]
    return kept(units.select(*by, *given).repartition(tasks, *by).sortWithinPartitions(*order).mapInPandas(run, REDUCED))


def reduce_tree(items: DataFrame, reducer: Reducer, direct: int = 12_000, limit: int = 24_000) -> DataFrame:
    """recording_id, field, rank, text, source_segment_ids, level of items(recording_id, chunk_no, field, pos, text, source_segment_ids).

    level: at which a recording was whole; 1 if it was merged at once.
    """
    units = kept(items.select("recording_id", F.col("chunk_no").alias("unit"), "field", "pos", "text", "source_segment_ids"))
    done, level = None, 1
    while True:
        sized = kept(units.groupBy("recording_id", "unit").agg(F.sum(F.length("text") + 1).alias("size")))
        total = sized.groupBy("recording_id").agg((F.sum("size") + 1).alias("total"), F.count("*").alias("n"))
        whole = kept(total.where((F.col("total") <= direct) | (F.col("n") == 1)).select("recording_id"))
        last = _reduced(units.join(whole, "recording_id", "left_semi").withColumn("group_no", F.lit(1)), reducer).withColumn("level", F.lit(level))
        done = last if done is None else done.unionByName(last)
        rest = sized.join(whole, "recording_id", "left_anti").withColumnRenamed("unit", "chunk_no")
        if rest.isEmpty():
            break
        packed = pack_groups(rest, limit)
        place = F.row_number().over(Window.partitionBy("recording_id").orderBy("chunk_no"))
        packed = packed.withColumn("place", place)
        # Where every group holds one unit alone, neighbours go together, so each level has fewer units.
        alone = packed.groupBy("recording_id").agg((F.max("group_no") == F.count("*")).alias("alone"))
        groups = packed.join(alone, "recording_id").select("recording_id", F.col("chunk_no").alias("unit"), F.when(F.col("alone"), F.ceil(F.col("place") / 2).cast("int")).otherwise(F.col("group_no")).alias("group_no"))
        units = _reduced(units.join(groups, ["recording_id", "unit"]), reducer)
        level += 1
    return done.select("recording_id", "field", F.row_number().over(Window.partitionBy("recording_id", "field").orderBy("pos")).alias("rank"), "text", "source_segment_ids", "level")
