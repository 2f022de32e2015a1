"""Every block of one table with every block of another, neither of them copied in a shuffle.

A block is one row that holds many, packed. Each table is dealt into blocks once; a task then
reads one block of the first and, one after the other, those of the second, and may keep
what it has found so far. So disk holds the tables once, however many blocks meet.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.lineage import cut

#: Tasks that a product of few blocks is parted into.
TASKS = 128


def packed(rows: DataFrame, many: int, make: Callable, by: str | None = None) -> DataFrame:
    """``n, block``: the rows dealt into ``many`` blocks, evenly or by the hash of a column. A block
    holds what ``make`` gives for its Arrow table, and stands in a partition of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if found:
            block = pickle.dumps(make(pa.Table.from_batches(found)), 5)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([block], pa.binary())], ["n", "block"])

    dealt = rows.repartition(many, by) if by else rows.repartition(many)
    return cut(dealt.mapInArrow(run, "n int, block binary"))


def crossed(asked: DataFrame, held: DataFrame, blocks: tuple[int, int], task: Callable, schema: str, half: bool = False) -> DataFrame:
    """What ``task`` yields, as Arrow batches, for each block of ``asked`` and an iterator over blocks of ``held``.

    A task gets ``n, block`` of one asked block and of several held ones: of all, or, if there are few asked ones, of a part.
    ``blocks`` says how many there are of either. With ``half`` a block meets only those up to its own number, for pairs of one table.
    """
    a, h = asked.toDF("a", "asked"), held.toDF("h", "held").coalesce(max(1, min(blocks[1], TASKS // blocks[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((b, k) for b in batches for k in range(len(b)))
        for b, k in pairs:
            mine = b.column("a")[k].as_py(), pickle.loads(b.column("asked")[k].as_py())

            def others(b=b, k=k):
                yield b.column("h")[k].as_py(), pickle.loads(b.column("held")[k].as_py())
                yield from ((b.column("h")[k].as_py(), pickle.loads(b.column("held")[k].as_py())) for b, k in pairs)

            yield from task(mine, others())

    met = h.hint("shuffle_replicate_nl").crossJoin(a)
    return (met.where("h <= a") if half else met).mapInArrow(run, schema)
