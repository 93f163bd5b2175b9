"""Which pieces of source fit a budget, when whether one fits hangs on all that were taken before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters in all, of files that an installation starts with, of one file, of one such file; what is left must be more than that for a piece to be cut to it.
TOTAL, RESERVED, EACH, ENTRY_EACH, CUT = 48 << 10, 16 << 10, 12 << 10, 8 << 10, 200


def reserved_budget(pieces: DataFrame, total: int = TOTAL, reserved: int = RESERVED, each: int = EACH, entry_each: int = ENTRY_EACH, cut: int = CUT) -> DataFrame:
    """(scan_id, path, entry, length) of the pieces that are taken, rows (scan_id, path, entry, priority, text).

    First entry files, by priority and path, each up to `entry_each`, as long as they fit what is reserved for them: one that doesn't is left out, and later ones may fit. Then the others, each up to
    `each`, within the whole budget; one that doesn't fit is cut to what is left if that is more than `cut`, else left out. A null text is empty and takes nothing.

    Lengths alone are dealt by scan and read in order with the characters used so far as the only state, so a scan of any number of files takes constant memory.
    """
    length = F.coalesce(F.length("text"), F.lit(0))
    entry = F.coalesce("entry", F.lit(False))
    sent = pieces.select("scan_id", "path", entry.alias("entry"), (~entry).cast("int").alias("_turn"), "priority", F.when(entry, F.least(length, F.lit(entry_each))).otherwise(F.least(length, F.lit(each))).cast("long").alias("length"))
    sent = sent.repartition("scan_id").sortWithinPartitions("scan_id", "_turn", "priority", "path", "length").select("scan_id", "path", "entry", "length")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, used = (), 0
        for batch in batches:
            taken = []
            for one, first, size in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if (one,) != scan:
                    scan, used = (one,), 0
                room = (min(reserved, total) if first else total) - used
                got = size if size <= room else room if not first and room > cut else 0
                used += got
                taken.append(got)
            yield batch.set_column(3, "length", pa.array(taken, pa.int64()))

    return sent.mapInArrow(go, sent.schema).where("length > 0")
