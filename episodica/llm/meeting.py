"""Where 64-bit keys of all documents meet: each task sends sorted distinct keys to ranges, homes learn which ones repeat.

A home is a share of the documents. Keys travel as differences of sorted runs. A key that very many documents have is one
entry for each gathering of a task, not one for each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import partitions
from .spans import U64, pack, unpack

#: Keys that a task gathers, at least, before it sends them on.
GATHERED = 1 << 21
#: Bits of a name, the first ones of a key. Names only say which keys may be shared: among 10^13 keys one in twenty that
#: no other document has passes by chance, which costs work and changes nothing.
NAME_BITS = 48
_NAMES = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("one", "homes", "many", "mine"))])
#: Of a range: names of one document each (as far as the task knows) with their homes, and names of several. And for the
#: home of the same number: its names that several of the task's documents have.
NAMES = "bucket int, one binary, homes binary, many binary, mine binary"


def gathered(n_buckets: int) -> int:
    """How many keys to gather, so that each of many ranges still gets a run of them."""
    return max(GATHERED, 64 * n_buckets)


def ranges(keys: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Which of n equal ranges each key of so many bits falls into."""
    return ((keys >> U64(bits - 32)) * U64(n) >> U64(32)).astype(np.int32)


def name_of(keys: np.ndarray) -> np.ndarray:
    return keys >> U64(64 - NAME_BITS)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U64), dtype=U64)


def cuts(items: np.ndarray):
    """(value, first, end) of each run of equal items."""
    if not len(items):
        return
    first = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
    yield from zip(items[first].tolist(), first.tolist(), [*first[1:].tolist(), len(items)], strict=True)


def places_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """searchsorted of keys in no order, by sorting them first: the table is then read from front to back."""
    if len(keys) < 1000:
        return np.searchsorted(table, keys)
    order, out = np.argsort(keys), np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(table, keys[order])
    return out


def found_in(keys: np.ndarray, table: np.ndarray, ascending: bool = False) -> np.ndarray:
    """Whether the sorted table has each key."""
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys) if ascending else places_in(keys, table)
    return table[np.minimum(at, len(table) - 1)] == keys


def by_home(homes: np.ndarray) -> np.ndarray:
    """A stable order of homes; numpy sorts 16-bit integers in one pass."""
    return np.argsort(homes.astype(np.uint16) if len(homes) and homes.max() < 1 << 16 else homes, kind="stable")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def by_bucket(blobs: DataFrame, schema: str, work, order: tuple[str, ...] = ()) -> DataFrame:
    """work(list of rows) -> record batches, for each bucket; only one bucket's blobs are held at a time."""
    parts = partitions(blobs.sparkSession)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    if rows:
                        yield from work(rows)
                    now, rows = row["bucket"], []
                rows.append(row)
        if rows:
            yield from work(rows)

    return blobs.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", *order).mapInArrow(run, schema)


def send_names(parts: list[tuple[np.ndarray, int]], n_buckets: int) -> pa.RecordBatch:
    """(names, home) of several documents -> rows of NAMES, one a range.

    Names that several of these documents have are repeated whatever others hold: their homes are told directly, their
    range gets one entry.
    """
    names = np.concatenate([p[0] for p in parts])
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
    home = np.array([p[1] for p in parts], np.int32)
    order = np.argsort(names)
    names, row = names[order], row[order]
    del order
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    many = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
    rows: dict[int, list] = {}
    at = first[~many]
    one, of = names[at], home[row[at]].astype(np.uint16 if n_buckets < 1 << 16 else np.int32)
    for b, x, y in cuts(ranges(one, n_buckets, NAME_BITS)):
        rows.setdefault(b, [None] * 4)[:2] = pack_sorted(one[x:y]), pack(of[x:y])
    every = names[first[many]]
    for b, x, y in cuts(ranges(every, n_buckets, NAME_BITS)):
        rows.setdefault(b, [None] * 4)[2] = pack_sorted(every[x:y])
    at = np.flatnonzero(np.repeat(many, np.diff(np.append(first, len(names)))))
    at = at[by_home(home[row[at]])]
    for h, x, y in cuts(home[row[at]]):
        rows.setdefault(h, [None] * 4)[3] = pack_sorted(np.unique(names[at[x:y]]))
    return batch_of([(b, *row) for b, row in rows.items()], _NAMES)


def repeated(entries: DataFrame) -> DataFrame:
    """Rows of NAMES -> (home, names): for each home the names of its documents that other documents have too."""
    wide = partitions(entries.sparkSession) >= 1 << 16

    def work(rows):
        told: dict[int, list] = {}
        ones, homes, known = [], [], []
        for r in rows:
            if r["mine"] is not None:
                told.setdefault(r["bucket"], []).append(unpack_sorted(r.pop("mine")))
            if r["one"] is not None:
                ones.append(unpack_sorted(r.pop("one")))
                homes.append(unpack(r.pop("homes"), np.int32 if wide else np.uint16))
            if r["many"] is not None:
                known.append(unpack_sorted(r.pop("many")))
        if ones:
            every = np.sort(np.concatenate(ones))
            known.append(every[1:][every[1:] == every[:-1]])
            del every
            known = np.unique(np.concatenate(known))
            for names, of in zip(ones, homes, strict=True):
                keep = found_in(names, known, True)
                names, of = names[keep], of[keep]
                order = by_home(of)
                for h, x, y in cuts(of[order]):
                    told.setdefault(h, []).append(names[order[x:y]])
        if told:
            yield batch_of([(h, pack_sorted(np.unique(np.concatenate(p)))) for h, p in told.items()], pa.schema([("home", pa.int32()), ("names", pa.binary())]))

    return by_bucket(entries, "home int, names binary", work)
