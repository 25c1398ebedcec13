"""Exact dedup over a cuckoo-filter index of live digests.

Digests (SHA-256 and byte length) of every whole text go through two rounds of the same index: one inside each scan
partition, which folds local copies so that a group of any size leaves at most a row for each partition, and one on each
shard of the digest space. A filter hit is only believed after the digest held in its bucket has been compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_of, rows_of, shuffle_partitions

SLOTS = 4
MAX_KICKS = 96
#: Live digests that a scan partition's index holds before it emits and deletes the oldest half.
LOCAL_CAPACITY = 200_000
#: Rows that a shard of the digest space is planned for.
SHARD_ROWS = 250_000


class CuckooIndex:
    """Cuckoo filter whose slots also hold the full key and a value.

    `fingers` is the filter proper: 16-bit fingerprints in buckets of four, two candidate buckets a key. `keys` and
    `values` are the bucketed content that a hit is verified against. A chain of more than MAX_KICKS displacements is an
    overflow: the table doubles and is filled again from the stored keys.
    """

    def __init__(self, buckets: int = 256) -> None:
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask, self.size = buckets - 1, 0
        self.fingers = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        finger = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return finger, first, self._other(first, finger)

    def _other(self, bucket: int, finger: int) -> int:
        return (bucket ^ (finger * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> int:
        """Slot of a live key, or -1."""
        finger, first, second = self._places(key)
        fingers, keys = self.fingers, self.keys
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if fingers[slot] == finger and keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value) -> None:
        """Adds a key that is not live."""
        finger, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingers[slot]:
                    self._put(slot, finger, key, value)
                    return
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + finger) % SLOTS
            old = self.fingers[slot], self.keys[slot], self.values[slot]
            self.fingers[slot], self.keys[slot], self.values[slot] = finger, key, value
            finger, key, value = old
            bucket = self._other(bucket, finger)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingers[slot]:
                    self._put(slot, finger, key, value)
                    return
        self._grow((key, value))

    def _put(self, slot: int, finger: int, key: bytes, value) -> None:
        self.fingers[slot], self.keys[slot], self.values[slot] = finger, key, value
        self.size += 1

    def _grow(self, homeless: tuple) -> None:
        live = [*self.items(), homeless]
        self.resizes += 1
        self._empty((self.mask + 1) * 2)
        for key, value in live:
            self.insert(key, value)

    def delete(self, key: bytes):
        """Takes a live key out and returns its value; KeyError if it is not live."""
        slot = self.find(key)
        if slot < 0:
            raise KeyError(key)
        value = self.values[slot]
        self.fingers[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return value

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


_GROUP = pa.schema([("sha", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("group_size", pa.int64())])
_GROUP_DDL = "sha binary, n_bytes long, keep_id long, n_keep long, group_size long"


def _emit(found: list) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(found), 10_000):
        part = found[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[:32] for k, _ in part], pa.binary()), pa.array([int.from_bytes(k[32:], "little") for k, _ in part], pa.int64()), *(pa.array([v[i] for _, v in part], pa.int64()) for i in range(3))], schema=_GROUP)


def _later(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _index(capacity: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        order: list[bytes] = []
        for batch in batches:
            for sha, n_bytes, keep_id, n_keep, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                key = sha + n_bytes.to_bytes(8, "little")
                slot = live.find(key)
                if slot < 0:
                    live.insert(key, [keep_id, n_keep, size])
                    if capacity:
                        order.append(key)
                else:
                    value = live.values[slot]
                    if _later(keep_id, value[0]):
                        value[0], value[1] = keep_id, n_keep
                    elif keep_id == value[0]:
                        value[1] += n_keep
                    value[2] += size
            if capacity and live.size > capacity:
                old, order = order[: len(order) // 2], order[len(order) // 2 :]
                yield from _emit([(k, live.delete(k)) for k in old])
        yield from _emit(list(live.items()))

    return run


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, n_bytes) of every whole text; null counts as empty."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).cast("long").alias("n_bytes"))


def live_groups(dig: DataFrame) -> DataFrame:
    """(sha, n_bytes, keep_id, n_keep, group_size), a row for each distinct text.

    keep_id is the largest doc_id (null only if all are null), n_keep the rows that carry it.
    """
    spark = dig.sparkSession
    rows = dig.select("sha", "n_bytes", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n_keep"), F.lit(1).cast("long").alias("group_size"))
    local = materialise(rows.mapInArrow(_index(LOCAL_CAPACITY), _GROUP_DDL), "dedup-local")
    shards = max(shuffle_partitions(spark), -(-local.count() // SHARD_ROWS))
    return materialise(local.repartition(shards, "sha").mapInArrow(_index(None), _GROUP_DDL), "dedup-live")


_LIVE = pa.schema([("sha", pa.binary()), ("n_bytes", pa.int64()), ("copies", pa.int64())])
_LIVE_DDL = "sha binary, n_bytes long, copies long"


def _updated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's index, filled from its stored keys, then changed: the live digests it ends with."""
    live = CuckooIndex()
    for batch in batches:
        for sha, n_bytes, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = sha + n_bytes.to_bytes(8, "little")
            slot = live.find(key)
            if slot < 0:
                live.insert(key, copies)
            else:
                live.values[slot] += copies
                if live.values[slot] == 0:
                    live.delete(key)
    left = list(live.items())
    if any(n < 0 for _, n in left):
        raise ValueError("a text that is not live can't be deleted")
    for at in range(0, len(left), 10_000):
        part = left[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[:32] for k, _ in part], pa.binary()), pa.array([int.from_bytes(k[32:], "little") for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], schema=_LIVE)


def updated_index(live: DataFrame | None, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """(sha, n_bytes, copies): the index of live digests after documents have come and gone; written as a table, a version of its own.

    live is an earlier version (none: an empty index), inserted and deleted are tables with doc_id and text. A digest goes when its
    last copy does. Insertions of a run count before its deletions; to delete a text that is not live is an error. Null counts as
    empty text. Copies are folded before the shuffle, so a text of any number of copies is a row for each partition.
    """
    rows = []
    for docs, sign in ((inserted, 1), (deleted, -1)):
        if docs is not None:
            one = digests(docs).select("sha", "n_bytes", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n_keep"), F.lit(1).cast("long").alias("group_size"))
            rows.append(one.mapInArrow(_index(LOCAL_CAPACITY), _GROUP_DDL).select("sha", "n_bytes", (F.col("group_size") * sign).alias("copies")))
    changes = [*([live.select("sha", "n_bytes", "copies")] if live is not None else []), *rows]
    if not changes:
        raise ValueError("neither an index nor documents")
    every = changes[0]
    for more in changes[1:]:
        every = every.unionByName(more)
    every = materialise(every, "index-changes")
    shards = max(shuffle_partitions(every.sparkSession), -(-every.count() // SHARD_ROWS))
    # a digest's positive counts first, so that it is not taken out in between
    dealt = every.repartition(shards, "sha").sortWithinPartitions(F.col("copies").desc())
    return materialise(dealt.mapInArrow(_updated, _LIVE_DDL), "index-live")


def live_copies(live: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, copies (0: none) of the texts in an index that equal each row's of docs(doc_id, text, ...)."""
    return digests(docs).join(live, ["sha", "n_bytes"], "left").select("doc_id", F.coalesce("copies", F.lit(0)).alias("copies"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text, ...).

    Equal texts form a group (null equals empty); the row with the largest doc_id stays and has kept true. A null doc_id
    is smaller than any other. Where several rows carry the largest doc_id, one of them stays. Columns besides doc_id and
    text are not read, so their names don't matter. An empty table gives an empty result.
    """
    dig = digests(docs)
    groups = live_groups(dig)
    joined = dig.alias("d").join(groups.alias("g"), ["sha", "n_bytes"])
    last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if groups.filter("n_keep > 1").isEmpty():
        judged = joined.withColumn("kept", last)
    else:
        tied = last & (F.col("n_keep") > 1)
        few = joined.filter(tied).groupBy("sha", "n_bytes", "doc_id", "keep_id", "n_keep", "group_size").count()
        again = few.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("nth")).withColumn("kept", F.col("nth") == 1)
        cols = ["sha", "n_bytes", "doc_id", "keep_id", "n_keep", "group_size", "kept"]
        judged = joined.filter(~tied).withColumn("kept", last).select(cols).unionByName(again.select(cols))
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, whole and with all their columns, whatever their names.

    Null and empty texts are one group, in which a row of either kind stays. Of rows that tie on the largest doc_id one stays. An
    empty table gives an empty one.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    groups = live_groups(digests(docs))
    multi = groups.filter("group_size > 1").select("sha", "keep_id", "n_keep")
    keyed = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(raw, 256)).alias("sha"))
    hit = keyed.join(multi.hint("merge"), "sha", "left")  # the same plan at every size
    alone = F.col("n_keep").isNull()
    last = ~alone & F.col("id").eqNullSafe(F.col("keep_id"))
    if multi.filter("n_keep > 1").isEmpty():
        return rows_of(hit.filter(alone | last))
    tied = F.coalesce(F.col("n_keep") > 1, F.lit(False))
    return rows_of(hit.filter((alone | last) & ~tied)).unionByName(rows_of(hit.filter(last & tied).dropDuplicates(["sha"])))
