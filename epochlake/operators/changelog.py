"""Snapshots of a change log: durability, range deletes, latest versions, tombstones, base and delta, compaction.

Every function takes and gives DataFrames. A change log has the columns of schema.CHANGE_LOG, or at least those that a function
reads; keys may be of any type. Functions that pick the latest version keep the columns named in `keep`, all by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.versions import key_sid, version
from ..schema import CLEARS, INVALIDATED, POINTS, REMOVE, VALID
from .bounds import broadcast_if_small, with_previous

KEY = ["storage_id", "key"]


def durable(log: DataFrame, epoch: int) -> DataFrame:
    """Entries of snippets up to an epoch, itself included, that were not invalidated. Whether an entry counts is for its
    snippet's epoch to say, not for its version's. A null epoch never counts, nor does one of 2^63 or more."""
    kept = log.filter((F.col("snippet_epoch") >= 0) & (F.col("snippet_epoch") <= epoch))
    return kept.filter(F.col("snippet_state") == VALID) if "snippet_state" in log.columns else kept


def as_of(log: DataFrame, epoch: int) -> DataFrame:
    """The log as it stood when `epoch` was the durable one: time travel. Entries that were nondurable when the log was read
    count if their snippet's epoch does."""
    kept = log.filter((F.col("snippet_epoch") >= 0) & (F.col("snippet_epoch") <= epoch))
    return kept.filter(F.col("snippet_state") != INVALIDATED) if "snippet_state" in log.columns else kept


def max_appeared_epoch(log: DataFrame, durable_epoch: int = 0) -> DataFrame:
    """(max_epoch): the largest epoch that any snippet has used, whether it counts or not, or else the durable one."""
    return log.agg(F.greatest(F.coalesce(F.max("snippet_epoch"), F.lit(0)), F.lit(durable_epoch)).cast("long").alias("max_epoch"))


def cutoffs(log: DataFrame) -> DataFrame:
    """(storage_id, cut_major, cut_minor): the newest clearing or dropping of each storage that had one."""
    newest = log.filter(F.col("entry_type").isin(*CLEARS)).groupBy("storage_id").agg(F.max(F.struct(version().alias("v"), "major", "minor")).alias("c"))
    return newest.select("storage_id", F.col("c.major").alias("cut_major"), F.col("c.minor").alias("cut_minor"))


def drop_cleared(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows that no range delete has ended: an entry goes if its version is below its storage's cutoff, and stays at it.

    Storages without a cutoff keep all rows. Cutoffs are broadcast if they are few, which is counted; if not, both sides are
    shuffled by storage, where Spark splits the partitions of hot storages.
    """
    c = broadcast_if_small(cuts.select(F.col("storage_id").alias("_cut_sid"), version("cut_major", "cut_minor").alias("_cut")))
    return rows.join(c, (rows["storage_id"] == F.col("_cut_sid")) & (version(rows["major"], rows["minor"]) < F.col("_cut")), "left_anti")


def _order(rows: DataFrame, ties: list[str] | None) -> list[Column]:
    if ties is None:
        # a log without places is ordered by what its entries hold, so that timing decides nothing: a remove wins over a put
        ties = [c for c in ("file", "offset", "seq") if c in rows.columns] or [c for c in ("entry_type", "value", "blob_ids") if c in rows.columns]
    return [version().alias("_version"), *[F.col(c) for c in ties]]


def latest(log: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """The newest entry of each key, tombstones included, by aggregation: only one row of each key and task is shuffled, so a
    key with a third of all rows costs no more than another. Spark aggregates structs by sorting, before the shuffle and after
    it, as it does for the window; what this saves is the rows that travel. Entries without a key are left out; a null key is a key. Of equal
    versions the last in the order of `ties` wins: by default the file and offset, or seq, as far as these columns exist, and if
    none does, the entry type, value and objects."""
    rows = log.filter(F.col("entry_type").isin(*POINTS))
    rest = [c for c in rows.columns if c not in KEY]
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*_order(rows, ties))).alias("_best"))
    return best.select(*KEY, "_best.*").select(*rows.columns)


def latest_by_window(log: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """As latest, by a window: Spark keeps the first row of each key and task before it shuffles (WindowGroupLimit). Both forms
    sort; they take about as long."""
    rows = log.filter(F.col("entry_type").isin(*POINTS))
    w = Window.partitionBy(*KEY).orderBy(*[c.desc() for c in _order(rows, ties)])
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def live(newest: DataFrame) -> DataFrame:
    """Newest entries without tombstones. Tombstones must have taken part in finding the newest, or old rows would rise again."""
    return newest.filter(F.col("entry_type") != REMOVE)


def snapshot(log: DataFrame, epoch: int, ties: list[str] | None = None, keep_tombstones: bool = False) -> DataFrame:
    """The rows that live at a durable epoch, one for each key.

    Range deletes are applied before the newest version is sought: what they end can't be the newest of what stays, and less
    is shuffled. keep_tombstones is for a delta that will hide rows of a base.
    """
    log = durable(log, epoch)
    newest = latest(drop_cleared(log.filter(F.col("entry_type").isin(*POINTS)), cutoffs(log)), ties)
    return newest if keep_tombstones else live(newest)


def merge_base(base: DataFrame, delta_log: DataFrame, epoch: int, ties: list[str] | None = None) -> DataFrame:
    """A snapshot from a base (the snapshot or compaction of older logs) and a log of what came later.

    The delta's entry wins over the base's by its place, not its version; its tombstones hide rows of the base; a base row goes
    if the delta clears its storage at all, for the base is older than every clearing in the delta. Columns are those of both.
    """
    log = durable(delta_log, epoch)
    cuts = broadcast_if_small(cutoffs(log))  # used twice
    newest = latest(drop_cleared(log.filter(F.col("entry_type").isin(*POINTS)), cuts), ties)
    cleared = broadcast_if_small(cuts.select(F.col("storage_id").alias("_cut_sid")))
    old = base.join(cleared, base["storage_id"] == F.col("_cut_sid"), "left_anti")
    columns = [c for c in base.columns if c in newest.columns]
    rest = [c for c in columns if c not in KEY]
    both = old.select(*columns, F.lit(0).alias("_rank")).unionByName(newest.select(*columns, F.lit(1).alias("_rank")))
    best = both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "_rank").alias("_best")).select(*KEY, "_best.*").select(*columns)
    return live(best)


def snapshots_at(log: DataFrame, epochs: list[int], ties: list[str] | None = None) -> DataFrame:
    """Live rows at each of several epochs, with the column as_of: time travel to all of them by one scan of the log."""
    within = F.filter(F.array(*[F.lit(e).cast("long") for e in epochs]), lambda e: e >= F.col("snippet_epoch"))
    rows = as_of(log, max(epochs)).withColumn("as_of", F.explode(within))
    ends = rows.filter(F.col("entry_type").isin(*CLEARS)).groupBy("as_of", "storage_id").agg(F.max(version()).alias("_cut"))
    cuts = broadcast_if_small(ends.select(F.col("as_of").alias("_at"), F.col("storage_id").alias("_cut_sid"), "_cut"))
    points = rows.filter(F.col("entry_type").isin(*POINTS))
    left = points.join(cuts, (F.col("as_of") == F.col("_at")) & (F.col("storage_id") == F.col("_cut_sid")) & (version() < F.col("_cut")), "left_anti")
    rest = [c for c in rows.columns if c not in (*KEY, "as_of")]
    best = left.groupBy("as_of", *KEY).agg(F.max_by(F.struct(*rest), F.struct(*_order(left, ties))).alias("_best"))
    return live(best.select("as_of", *KEY, "_best.*"))


def compact(log: DataFrame, epoch: int, ties: list[str] | None = None) -> DataFrame:
    """What a compacted file of the log format holds: the live rows, versions and snippet epoch zero."""
    rows = snapshot(log, epoch, ties)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("major", zero).withColumn("minor", zero)
    return rows.withColumn("snippet_epoch", zero) if "snippet_epoch" in rows.columns else rows


def in_key_order(rows: DataFrame) -> DataFrame:
    """Rows in the byte order of storage (little-endian) and key, across partitions and inside them."""
    return rows.orderBy(key_sid())


def point_lookup(rows: DataFrame, storage_id: int, key) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return rows.filter((F.col("storage_id") == storage_id) & (F.col("key") == F.lit(key)))


def ordered_scan(rows: DataFrame, storage_id: int, key, inclusive: bool = True) -> DataFrame:
    """Rows of a storage from a key on, in the order of keys."""
    at = F.col("key") >= F.lit(key) if inclusive else F.col("key") > F.lit(key)
    return rows.filter((F.col("storage_id") == storage_id) & at).orderBy("key")


def partitioned(rows: DataFrame, n: int) -> DataFrame:
    """rows in n partitions that hold each row once, dealt in turn."""
    if n < 1:
        raise ValueError("n must be 1 at least")
    return rows.repartition(n)


def order_violations(rows: DataFrame, group: str, order: str, key: Column) -> DataFrame:
    """Rows whose key is below that of the row before them in their group, with the column previous_key: none in sound input."""
    keyed = rows.withColumn("_key", key)
    return with_previous(keyed, group, order, F.col("_key"), "previous_key").filter(F.col("_key") < F.col("previous_key")).drop("_key")


def checked_order(rows: DataFrame, group: str, order: str, key: Column) -> DataFrame:
    """rows, repeated keys dropped but for the first; an error when read if keys fall."""
    seen = with_previous(rows.withColumn("_key", key), group, order, F.col("_key"), "_before")
    fell = F.col("_key") < F.col("_before")
    ok = F.when(fell, F.raise_error(F.lit("keys are out of order")).cast("boolean")).otherwise(F.col("_before").isNull() | (F.col("_key") != F.col("_before")))
    return seen.filter(ok).drop("_key", "_before")


def fill_snippets(records: DataFrame, group: str, order: str) -> DataFrame:
    """Raw records with current_epoch: the epoch of the last begin marker before them; null before the first."""
    begin = F.when(F.col("entry_type").isin("marker_begin", "marker_invalidated_begin"), F.col("epoch"))
    return with_previous(records, group, order, begin, "current_epoch", last_known=True)


def entry_counts(log: DataFrame) -> DataFrame:
    """(n_puts, n_removes, n_entries): what an inspection counts - ordinary puts and removes - and all entries."""
    count = lambda c: F.count_if(c).cast("long")
    return log.agg(count(F.col("entry_type") == "normal_entry").alias("n_puts"), count(F.col("entry_type") == REMOVE).alias("n_removes"), F.count("*").alias("n_entries"))
