"""Pairs of records nearest in time, found through a learned index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import DAY_US, epoch_us


class PiecewiseLinearIndex:
    """Positions of sorted distinct keys, predicted by lines with a bounded error.

    Segments are halved until the line between a segment's ends is within
    ``error`` of every position, all segments of a round at once.
    """

    def __init__(self, keys: np.ndarray, breaks: np.ndarray, error: int = 16) -> None:
        self.keys, self.error = keys, error
        n = len(keys)
        starts = np.unique(np.concatenate([[0], breaks])).astype(np.int64) if n else np.empty(0, np.int64)
        position = np.arange(n, dtype=np.int64)
        while n:
            ends = np.append(starts[1:], n)
            slope = self._slopes(starts, ends)
            of = np.repeat(np.arange(len(starts)), ends - starts)
            off = np.abs(starts[of] + (keys - keys[starts[of]]) * slope[of] - position)
            worst = np.maximum.reduceat(off, starts)
            split = (worst > error - 1) & (ends - starts > 2)
            if not split.any():
                break
            starts = np.sort(np.concatenate([starts, ((starts + ends) // 2)[split]]))
        self.starts = starts
        self.ends = np.append(starts[1:], n) if n else starts
        self.first = keys[starts] if n else keys
        self.slope = self._slopes(self.starts, self.ends) if n else np.empty(0)

    def _slopes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = self.keys[ends - 1] - self.keys[starts]
        return np.divide(ends - 1 - starts, span, out=np.zeros(len(starts)), where=span > 0)

    def lower_bound(self, wanted: np.ndarray) -> np.ndarray:
        """Position of the first key not below each wanted key."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64)
        s = np.maximum(np.searchsorted(self.first, wanted, side="right") - 1, 0)
        guess = self.starts[s] + (wanted - self.first[s]) * self.slope[s]
        guess = np.clip(guess, self.starts[s], self.ends[s]).astype(np.int64)
        low = np.maximum(guess - self.error - 1, self.starts[s])
        high = np.minimum(guess + self.error + 2, self.ends[s])
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = open_ & (self.keys[np.minimum(middle, len(self.keys) - 1)] < wanted)
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low


def _matched(rows: pd.DataFrame, done: np.ndarray, tolerance: int, error: int) -> pd.DataFrame:
    """Pairs for the left rows marked ``done`` in rows sorted by shard and time."""
    span = np.int64(rows["at"].max() + 2 * tolerance + 2)
    key = rows["shard"].to_numpy() * span + rows["at"].to_numpy() + tolerance
    right = rows["side"].to_numpy() == 0
    ids = rows["id"].to_numpy()
    keys, owners = key[right], ids[right]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    keys, owners = keys[fresh], owners[fresh]
    shard = keys // span
    index = PiecewiseLinearIndex(keys, np.flatnonzero(np.diff(shard)) + 1, error)
    left = ~right & done
    wanted, asked = key[left], ids[left]
    if not len(keys) or not len(wanted):
        return pd.DataFrame({"left_id": [], "right_id": [], "offset_us": []}).astype("int64")
    above = index.lower_bound(wanted)
    far = np.iinfo(np.int64).max
    after = np.where(above < len(keys), keys[np.minimum(above, len(keys) - 1)] - wanted, far)
    before = np.where(above > 0, wanted - keys[np.maximum(above - 1, 0)], far)
    same = lambda at: shard[np.clip(at, 0, len(keys) - 1)] == wanted // span
    after = np.where((after <= tolerance) & same(above), after, far)
    before = np.where((before <= tolerance) & same(above - 1), before, far)
    earlier = before <= after
    hit = np.minimum(before, after) < far
    at = np.where(earlier, above - 1, above)[hit]
    return pd.DataFrame({"left_id": asked[hit], "right_id": owners[at], "offset_us": np.where(earlier, -before, after)[hit]})


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_time: str,
    right_time: str,
    left_entity: Column,
    right_entity: Column,
    tolerance_us: int,
    shard_days: int = 64,
    error: int = 16,
) -> DataFrame:
    """For each left row the right row of the same entity nearest in time.

    Returns ``left_id, right_id, offset_us`` (right minus left) for the left
    rows that have a right row within the tolerance, its ends included; ties
    go to the earlier time, then to the smaller right id.  Rows without
    entity, time or id pair with nothing; a left id given twice is answered
    for each of its rows.  Only the named columns are read, so extra or
    clashing columns don't matter; empty tables give no rows.

    Rows are sharded by entity and stretch of time, so an entity with a third
    of all rows is spread over many shards; right rows near a shard's edge
    are in both shards.  A shard is read as a sorted stream, of which a task
    keeps the last batch and the rows within the tolerance.
    """
    width = shard_days * DAY_US

    def side(df: DataFrame, entity: Column, time: str, key: str, number: int) -> DataFrame:
        t = epoch_us(df, time)
        out = df.select(entity.alias("entity"), t.alias("t"), F.col(key).cast("bigint").alias("id"), F.lit(number).alias("side"))
        return out.where("entity IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL")

    shard = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    r = side(right, right_entity, right_time, right_id, 0)
    r = r.withColumn("slot", F.explode(F.sequence(shard(F.col("t") - tolerance_us), shard(F.col("t") + tolerance_us))))
    both = side(left, left_entity, left_time, left_id, 1).withColumn("slot", shard(F.col("t"))).unionByName(r)
    both = both.withColumn("at", F.col("t") - F.col("slot") * width)
    both = both.select(F.xxhash64("entity").alias("h"), "entity", "slot", "at", "side", "id").repartition("h", "slot").sortWithinPartitions("h", "entity", "slot", "at", "side", "id")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            rows, out, rest = _step(rows, tolerance_us, error, last=False)
            yield out
        if rest is not None and len(rest):
            yield _step(rest, tolerance_us, error, last=True)[1]

    pairs = both.drop("h").mapInPandas(stream, "left_id bigint, right_id bigint, offset_us bigint")
    return pairs


def _step(rows: pd.DataFrame, tolerance: int, error: int, last: bool) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Answer what can be answered; the rest to keep for the next batch."""
    if not len(rows):
        return rows, pd.DataFrame({"left_id": [], "right_id": [], "offset_us": []}).astype("int64"), rows
    entity, slot = rows["entity"].to_numpy(), rows["slot"].to_numpy()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (entity[1:] != entity[:-1]) | (slot[1:] != slot[:-1])
    shard = np.cumsum(fresh) - 1
    rows = rows.assign(shard=shard)
    at, is_left = rows["at"].to_numpy(), rows["side"].to_numpy() == 1
    open_ = (shard == shard[-1]) & (at + tolerance >= at[-1]) & (not last)
    out = _matched(rows, ~open_, tolerance, error)
    waiting = open_ & is_left
    since = (at[waiting].min() if waiting.any() else at[-1]) - tolerance
    keep = (shard == shard[-1]) & (waiting | (~is_left & (at >= since)))
    return rows, out, rows[keep].drop(columns="shard").reset_index(drop=True)
