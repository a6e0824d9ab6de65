"""Which epoch is durable while several channels write: a low watermark over their sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermark(channels: DataFrame, switched: int) -> DataFrame:
    """(informed, recorded) for channels(channel, working, finished) after a switch to epoch `switched`.

    working is the epoch of a channel's open or last session, null for none; a session is open if it is above finished.
    informed is the last epoch that no open session can still write to: below `switched` and below every open session's.
    recorded counts only if some session has finished by then: the largest such epoch; else 0.
    """
    open_ = F.col("working").isNotNull() & (F.col("working") > F.coalesce("finished", F.lit(0)))
    lowest = channels.agg(F.min(F.when(open_, F.col("working") - 1))).first()[0]  # one number
    limit = max(0, switched - 1 if lowest is None else min(switched - 1, lowest))
    done = F.max(F.when(F.col("finished") <= limit, F.col("finished")))
    return channels.agg(F.lit(limit).cast("long").alias("informed"), F.coalesce(done, F.lit(0)).cast("long").alias("recorded"))


class EpochProgress:
    """The same, kept up while channels begin and end sessions. It belongs to the driver and holds two numbers a channel.

    informed and recorded never fall. on_durable is called with each new informed epoch, on_record with each recorded one.
    """

    def __init__(self, on_durable: Callable[[int], None] = lambda _: None, on_record: Callable[[int], None] = lambda _: None) -> None:
        self.switched = self.informed = self.recorded = 0
        self.working: dict[str, int] = {}
        self.finished: dict[str, int] = {}
        self._on_durable, self._on_record = on_durable, on_record

    def switch(self, epoch: int) -> bool:
        """Starts an epoch. One that isn't above the current is refused: False."""
        if epoch <= self.switched:
            return False
        self.switched = epoch
        self._update()
        return True

    def begin(self, channel: str) -> int:
        """Opens a session; it belongs to the current epoch, which is returned."""
        if channel in self.working:
            raise ValueError(f"{channel} has an open session")
        self.working[channel] = self.switched
        return self.switched

    def end(self, channel: str) -> None:
        self.finished[channel] = self.working.pop(channel)
        self._update()

    def abort(self, channel: str) -> None:
        """Ends a session whose entries don't count: it finishes nothing, and no longer holds the watermark back."""
        self.working.pop(channel)
        self._update()

    def _update(self) -> None:
        if not self.switched:
            return
        limit = min([self.switched - 1, *(e - 1 for c, e in self.working.items() if e > self.finished.get(c, 0))])
        done = max((e for e in self.finished.values() if e <= limit), default=0)
        if done > self.recorded:
            self.recorded = done
            self._on_record(done)
        if limit > self.informed:
            self.informed = limit
            self._on_durable(limit)
