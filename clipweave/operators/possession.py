"""The open possession of one hand, fed one frame at a time: shared by the batch fold and the stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X


def frame_columns(name: str = "object") -> dict[str, Column]:
    """What a frame's name says, worked out by Spark: the name as shown, the form that names are compared by,
    the words that tie different names together, and whether the hand is empty."""
    shown = F.trim(F.coalesce(F.col(name), F.lit("")))
    return {"shown": shown, "same": F.lower(shown), "ties": tie_words(F.lower(shown)), "empty": X.is_empty(name, "track")}


def tie_words(same: Column | str) -> Column:
    c = F.col(same) if isinstance(same, str) else same
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3))


class Possession:
    """Feed frames (`frame_columns`) in order; each call gives back the interval that the frame ended, if any."""

    __slots__ = ("least", "patience", "start", "end", "same", "ties", "votes", "empties")

    def __init__(self, least: int, patience: int, state: tuple | None = None):
        self.least, self.patience = least, patience
        self.start, self.end, self.same, self.ties, self.votes, self.empties = state or (None, None, None, (), {}, 0)

    @property
    def is_open(self) -> bool:
        return self.start is not None

    def state(self) -> tuple:
        return self.start, self.end, self.same, list(self.ties), dict(self.votes), self.empties

    def feed(self, t: int, shown: str, same, ties, empty: bool) -> tuple | None:
        if empty:
            self.empties += 1
            return self.close() if self.empties >= self.patience else None
        self.empties = 0
        done = None
        if not (self.is_open and (same == self.same or not set(ties).isdisjoint(self.ties))):
            done = self.close()
            self.start, self.same, self.ties, self.votes = t, same, ties, {}
        self.end = t
        self.votes[shown] = self.votes.get(shown, 0) + 1
        return done

    def close(self) -> tuple | None:
        """End what is open; the most frequent name stays, the first one on ties."""
        if not self.is_open:
            return None
        start, end, votes = self.start, self.end, self.votes
        self.start = self.end = None
        return (start, end, max(votes, key=votes.get)) if end - start >= self.least else None
