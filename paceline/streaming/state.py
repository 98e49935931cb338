"""What is known of each subject, kept as state of a stream instead of being folded anew from all that ever came.

Each query keeps a small state by key and gives a key's new row whenever that changed; the row after any order of the same input is what the batch
functions of the same name give (sources.batches.coverage and raw_complete, operators.product.first_times). State lives in Spark's checkpoint, so a
lost executor loses none of it. transformWithState needs the session's spark.sql.streaming.stateStore.providerClass to be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstTimes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "name string", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        least: dict[str, int] = {}
        for r in rows:
            if r.at is not None and r.name is not None:
                least[r.name] = min(r.at, least.get(r.name, r.at))
        for name, at in least.items():
            if not self.first.containsKey((name,)) or at < self.first.getValue((name,))[0]:
                self.first.updateValue((name,), (at,))
                yield Row(uid=key[0], name=name, at=at)

    def close(self) -> None:
        pass


def first_times(events: DataFrame) -> DataFrame:
    """uid, name, at of a stream of events (uid, name, at): a row when a milestone is reached, and again if an earlier event comes late."""
    return events.select("uid", "name", "at").groupBy("uid").transformWithState(_FirstTimes(), "uid string, name string, at long", "Update", "None")


class _RawComplete(StatefulProcessor):
    """The newest marker, and how many points came of each stream and generation; older generations than the marker's are forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marker = handle.getValueState("marker", "gen long, expected map<string,long>")
        self.have = handle.getMapState("have", "stream string, gen long", "n long")
        self.shown = handle.getValueState("shown", "complete boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        gen, expected = self.marker.get() if self.marker.exists() else (None, None)
        counts: dict[tuple[str, int], int] = {}
        for r in rows:
            if r.expected is None:
                counts[r.stream, r.gen] = counts.get((r.stream, r.gen), 0) + r.n
            elif gen is None or r.gen > gen:
                gen, expected = r.gen, dict(r.expected)
        for k, n in counts.items():
            if gen is None or k[1] >= gen:
                old = self.have.getValue(k)[0] if self.have.containsKey(k) else 0
                self.have.updateValue(k, (old + n,))
        if gen is None:
            return
        self.marker.update((gen, expected))
        for k in [tuple(k) for k in self.have.keys() if k[1] < gen]:
            self.have.removeKey(k)
        complete = all(self.have.containsKey((s, gen)) and self.have.getValue((s, gen))[0] >= n for s, n in expected.items())
        if not self.shown.exists() or self.shown.get()[0] != complete:
            self.shown.update((complete,))
            yield Row(subject=key[0], wid=key[1], complete=complete)

    def close(self) -> None:
        pass


def raw_complete(counted: DataFrame) -> DataFrame:
    """subject, wid, complete of a stream of points and markers: subject, wid, gen, and stream and n (points of a chunk) or expected (a marker's)."""
    x = counted.select("subject", "wid", "stream", "gen", "n", "expected")
    return x.groupBy("subject", "wid").transformWithState(_RawComplete(), "subject string, wid string, complete boolean", "Update", "None")


COVERAGE = "subject string, type string, intervals array<struct<s:long,e:long>>, caught_up boolean, checked_at long, earliest long, latest long"


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals [s, e), overlapping and touching ones joined, empty ones left out."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(x for x in intervals if x[0] < x[1]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


class _Coverage(StatefulProcessor):
    """Merged intervals and extremes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "intervals array<struct<s:long,e:long>>, caught_up boolean, checked_at long, earliest long, latest long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        intervals, caught, checked, first, last = self.known.get() if self.known.exists() else ([], False, None, None, None)
        both = [(x[0], x[1]) for x in intervals or []]
        for r in rows:
            if r.s is not None:
                both.append((r.s, r.e))
            caught |= bool(r.caught_up)
            checked = max((t for t in (checked, r.at) if t is not None), default=None)
            first = min((t for t in (first, r.earliest) if t is not None), default=None)
            last = max((t for t in (last, r.latest) if t is not None), default=None)
        both = merged(both)
        self.known.update((both, caught, checked, first, last))
        yield Row(subject=key[0], type=key[1], intervals=[Row(s=s, e=e) for s, e in both], caught_up=caught, checked_at=checked, earliest=first, latest=last)

    def close(self) -> None:
        pass


def coverage(facts: DataFrame) -> DataFrame:
    """subject, type, intervals, caught_up, checked_at, earliest, latest of a stream of facts (coverage_facts()); a row when facts of a key come.

    Whether a row is stale is a matter of when it is read (sources.batches.complete). No watermark: facts that come late count like others.
    """
    return facts.groupBy("subject", "type").transformWithState(_Coverage(), COVERAGE, "Update", "None")


def coverage_facts(heads: DataFrame) -> DataFrame:
    """subject, type, s, e, caught_up, at, earliest, latest: what each header says of its type; a pass that has caught up counts from 0 on."""
    x = heads.filter("problem is null and mode <> 'stats'")
    caught = F.coalesce(F.col("caughtUp") & F.col("mode").isin("anchored", "reconcile"), F.lit(False))
    spans = F.array(
        F.struct(F.col("window.start").alias("s"), F.col("window.end").alias("e"), F.lit(False).alias("caught_up")),
        F.struct(F.when(caught, F.lit(0).cast("long")).alias("s"), F.when(caught, F.coalesce("checkedAt", "createdAt")).alias("e"), caught.alias("caught_up")),
    )
    return x.select("subject", "type", F.inline(spans), F.col("checkedAt").alias("at"), F.lit(None).cast("long").alias("earliest"), F.lit(None).cast("long").alias("latest"))
