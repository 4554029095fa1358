"""Sites that wait in state of their own: for the frontier, for open deletions, and for what else falls on the same site.

Reads come sorted by place; the frontier is the watermark on where they begin. What a read says about a site is held,
summed up by site, until no read can add to it any more: until the frontier is `margin` bases beyond the site and beyond
the end of every deletion found within `near` bases of it, however long. Then the site is given out with all that
was held and its state goes. State is keyed by chromosome and bin, so a chromosome is spread over tasks, and a deletion
is held in each bin that it can touch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .frontier import place_time, starts

#: State of one's own needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "chrom string, bin long, place long, what string, n long, total long, deletions long"


#: Places of one row of state: what is stored and removed goes by these, not by site, as each row is a call of its own.
PAGE = 256


class Sites(StatefulProcessor):
    """State of one bin: held, sites (place, what) -> n; spans, deletions (start, end) -> n; a timer for the next change.

    Places are absolute, on the time line of all chromosomes. Both are stored in pages, by place or start.
    """

    def __init__(self, margin: int, near: int):
        self.margin, self.near = margin, near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "page long", "place array<bigint>, what array<string>, n array<bigint>")
        self.spans = handle.getMapState("spans", "page long", "first array<bigint>, last array<bigint>, n array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        sites, spans = self._stored()
        was = dict(sites), dict(spans)
        for f in rows:
            for kind, state, by in ((f["what"].notna(), sites, "what"), (f["what"].isna() & f["last"].notna(), spans, "last")):
                some = f[kind]
                if not len(some):
                    continue
                found = some.groupby(["place", by], sort=False).size()
                others = found.index.get_level_values(1)
                at = zip(found.index.get_level_values(0).astype("int64").tolist(), (others.astype(str) if by == "what" else others.astype("int64")).tolist(), strict=True)
                for k, n in zip(at, found.tolist(), strict=True):
                    state[k] = state.get(k, 0) + n
        yield from self._release(key, timerValues.getCurrentWatermarkInMs() // 1000, sites, spans, was)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        sites, spans = self._stored()
        yield from self._release(key, timerValues.getCurrentWatermarkInMs() // 1000, sites, spans, (dict(sites), dict(spans)))

    def close(self) -> None:
        pass

    def _stored(self) -> tuple[dict, dict]:
        return tuple({(a, b): n for _, page in state.iterator() for a, b, n in zip(*page, strict=True)} for state in (self.held, self.spans))

    @staticmethod
    def _store(state, old: dict, new: dict) -> None:  # noqa: ANN001
        """Pages that changed, written or removed."""
        changed = {a // PAGE for a, _ in old.keys() - new.keys()} | {k[0] // PAGE for k, n in new.items() if old.get(k) != n}
        had, pages = {a // PAGE for a, _ in old}, {page: ([], [], []) for page in changed}
        for (a, b), n in new.items():
            if (page := pages.get(a // PAGE)) is not None:
                for column, x in zip(page, (a, b, n), strict=True):
                    column.append(x)
        for page, value in pages.items():
            if value[0]:
                state.updateValue((page,), value)
            elif page in had:
                state.removeKey((page,))

    def _release(self, key: tuple, frontier: int, sites: dict, spans: dict, was: tuple[dict, dict]) -> Iterator[pd.DataFrame]:
        """Give out what is final with reads from `frontier` on still to come, store what changed, set the next timer."""
        by_place: dict[int, list[tuple[str, int]]] = {}
        for (place, what), n in sites.items():
            by_place.setdefault(place, []).append((what, n))
        out, waits, kept = [], [], []
        # Deletions by where they begin and end, with sums: what lies near a place is found by bisection.
        begins, ends = sorted((a, b, n) for (a, b), n in spans.items()), sorted((b, n) for (_, b), n in spans.items())
        firsts, farthest, begun = [a for a, _, _ in begins], list(accumulate((b for _, b, _ in begins), max)), list(accumulate((n for _, _, n in begins), initial=0))
        lasts, ended = [b for b, _ in ends], list(accumulate((n for _, n in ends), initial=0))
        for place in sorted(by_place):
            found, k = by_place[place], bisect_right(firsts, place + self.near)
            until = place + self.margin
            if k and farthest[k - 1] + self.near >= place:
                until = max(until, farthest[k - 1])
            if until < frontier:
                total, deletions = sum(n for _, n in found), begun[k] - ended[bisect_left(lasts, place - self.near)]
                for what, n in sorted(found):
                    out.append((key[0], key[1], place, what, n, total, deletions))
                    del sites[place, what]
            else:
                waits.append(until + 1)
                kept.append(place)
        for first, last in list(spans):
            gone = last + self.near + self.margin  # the last site near it that a read may still bring
            if gone < frontier and bisect_left(kept, first - self.near) == bisect_right(kept, last + self.near):
                del spans[first, last]
            else:
                waits.append(gone + 1)
        for state, old, new in zip((self.held, self.spans), was, (sites, spans), strict=True):
            self._store(state, old, new)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waits:
            self.handle.registerTimer(max(min(waits), frontier + 1) * 1000)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def held_sites(rows: DataFrame, lengths: dict[str, int], margin: int = 0, near: int = 0, width: int = 1 << 14) -> DataFrame:
    """(chrom, pos, what, n, total, deletions) of streamed rows (chrom, start, pos, what, last), each site once.

    start: where the read begins, in order of which rows come; pos: the site that the row is about; what: what it says
    of it. n counts a site's rows by what, total all its rows. A row without `what` is a deletion pos..last: deletions
    counts those within `near` bases of the site. A row with neither only moves the frontier, as at the end of a
    stream. Chromosomes come in the order of `lengths`; rows of others are dropped, null chromosomes and starts as well.
    Reads that begin behind the frontier of the batches before are late and dropped by the watermark.

    Needs the state store STORE. State is what is open: sites and deletions that reads to come can touch.
    """
    own, gap = starts(F.col("chrom"), lengths, margin + near), margin + near
    timed = rows.withColumn("t", place_time(F.col("start"), F.col("chrom"), lengths, gap)).where("t is not null").withWatermark("t", "0 seconds")
    place, last = F.col("pos").cast("long") + own, F.col("last").cast("long") + own
    bins = lambda a, b: F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))
    touched = F.when(F.col("what").isNull() & F.col("last").isNotNull(), bins(place - near, last + near)).otherwise(bins(place, place))
    keyed = timed.select("chrom", F.explode(touched).alias("bin"), place.alias("place"), F.col("what").cast("string").alias("what"), last.alias("last"), "t")
    out = keyed.groupBy("chrom", "bin").transformWithStateInPandas(Sites(margin, near), OUT, "append", "eventTime")
    return out.select("chrom", (F.col("place") - own).alias("pos"), "what", "n", "total", "deletions")


def pileup_behind_deletions(obs: DataFrame, lengths: dict[str, int], near: int = 0, width: int = 1 << 14) -> DataFrame:
    """(chrom, pos, base, n, depth, deletions) of streamed observations (chrom, start, pos, base) and deletions (base null,
    pos..last): a site is given out when no deletion near it is open any more."""
    out = held_sites(obs.withColumnRenamed("base", "what"), lengths, near, near, width)
    return out.withColumnsRenamed({"what": "base", "total": "depth"})


def clips_behind_frontier(clips: DataFrame, lengths: dict[str, int], behind: int = 250, width: int = 1 << 14) -> DataFrame:
    """(chrom, site, qname, n, clips) of streamed clips (chrom, start, site, qname): each read's clip with the number of
    clips at its site, given out `behind` bases after it, which must be at least how far before a site its reads begin."""
    rows = clips.select("chrom", "start", F.col("site").alias("pos"), F.col("qname").alias("what"), F.lit(None).cast("long").alias("last"))
    out = held_sites(rows, lengths, behind, 0, width)
    return out.select("chrom", F.col("pos").alias("site"), F.col("what").alias("qname"), "n", F.col("total").alias("clips"))


def duplicate_groups(reads: DataFrame, lengths: dict[str, int], key: Column, width: int = 1 << 14) -> DataFrame:
    """(chrom, pos, key, n): how many streamed reads (chrom, pos) of one key begin at each place, once the frontier is beyond it."""
    rows = reads.select("chrom", F.col("pos").alias("start"), "pos", key.alias("what"), F.lit(None).cast("long").alias("last"))
    return held_sites(rows, lengths, 0, 0, width).select("chrom", "pos", F.col("what").alias("key"), "n")


def frontier_rows(df: DataFrame, chrom: str, at: int) -> DataFrame:
    """One row in the columns of df that only moves the frontier to a place: what is before it becomes final."""
    cells = [F.lit(chrom).alias("chrom") if c == "chrom" else F.lit(at).cast(t).alias(c) if c in ("start", "pos", "site") else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    return df.sparkSession.range(1).select(*cells)
