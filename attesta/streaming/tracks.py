"""What to do in the quiet: the passes that a store is due once its journals have been silent for a while.

A store's log has rows (store, at, kind, track, rc, counts): kind 'activity' is a change of a journal, 'finished' the outcome of a run (its exit code and what it did; a null track is the one that runs),
'drafts' sets how many drafts wait (counts['drafts']), 'stale' says that the trail has outlived its time. Runs are asked for, never made, here.

After IDLE minutes without activity the first track that is due starts: drain if drafts wait, else distill; weave once something was poured in this silence; trail and payforward once something was
woven (trail also when it is stale); tidy. A run that had nothing to do (exit code 2) or failed lets its track rest for BACKOFF minutes, across silences. Tracks that are once for a silence are settled by their start, or, where
SERVED names exit codes, by those outcomes. Activity stops the run (unless yields is False), reports what the silence has done, and begins a new one.

Steps are a function of the log alone, so a replay in a batch and a stream give the same rows. Rows of equal time go activity first, and a run that is due then starts behind them; a row that comes later than its time counts as of now, null times and
unknown kinds are passed over. An empty log gives no rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from attesta.ship import ship

IDLE, BACKOFF = 10.0, 20.0
#: What a successful run adds to the silence's account.
TALLY = {"drain": ("poured", "tossed", "fixed"), "distill": ("drafts",), "weave": ("woven",), "trail": ("trailed",), "payforward": ("paid",), "tidy": ("tidied",)}
#: Tracks that are once for a silence, and the exit codes that settle them; None: their start does.
SERVED = {"weave": (0,), "trail": None, "payforward": (0, 2), "tidy": None}
NOTHING = 2
KINDS = ("activity", "drafts", "stale", "finished")
OUT = "store string, at timestamp, action string, track string, done map<string,bigint>"


class Silence:
    """The state of one store. Times are milliseconds."""

    def __init__(self, idle: float = IDLE, backoff: float = BACKOFF, yields: bool = True, state: str | None = None):
        self.idle, self.backoff, self.yields = int(idle * 60_000), int(backoff * 60_000), yields
        self.s = json.loads(state) if state else {"last": None, "now": 0, "running": None, "settled": [], "rest": {}, "done": {}, "drafts": 0, "stale": False}

    def order(self) -> list[str]:
        """The tracks that are due, rest or not."""
        s, settled = self.s, self.s["settled"]
        due = {
            "drain": s["drafts"] > 0,
            "distill": s["drafts"] <= 0,
            "weave": "weave" not in settled and s["done"].get("poured", 0) > 0,
            "trail": "weave" in settled and "trail" not in settled or s["stale"],
            "payforward": "weave" in settled and "payforward" not in settled,
            "tidy": "tidy" not in settled,
        }
        return [t for t in TALLY if due[t]]

    def wake(self) -> int | None:
        """When the next run starts if nothing else happens."""
        s = self.s
        if s["last"] is None or s["running"]:
            return None
        quiet = s["last"] + self.idle
        return max(s["now"], quiet, min(s["rest"].get(t, 0) for t in self.order()))

    def until(self, now: int, included: bool = True):
        """What starts up to now."""
        at = self.wake()
        if at is not None and (at < now or included and at == now):
            track = next(t for t in self.order() if at >= self.s["rest"].get(t, 0))
            if track in SERVED and SERVED[track] is None:
                self.s["settled"].append(track)
            self.s["running"], self.s["now"] = track, at
            yield at, "start", track, {}
        self.s["now"] = max(self.s["now"], now)

    def on(self, at: int, kind: str, track: str | None = None, rc: int | None = None, counts: dict | None = None):
        """What follows from one row of the log."""
        s = self.s
        at = max(at, s["now"])
        yield from self.until(at, included=False)
        counts = {k: int(v) for k, v in (counts or {}).items() if v}
        if kind == "activity":
            if self.yields and s["running"]:
                yield at, "stop", s["running"], {}
                s["running"] = None
            if any(s["done"].values()):
                yield at, "back", None, s["done"]
            s["done"], s["settled"], s["last"] = {}, [], at
        elif kind == "drafts":
            s["drafts"] = counts.get("drafts", 0)
        elif kind == "stale":
            s["stale"] = True
        elif kind == "finished" and s["running"] and track in (None, s["running"]):
            yield from self._over(at, s["running"], 0 if rc is None else int(rc), counts)
        yield from self.until(at)

    def _over(self, at: int, track: str, rc: int, counts: dict):
        s = self.s
        s["running"] = None
        if rc in (SERVED.get(track) or ()):
            s["settled"].append(track)
        if rc:
            s["rest"][track] = at + self.backoff
            yield at, "rest" if rc == NOTHING else "failed", track, {}
            return
        if track == "weave":
            counts = {"woven": 1}
            s["settled"] = [t for t in s["settled"] if t not in ("trail", "payforward")]
        for k in TALLY[track]:
            s["done"][k] = s["done"].get(k, 0) + counts.get(k, 0)
        if track == "distill":
            s["drafts"] += counts.get("drafts", 0)
        elif track == "drain":
            s["drafts"] = max(0, s["drafts"] - counts.get("poured", 0) - counts.get("tossed", 0))
            if counts.get("poured"):
                s["settled"] = [t for t in s["settled"] if t != "weave"]
        elif track == "trail":
            s["stale"] = False
        yield at, "done", track, {k: v for k, v in counts.items() if k in TALLY[track] and v}


_LOG = ["store", "ms", "kind", "track", "rc", "counts"]


def _log(log: DataFrame) -> DataFrame:
    """The log with its times as milliseconds and its kinds in order."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    counts = F.to_json("counts") if "counts" in log.columns else F.lit(None).cast("string")
    rows = log.select("store", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), "kind", kind.alias("k"), "track", F.col("rc").cast("int").alias("rc"), counts.alias("counts"))
    return rows.where("ms is not null and k > 0")


def _steps(silence: Silence, store, rows) -> list[tuple]:
    out = []
    for ms, kind, track, rc, counts in rows:
        out += silence.on(int(ms), kind, track if isinstance(track, str) else None, None if rc is None or rc != rc else int(rc), json.loads(counts) if isinstance(counts, str) else None)
    return [(store, pd.Timestamp(at, unit="ms"), action, track, dict(done)) for at, action, track, done in out]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = dict(zip(("store", "at", "action", "track", "done"), zip(*rows, strict=True), strict=True))
    return pd.DataFrame({k: pd.Series(list(v), dtype="datetime64[us]" if k == "at" else object) for k, v in columns.items()})


def replayed(log: DataFrame, until=None, idle: float = IDLE, backoff: float = BACKOFF, yields: bool = True) -> DataFrame:
    """store, at, action, track, done: what the whole log leads to, and what starts after it up to until.

    Actions: start, stop (activity came), done, rest (nothing to do), failed, back (what the silence has done). Each store's log is read in order by one task, which keeps
    nothing but the store's state.
    """
    ship(log.sparkSession)
    end = None if until is None else int(pd.Timestamp(until).timestamp() * 1000)

    def run(frames):
        store, silence, begun = None, None, False
        for frame in frames:
            out = []
            for name, rows in frame.groupby("store", sort=False, dropna=False):  # sorted, so a store's rows are together
                if not begun or name != store and not (pd.isna(name) and pd.isna(store)):
                    out += _last(silence, store)
                    store, silence, begun = name, Silence(idle, backoff, yields), True
                out += _steps(silence, store, rows[["ms", "kind", "track", "rc", "counts"]].itertuples(index=False, name=None))
            if out:
                yield _frame(out)
        if last := _last(silence, store):
            yield _frame(last)

    def _last(silence, store):
        if silence is None or end is None:
            return []
        return [(store, pd.Timestamp(at, unit="ms"), action, track, dict(done)) for at, action, track, done in silence.until(end)]

    rows = _log(log).repartition("store").sortWithinPartitions("store", "ms", "k", "track", "rc", "counts")
    return rows.select(*_LOG).mapInPandas(run, OUT)


class _Processor(StatefulProcessor):
    def __init__(self, idle: float, backoff: float, yields: bool):
        self._given = (idle, backoff, yields)

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("silence", "state string")

    def _load(self) -> Silence:
        return Silence(*self._given, state=self._state.get()[0] if self._state.exists() else None)

    def _save(self, silence: Silence) -> None:
        self._state.update((json.dumps(silence.s),))
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        at = silence.wake()
        if at is not None:
            self._handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["ms", "k", "track", "rc", "counts"], kind="stable")
        silence = self._load()
        out = _steps(silence, key[0], frame[["ms", "kind", "track", "rc", "counts"]].itertuples(index=False, name=None))
        self._save(silence)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        silence = self._load()
        out = [(key[0], pd.Timestamp(at, unit="ms"), action, track, dict(done)) for at, action, track, done in silence.until(expiredTimerInfo.getExpiryTimeInMs())]
        self._save(silence)
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def watched(log: DataFrame, late: str = "0 seconds", idle: float = IDLE, backoff: float = BACKOFF, yields: bool = True) -> DataFrame:
    """The same rows from a stream of the log: a run starts when the watermark passes its time. The state store must be RocksDB."""
    ship(log.sparkSession)
    stamped = log.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    counts = F.to_json("counts") if "counts" in log.columns else F.lit(None).cast("string")
    rows = stamped.select("store", "at", F.unix_millis("at").alias("ms"), "kind", kind.alias("k"), "track", F.col("rc").cast("int").alias("rc"), counts.alias("counts")).where("ms is not null and k > 0")
    return rows.groupBy("store").transformWithStateInPandas(_Processor(idle, backoff, yields), OUT, "Append", "EventTime")
