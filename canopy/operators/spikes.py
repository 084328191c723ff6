"""Implausible readings per source: impossible, stuck, and spikes, by a Kalman filter.

Each source's readings, in logarithms, follow a state-space model: a level that walks,
two daily harmonics, and noise. The filter forecasts every reading; the innovation over
its standard deviation, scaled by the source's own robust scatter, says how far off it
is. A flagged reading is withheld from the update. If the fourth reading in a row is
flagged, the source has moved to a new level: the three before are cleared and the
level is set anew; a run of up to three that returns is a spike. Readings are stuck
when the innovation variance of the bare values vanishes: over ``STUCK`` readings the last
value forecast the next without any error.

Scale: sources with more than ``CHUNK`` readings are cut by the rank of the reading into
equal chunks of at most ``CHUNK``, with a halo of ``HALO`` readings on both sides that is
run through but not reported, so no source is one group and a gap in time loses no
context. Stuck runs are sought in chunks of all readings first, then spikes in chunks of
those that remain usable. What is normal for a cut source is estimated over all its chunks
first: histograms of their innovations are summed, and the walk and scatter they give hold
for every chunk, as they would for the source uncut. Series are dealt to buckets of about
``BUCKET`` readings, one partition each, and all series of a bucket are filtered side by
side as numpy columns; what is in a bucket changes no result.

Defined results: null values are no readings; repeated (source, t) must be reduced
before; sources with fewer than ``LEAST`` usable readings have no spikes; a run at the
very end, without a reading after it, is no spike. Idle readings are no spikes and take
no part in the filter; only active ones (unknown: not active) can be stuck.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import placed, written

CHUNK, HALO, BUCKET, SALTS = 4096, 256, 1 << 16, 16
#: Width of the bins of the innovations' histogram, as a share: medians are within half of it.
BIN = 0.004
STUCK, RUN, LEAST = 6, 3, 8
#: Standardised innovation above which a reading is withheld, and the least scatter of a source (in logarithms).
THRESHOLD, LEAST_SCATTER = 5.5, 0.02
#: Least distance of a spike from its forecast (in logarithms, about half as much again), however quiet the source.
LEAST_EFFECT = 0.4
#: Candidate ratios of the level's walk variance to the noise variance; each source takes the one that forecasts best.
WALKS = (0.003, 0.05, 0.4)
FOUND_SCHEMA = "metric string, source string, t long, reason string"
SPREAD_SCHEMA = "metric string, source string, walk double, bin long, n long"
KEYS = ["metric", "source"]


class _Runs:
    """Flagged readings of one series since its last trusted one, in runs of like distance."""

    def __init__(self):
        self.now: list[tuple[int, float]] = []
        self.before: list[tuple[int, float]] = []

    @staticmethod
    def _near(run, e):
        """Nearer to the run's level than to the forecast."""
        mid = float(np.median([x for _, x in run]))
        return abs(e - mid) <= 0.5 * abs(mid)

    def add(self, t: int, e: float, far: bool) -> tuple[list[int], float | None]:
        """(readings found to be no spikes, the shift if the level has moved) after a reading at distance e."""
        if self.now and self._near(self.now, e):
            self.now.append((t, e))
            if far and len(self.now) <= RUN:
                return [], None
            return self._moved()
        if not far:  # back at the forecast: what was flagged stays so
            self.now, self.before = [], []
            return [], None
        if self.before and self._near(self.before, e):  # back at the run before
            self.now, self.before = [*self.before, (t, e)], []
            return self._moved() if len(self.now) > RUN else ([], None)
        self.before, self.now = self.now, [(t, e)]
        return [], None

    def _moved(self):
        cleared, shift = [t for t, _ in self.now], float(np.median([e for _, e in self.now]))
        self.now, self.before = [], []
        return cleared, shift


def _filter(y, use, h, walk, start, var, clip, final=None):
    """One pass over (series, time) arrays. Gives normalised innovations, end state, and flags if ``final``.

    ``clip`` (per series) bounds the innovations that update the state; with ``final``
    (the series' scatter) innovations beyond the threshold are withheld instead.
    """
    n, steps = y.shape
    x, p = start.copy(), var.copy()
    rest = np.arange(1, h.shape[2])
    u = np.full((n, steps), np.nan)
    flags = np.zeros((n, steps), bool) if final is not None else None
    runs: dict[int, _Runs] = {}
    open_run = np.zeros(n, bool)
    walk = np.broadcast_to(np.asarray(walk, float), n)
    for t in range(steps):
        on = use[:, t]
        if not on.any():
            continue
        ht = h[:, t]
        # forecasts over withheld readings keep their variance
        p[:, 0, 0] += np.where(on & ~open_run, walk, 0.0)
        p[:, rest, rest] += np.where(on, 1e-4, 0.0)[:, None]
        pz = np.einsum("nij,nj->ni", p, ht)
        s = np.einsum("ni,ni->n", pz, ht) + 1.0
        e = np.where(on, y[:, t] - np.einsum("ni,ni->n", x, ht), 0.0)
        root = np.sqrt(s)
        u[on, t] = (e / root)[on]
        update = on
        if final is None:
            bound = clip * root
            e = np.clip(e, -bound, bound)
        else:
            far = on & (np.abs(e) > np.maximum(THRESHOLD * final * root, LEAST_EFFECT))
            update = on & ~far
            for i in np.flatnonzero(far | (on & open_run)):
                r = runs.setdefault(i, _Runs())
                cleared, shift = r.add(t, float(e[i]), bool(far[i]))
                flags[i, t] = far[i]
                open_run[i] = bool(r.now)
                if shift is not None:
                    flags[i, cleared] = False
                    update[i] = False
                    x[i, 0] += shift
                    p[i, 0, :] = p[i, :, 0] = 0.0
                    p[i, 0, 0] = 1.0
        gain = np.where(update[:, None], pz / s[:, None], 0.0)
        x += gain * e[:, None]
        p -= gain[:, :, None] * pz[:, None, :]
    for i in np.flatnonzero(open_run):  # a run without a reading after it
        flags[i, [t for t, _ in runs[i].now]] = False
    return u, x, p, flags


def _scatter(u):
    with np.errstate(all="ignore"):
        m = 1.4826 * np.nanmedian(np.abs(u), axis=1)
    return np.where(np.isnan(m), LEAST_SCATTER, np.maximum(m, LEAST_SCATTER))


def _rows_packed(values, use):
    """Each row's used values moved to its front; the places they came from."""
    order = np.argsort(~use, axis=1, kind="stable")
    width = max(1, int(use.sum(axis=1).max()))
    return np.take_along_axis(values, order, 1)[:, :width], np.take_along_axis(use, order, 1)[:, :width], order[:, :width]


def _series(t, value, use):
    """Packed logarithms, their use, their places, design vectors, and start state, variance and rough scatter of each series."""
    yp, on, order = _rows_packed(np.log1p(np.where(use, value, 0).astype(float)), use)
    tp = np.take_along_axis(t, order, 1)
    angle = 2 * np.pi * (tp % 86_400) / 86_400
    h = np.stack([np.ones_like(angle), np.cos(angle), np.sin(angle), np.cos(2 * angle), np.sin(2 * angle)], axis=2)
    masked = np.where(on, yp, np.nan)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        first = np.nanmedian(masked[:, :9], axis=1)
        steps = np.abs(np.diff(masked, axis=1))
        rough = np.maximum(np.nan_to_num(1.4826 * np.nanmedian(steps, axis=1) / np.sqrt(2), nan=LEAST_SCATTER), LEAST_SCATTER)
    n, dims = len(yp), h.shape[2]
    var = np.zeros((n, dims, dims))
    var[:, np.arange(dims), np.arange(dims)] = np.array([4.0, 4.0, 4.0, 1.0, 1.0])
    start = np.zeros((n, dims))
    start[:, 0] = np.nan_to_num(first)
    return yp, on, order, h, start, var, rough


def _there_and_back(yp, on, h, walk, start, var, rough):
    """Forward, then back in time: innovations on the way back, and a state for the first reading."""
    u, x, p, _ = _filter(yp, on, h, walk, start, var, 3 * rough)
    u, x, _, _ = _filter(yp[:, ::-1], on[:, ::-1], h[:, ::-1], walk, x, p, 3 * _scatter(u))
    return u[:, ::-1], x


def _level(sigma, w):
    """The spread of forecasts: scatter times the mean forecast deviation of a walk."""
    return sigma * np.sqrt(1 + (w + np.sqrt(w * w + 4 * w)) / 2)


def spike_flags(t, value, use, walk=None, sigma=None):
    """Flags of spikes for (series, time) arrays; ``use`` marks readings that count.

    ``walk`` and ``sigma`` (per series) are what is normal for the source; without them they
    are estimated from the series itself.
    """
    flags = np.zeros(use.shape, bool)
    enough = use.sum(axis=1) >= (LEAST if walk is None else 1)
    if not enough.any():
        return flags
    yp, on, order, h, start, var, rough = _series(t[enough], value[enough], use[enough])
    n = len(yp)
    if walk is None:
        best, chosen, begin, walk = np.full(n, np.inf), np.zeros(n), start.copy(), np.full(n, WALKS[0])
        for w in WALKS:
            u, x = _there_and_back(yp, on, h, w, start, var, rough)
            own = _scatter(u)
            level = _level(own, w)
            better = level < best
            best, chosen = np.where(better, level, best), np.where(better, own, chosen)
            begin[better], walk[better] = x[better], w
    else:
        walk, chosen = walk[enough], sigma[enough]
        _, begin = _there_and_back(yp, on, h, walk, start, var, rough)
    _, _, _, found = _filter(yp, on, h, walk, begin, var, 3 * chosen, final=chosen)
    out = np.zeros(use[enough].shape, bool)
    np.put_along_axis(out, order, found & on, 1)
    flags[enough] = out
    return flags


def stuck_flags(value, present, active):
    """Each reading but the first where the innovation variance over ``STUCK`` non-zero active readings vanishes.

    A level that walks freely forecasts each reading by the one before, so an innovation
    is their difference and the variance of a window vanishes if no innovation in it is other than 0.
    """
    v, on, order = _rows_packed(value, present)
    act = np.take_along_axis(active, order, 1) & on & (v != 0)
    n = STUCK - 1
    out = np.zeros(value.shape, bool)
    if v.shape[1] <= n:
        return out
    still = np.zeros(v.shape, bool)  # an innovation of 0 between two active readings
    still[:, 1:] = (v[:, 1:] == v[:, :-1]) & act[:, 1:] & act[:, :-1]
    moves = np.cumsum(~still, axis=1)
    vanished = np.zeros(v.shape, bool)  # of the n innovations up to this one none is other than 0
    vanished[:, n:] = moves[:, n:] == moves[:, :-n]
    stuck = np.zeros(v.shape, bool)
    for back in range(n):
        stuck[:, : v.shape[1] - back] |= vanished[:, back:]
    np.put_along_axis(out, order, stuck & on, 1)
    return out


def _grids(pdf: pd.DataFrame):
    """The series of a bucket, those of like length together as (rows of the bucket, their places in the grid, grid maker)."""
    keys = ["metric", "source", "chunk"]
    pdf.sort_values([*keys, "t"], kind="stable", inplace=True, ignore_index=True)
    key = pdf.groupby(keys, sort=False).ngroup().to_numpy()
    pos = pdf.groupby(keys, sort=False).cumcount().to_numpy()
    lengths = np.bincount(key)
    by_length = np.argsort(lengths, kind="stable")
    for part in np.array_split(by_length, max(1, min(8, len(by_length) // 64))):
        if not len(part):
            continue
        rank = np.full(len(lengths), -1)
        rank[part] = np.arange(len(part))
        mine = rank[key] >= 0
        shape, at = (len(part), int(lengths[part].max())), (rank[key[mine]], pos[mine])

        def grid(column, kind, mine=mine, shape=shape, at=at):
            g = np.zeros(shape, kind)
            g[at] = pdf[column].to_numpy()[mine]
            return g

        present = np.zeros(shape, bool)
        present[at] = True
        yield mine, at, grid, present


def _search(table: pa.Table, stuck_runs: bool = True, spikes: bool = True) -> pa.Table:
    pdf, hits = table.to_pandas(), []
    for mine, at, grid, present in _grids(pdf):
        t, value, possible, active, idle, core = (grid(c, np.int64 if c in ("t", "value") else bool) for c in ("t", "value", "possible", "active", "idle", "core"))
        stuck = stuck_flags(value, present, active) if stuck_runs else np.zeros(present.shape, bool)
        found = [("impossible", present & ~possible), ("stuck", stuck)] if stuck_runs else []
        if spikes:
            # the source's own figures stand at each of its readings
            normal = [grid(c, float).max(axis=1) for c in ("walk", "sigma")] if "walk" in pdf else []
            found.append(("spike", spike_flags(t, value, present & possible & ~idle & ~stuck, *normal)))
        for reason, flags in found:
            hit = (flags & core)[at]
            if hit.any():
                hits.append(pdf.loc[mine, ["metric", "source", "t"]][hit].assign(reason=reason))
    out = pd.concat(hits, ignore_index=True) if hits else pd.DataFrame({"metric": [], "source": [], "t": [], "reason": []})
    return pa.table({c: pa.array(out[c].tolist(), pa.int64() if c == "t" else pa.string()) for c in out.columns})


def _bucket(table: pa.Table) -> pa.Table:
    return _search(table)


def _stuck_bucket(table: pa.Table) -> pa.Table:
    return _search(table, spikes=False)


def _spike_bucket(table: pa.Table) -> pa.Table:
    return _search(table, stuck_runs=False)


def _spread_bucket(table: pa.Table) -> pa.Table:
    """Histograms of the chunks' innovations, per series and candidate walk, over the readings a chunk reports."""
    pdf, out = table.to_pandas(), []
    for mine, at, grid, present in _grids(pdf):
        yp, on, order, h, start, var, rough = _series(grid("t", np.int64), grid("value", np.int64), present)
        core = np.take_along_axis(grid("core", bool), order, 1) & on
        names = pdf.loc[mine, ["metric", "source"]].assign(row=at[0]).drop_duplicates("row").set_index("row")
        for w in WALKS:
            u, _ = _there_and_back(yp, on, h, w, start, var, rough)
            rows, cols = np.nonzero(core)
            bins = np.floor(np.log(np.maximum(np.abs(u[rows, cols]), 1e-12)) / np.log1p(BIN)).astype(np.int64)
            out.append(pd.DataFrame({"row": rows, "bin": bins}).groupby(["row", "bin"]).size().rename("n").reset_index().join(names, on="row").assign(walk=w))
    df = pd.concat(out, ignore_index=True)[["metric", "source", "walk", "bin", "n"]]
    return pa.Table.from_pandas(df, schema=pa.schema([("metric", pa.string()), ("source", pa.string()), ("walk", pa.float64()), ("bin", pa.int64()), ("n", pa.int64())]), preserve_index=False)


def _dealt(series: DataFrame, n: int):
    """Series grouped by bucket: as many partitions as buckets, so a task holds a few buckets whatever the input."""
    buckets = max(1, n // BUCKET * 2)
    dealt = series.withColumn("bucket", F.pmod(F.xxhash64("metric", "source", "chunk"), F.lit(buckets)))
    return dealt.repartition(buckets, "bucket").groupBy("bucket")


def _found(series: DataFrame, n: int, of=_bucket) -> DataFrame:
    return _dealt(series, n).applyInArrow(of, FOUND_SCHEMA)


def _normal(chunks: DataFrame, n: int) -> DataFrame:
    """metric, source, walk, sigma: the walk that forecasts a cut source best over all its chunks, and its scatter then.

    The median innovation is read off the summed histograms, a row per bin of a source and walk.
    """
    bins = _dealt(chunks, n).applyInArrow(_spread_bucket, SPREAD_SCHEMA).groupBy(*KEYS, "walk", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*KEYS, "walk")
    half = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w)).filter(F.col("upto") * 2 >= F.col("all"))
    median = F.exp((F.min("bin") + 0.5) * F.lit(float(np.log1p(BIN))))
    sigma = half.groupBy(*KEYS, "walk").agg(F.greatest(1.4826 * median, F.lit(LEAST_SCATTER)).alias("sigma"))
    level = F.col("sigma") * F.sqrt(1 + (F.col("walk") + F.sqrt(F.col("walk") * F.col("walk") + 4 * F.col("walk"))) / 2)
    return sigma.groupBy(*KEYS).agg(F.min_by(F.struct("walk", "sigma"), F.struct(level, "walk")).alias("s")).select(*KEYS, "s.walk", "s.sigma")


def _beside(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` joined with ``per`` (a row per series), the rows of a series spread over copies of it."""
    copies = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).join(copies, [*KEYS, "__salt"]).drop("__salt")


def _chunked(long: DataFrame) -> DataFrame:
    """Each reading in its own chunk (``core``) and in those whose halo it belongs to, by its rank in its series."""
    ranked = placed(long, [*KEYS, "t"], "ranked")
    per = ranked.groupBy(*KEYS).agg(F.min("place").alias("first"), F.count("*").alias("n")).withColumn("k", F.expr(f"(n + {CHUNK - 1}) div {CHUNK}"))
    at = _beside(ranked, per).withColumn("at", F.col("place") - F.col("first"))
    at = at.withColumn("own", F.expr("at * k div n"))
    halo = F.expr(f"filter(array(own - 1, own, own + 1), c -> c >= 0 and c < k and at >= (c * n + k - 1) div k - {HALO} and at < ((c + 1) * n + k - 1) div k + {HALO})")
    out = at.withColumn("chunk", F.explode(halo))
    return out.withColumn("core", F.col("own") == F.col("chunk")).drop("place", "first", "n", "k", "at", "own")


def implausible(readings: DataFrame, n: int | None = None) -> DataFrame:
    """(metric, source, t, reason) of every impossible, stuck or spiking reading.

    ``readings`` holds source, t (epoch seconds), active, idle, and ``metrics``: an array of
    (metric, value, possible), one row per source and time. ``n`` is the number of rows,
    if known; it only sets how many buckets there are.
    """
    known = readings.filter("source is not null and t is not null").select("source", F.col("t").cast("long").alias("t"), F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("idle", F.lit(False)).alias("idle"), "metrics")
    n = known.count() if n is None else n
    hot = written(known.groupBy("source").count().filter(F.col("count") > CHUNK).select("source"), "hot")

    def series(rows):
        long = rows.select("source", "t", "active", "idle", F.explode("metrics").alias("m")).filter("m.value is not null")
        return long.select("m.metric", "source", "t", F.col("m.value").cast("long").alias("value"), F.coalesce("m.possible", F.lit(True)).alias("possible"), "active", "idle")

    whole = lambda rows: series(rows).withColumn("chunk", F.lit(0).cast("long")).withColumn("core", F.lit(True))
    if hot.isEmpty():
        return _found(whole(known), n)
    salted = hot.select("source", F.lit(True).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = known.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"], "left").drop("salt")
    split = written(spread, "split")
    long = series(split.filter("hot"))
    held = written(_found(_chunked(long), n, _stuck_bucket), "held")
    rest = long.filter("possible and not idle").join(held.filter("reason = 'stuck'"), [*KEYS, "t"], "left_anti")
    chunks = written(_chunked(rest), "chunks")
    spikes = _found(_beside(chunks, _normal(chunks, n)), n, _spike_bucket)
    return _found(whole(split.filter("hot is null")), n).unionByName(held).unionByName(spikes)


def possible(value: Column, most: Column | None, top: int) -> Column:
    """Whether a reading can be: not negative, not above ``most`` (if known), below ``top``."""
    ok = (value >= 0) & (value < F.lit(top))
    return ok if most is None else ok & (most.isNull() | (value <= most))
