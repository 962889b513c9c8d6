"""Isolation scores of routes.

A trial draws a sample of the trips between O and D, then picks random edges of the tested route one
after the other and keeps only the sampled trips that use every picked edge, until at most ``end_size``
are left.  A route that isolates quickly is unusual.

The random picks of a trial are fixed by a hash, and the trips of a sample that use an edge are a bit mask.
The trips left after k picks are the AND of the masks of the edges picked so far, so all trials of a route run
inside its row, over one array of masks per edge.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash60
from ..functions.paths import path_text, slice_sites
from ..session import spread

OD = ["o_id", "d_id"]
_WORD = 64
_BUCKETS = 4096

# Fixed value: the Euler constant as the score formula uses it.
EULER = 0.57721566


@dataclass(frozen=True)
class IsolationParams:
    """Trials per route, trips per sample, most picks per trial, and when a trip set counts as isolated."""

    trials: int = 100
    sample: int = 256
    max_steps: int = 60
    end_size: int = 3
    seed: int = 0

    @property
    def words(self) -> int:
        return math.ceil(self.sample / _WORD)


def _numbered(pool: DataFrame, p: IsolationParams) -> DataFrame:
    """(o_id, d_id, traj_id, pos): the trips of every pair numbered from 0.

    A pair's trips are dealt into ``_BUCKETS`` by hash, numbered inside each, and shifted by the sizes of the buckets
    before it, so a hot pair is not one task.
    """
    bucket = hash60(F.lit(p.seed), F.lit("n"), F.col("traj_id")) % _BUCKETS
    keyed = pool.select(*OD, "traj_id", bucket.alias("_bucket"))
    before = Window.partitionBy(*OD).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*OD, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(*OD, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*OD, "_bucket").orderBy("traj_id")
    ranked = keyed.withColumn("_rn", F.row_number().over(inside))
    return ranked.join(offsets, [*OD, "_bucket"]).select(*OD, "traj_id", (F.col("_off") + F.col("_rn") - 1).alias("pos"))


def draw_samples(pool: DataFrame, p: IsolationParams) -> DataFrame:
    """(o_id, d_id, trial, traj_id, idx): per pair and trial, ``sample`` different trips of the pool (B1).

    Positions are drawn inside one row per pair and trial by Floyd's method: for j from N - n to N - 1 a random position
    up to j is taken, or j itself where that one is taken already; every sample is equally likely.  So rows grow with
    pairs x trials x ``sample`` whatever the pool; a smaller pool is taken whole.
    """
    sizes = pool.groupBy(*OD).agg(F.count(F.lit(1)).alias("_size"))
    trial = F.explode(F.sequence(F.lit(0), F.lit(p.trials - 1))).alias("trial")
    rows = spread(sizes.select(*OD, "_size", trial), *OD, "trial")
    first = F.greatest(F.col("_size") - p.sample, F.lit(0).cast("bigint"))

    def step(j: Column) -> Column:
        return F.struct(j.alias("j"), (hash60(F.lit(p.seed), F.lit("s"), *map(F.col, [*OD, "trial"]), j) % (j + 1)).alias("t"))

    drawn = F.aggregate(
        F.transform(F.sequence(first, F.col("_size") - 1), step),
        F.array().cast("array<bigint>"),
        lambda taken, x: F.array_append(taken, F.when(F.array_contains(taken, x["t"]), x["j"]).otherwise(x["t"])),
    )
    picks = rows.select(*OD, "trial", F.posexplode(drawn).alias("idx", "pos"))
    return picks.join(_numbered(pool, p), [*OD, "pos"]).select(*OD, "trial", "traj_id", "idx")


def sample_masks(samples: DataFrame, postings: DataFrame, routes: DataFrame, p: IsolationParams) -> DataFrame:
    """(o_id, d_id, edge_id, masks): which sampled trips use the edge anywhere, ``words`` longs for each trial.

    Only edges of the pair's own routes can be picked, so only these have masks (J13).
    """
    uses = postings.select(F.col("key_id").alias("edge_id"), "traj_id")
    needed = routes.select(*OD, F.explode("edges").alias("edge_id")).distinct()
    used = samples.join(uses, "traj_id").join(needed, [*OD, "edge_id"], "left_semi").select(*OD, "edge_id", "trial", "idx")
    # every trial has its place, also where no sampled trip uses the edge
    trial = F.explode(F.sequence(F.lit(0), F.lit(p.trials - 1))).alias("trial")
    unused = needed.select(*OD, "edge_id", trial, F.lit(None).cast("int").alias("idx"))
    bit = F.expr(f"shiftleft(1L, cast(idx % {_WORD} AS int))")
    words = [
        F.bit_or(F.when(F.floor(F.col("idx") / _WORD) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{i}")
        for i in range(p.words)
    ]
    per_trial = used.unionByName(unused).groupBy(*OD, "edge_id", "trial").agg(*words)
    packed = F.struct("trial", F.array(*[f"m{i}" for i in range(p.words)]).alias("m"))
    return per_trial.groupBy(*OD, "edge_id").agg(F.sort_array(F.collect_list(packed)).alias("_l")).select(
        *OD, "edge_id", F.flatten("_l.m").alias("masks")
    )


def _trial_counts(routes: DataFrame, pool: DataFrame, postings: DataFrame, p: IsolationParams) -> DataFrame:
    """(o_id, d_id, route_id, counts): the picks of each trial, in one row per route.

    A route meets the masks of its different edges, all trials of an edge in one array.  The trials then run inside the row:
    pick k takes the edge at position hash % length and the trips left are the AND of the masks so far, until few
    are left.  Nothing of the size routes x trials is built.
    """
    masks = sample_masks(draw_samples(pool, p), postings, routes, p)
    own = F.posexplode(F.array_distinct("edges")).alias("_site", "edge_id")
    met = spread(routes.select(*OD, "route_id", own).join(masks, [*OD, "edge_id"]), *OD, "route_id")
    sets = met.groupBy(*OD, "route_id").agg(F.sort_array(F.collect_list(F.struct("_site", "masks"))).alias("_l"))
    sets = sets.select(*OD, "route_id", F.col("_l.masks").alias("_masks"))
    fixed = F.concat_ws("|", F.lit(str(p.seed)), F.lit("p"), *[F.col(c).cast("string") for c in OD], F.md5(path_text(F.col("edges"))))
    distinct = F.array_distinct("edges")
    at = F.transform("edges", lambda e: (F.array_position(distinct, e) - 1).cast("int"))
    # what every pick needs is made before the exchange: behind it, the optimizer would make it anew for each pick
    routes = spread(routes.select(*OD, "route_id", F.size("edges").alias("_n"), fixed.alias("_fixed"), at.alias("_at")), *OD, "route_id")
    rows = sets.join(routes, [*OD, "route_id"])
    names = [f"m{i}" for i in range(p.words)]
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("k"), *[F.lit(-1).cast("bigint").alias(m) for m in names])

    def few(s: Column) -> Column:
        return sum((F.bit_count(s[m]) for m in names), F.lit(0)) <= p.end_size

    def picked(t: Column, k: Column) -> Column:
        return F.get("_at", (hash60(F.col("_fixed"), t, k) % F.col("_n")).cast("int"))

    def step(t: Column, s: Column, k: Column) -> Column:
        # the one-element array binds the pick, which is needed for every word
        def narrowed(s: Column, at: Column) -> Column:
            both = [s[m].bitwiseAND(F.get(F.get("_masks", at), t * p.words + i)).alias(m) for i, m in enumerate(names)]
            return F.struct(F.lit(True).alias("open"), k.alias("k"), *both)

        closed = F.struct(F.lit(False).alias("open"), s["k"].alias("k"), *[s[m].alias(m) for m in names])
        again = F.aggregate(F.array(picked(t, k)), s, narrowed)
        return F.when(~s["open"], s).when((s["k"] > 0) & few(s), closed).otherwise(again)

    def trial(t: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(p.max_steps))
        return F.aggregate(steps, start, lambda s, k: step(t, s, k), lambda s: F.when(few(s), s["k"]).otherwise(p.max_steps).cast("bigint"))

    return rows.select(*OD, "route_id", F.transform(F.sequence(F.lit(0), F.lit(p.trials - 1)), trial).alias("counts"))


def isolation_counts(routes: DataFrame, pool: DataFrame, postings: DataFrame, p: IsolationParams) -> DataFrame:
    """(o_id, d_id, route_id, trial, cnt): picks until at most ``end_size`` sampled trips are left (B2).

    ``routes`` are merged routes (route_id unique within a pair), ``pool`` the trips (o_id, d_id, traj_id)
    to sample from, ``postings`` the edge index of whole trips.
    """
    return _trial_counts(routes, pool, postings, p).select(*OD, "route_id", F.posexplode("counts").alias("trial", "cnt"))


def expected_depth(n: Column) -> Column:
    """c(n): the mean number of picks in a random binary search tree of n; NULL below 2."""
    n = n.cast("double")
    harmonic = F.log(n - 1) + F.lit(EULER)
    return F.when(n >= 2, 2 * harmonic - 2 * (n - 1) / n)


def anomaly_scores(routes: DataFrame, pool: DataFrame, postings: DataFrame, p: IsolationParams) -> DataFrame:
    """``routes`` plus ``score`` = 2^(-mean(cnt) / c(n)), near 1 for unusual routes.

    n is the sample size really drawn, the smaller of ``sample`` and the pair's pool.
    """
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    mean = _trial_counts(routes, pool, postings, p).select(*OD, "route_id", (total / F.size("counts")).alias("_mean"))
    sizes = pool.groupBy(*OD).agg(F.least(F.count(F.lit(1)), F.lit(p.sample)).alias("_n"))
    score = F.pow(F.lit(2.0), -(F.col("_mean") / expected_depth(F.col("_n"))))
    return (
        routes.join(mean, [*OD, "route_id"])
        .join(sizes, OD)
        .select(*routes.columns, score.alias("score"))
    )


def scored_routes_input(packed: DataFrame, located: DataFrame, cap: int | None = None) -> DataFrame:
    """Merged routes to score: each located trip's part from s_site to e_site.

    ``packed`` has traj_id and edges; ``located`` is the output of ``od_by_edge_index``.  Where ``cap`` is given,
    parts of that many edges or more are left out of the routes, but their trips stay in the pool.
    """
    part = slice_sites(F.col("edges"), F.col("s_site"), F.col("e_site"))
    parts = located.join(packed.select("traj_id", "edges"), "traj_id").select(*OD, "traj_id", part.alias("edges"))
    if cap is not None:
        parts = parts.where(F.size("edges") < cap)
    return parts.groupBy(*OD, "edges").agg(
        F.min("traj_id").alias("route_id"), F.count(F.lit(1)).alias("freq")
    )
