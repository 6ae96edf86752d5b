"""Decoders over class probabilities, many nights at a time.

Nights of an Arrow batch are taken in blocks and padded to one (nights, windows, classes) array. Recurrences
step once per window for all nights together; runs are handled as run-length arrays.
Bounded by the windows of a night and ``BLOCK``, however many nights a batch has.

Transitions, starts and position priors are fixed arrays or the name of a column that holds the
flattened array of the window's night, such as parameters learned without its fold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.operators.nights import NIGHT

TINY = 1e-10
AWAKE, LIGHT, DEEP, REM = range(4)
# The shortest runs of deep and REM sleep in windows.
FLOORS = {DEEP: 4, REM: 3}
# The range of awake gains, the largest awake share and the tolerance of the quota search.
GAINS, LARGEST_SHARE, CLOSE = (0.3, 40.0), 0.6, 0.01
QUOTA_STEPS, LIGHT_GAIN = 14, 0.8
# Padded windows of the nights decoded together.
BLOCK = 100_000


Table = np.ndarray | str


class Nights:
    """Padded nights: ``p`` (nights, windows, classes), ``x`` further columns, ``used`` marks real windows.

    ``probabilities`` and ``columns`` have a flat array per night, its windows one after the other.
    """

    def __init__(self, sizes: np.ndarray, probabilities: pd.Series, columns: pd.Series, tables: dict[str, pd.Series] | None = None):
        self.used = np.arange(sizes.max(initial=0)) < sizes[:, None]
        self.p, self.x = (self._filled(s) for s in (probabilities, columns))
        self.tables = {name: np.array([np.asarray(r, float) for r in t]).reshape(len(sizes), -1) for name, t in (tables or {}).items()}

    def table(self, value: Table, *shape: int) -> np.ndarray:
        """A fixed array as it is, a named one as (nights, *shape)."""
        return self.tables[value].reshape(len(self.used), *shape) if isinstance(value, str) else np.asarray(value)

    def _filled(self, lists: pd.Series) -> np.ndarray:
        n = int(self.used.sum())
        flat = np.concatenate([np.asarray(night, float) for night in lists]).reshape(n, -1) if n else np.zeros((0, 1))
        out = np.zeros((*self.used.shape, flat.shape[1]))
        out[self.used] = flat
        return out

    def lists(self, values: np.ndarray) -> list:
        return [v[u].tolist() for v, u in zip(values, self.used)]


def blocks(sizes: np.ndarray, most: int) -> list[slice]:
    """Runs of neighbouring nights that have at most ``most`` windows together when padded; a longer night stands alone."""
    out, start, longest = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and max(longest, n) * (i + 1 - start) > most:
            out.append(slice(start, i))
            start, longest = i, 0
        longest = max(longest, n)
    return out + [slice(start, len(sizes))] if len(sizes) else out


def named(*tables: Table) -> list[str]:
    return [t for t in tables if isinstance(t, str)]


def shares(p: np.ndarray) -> np.ndarray:
    return p / np.maximum(p.sum(axis=-1, keepdims=True), TINY)


def logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, TINY, 1.0))


def smoothed(p: np.ndarray, weight: float, lookback: int = 3) -> np.ndarray:
    """``b[t] = (1 - weight) p[t] + weight mean(b[t - lookback .. t - 1])``, then rows as shares."""
    out = np.empty_like(p)
    for t in range(p.shape[1]):
        past = out[:, max(0, t - lookback) : t]
        out[:, t] = p[:, t] if t == 0 else (1 - weight) * p[:, t] + weight * past.mean(axis=1)
    return shares(out)


def best_paths(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Most likely state sequences; ``emit``, ``trans`` and ``start`` are logarithms, used windows come first."""
    nights, windows, k = emit.shape
    origin = np.broadcast_to(np.arange(k), (nights, windows, k)).copy()
    score = emit[:, 0] + start if windows else None
    for t in range(1, windows):
        reach = score[:, :, None] + trans
        live = used[:, t]
        origin[live, t] = reach.argmax(axis=1)[live]
        score = np.where(live[:, None], reach.max(axis=1) + emit[:, t], score)
    states = np.zeros((nights, windows), int)
    every = np.arange(nights)
    if windows:
        states[:, -1] = score.argmax(axis=1)
    for t in range(windows - 1, 0, -1):
        states[:, t - 1] = origin[every, t, states[:, t]]
    return states


def lifted(states: np.ndarray, used: np.ndarray, floors: dict[int, int], agree: bool, fallback: int) -> np.ndarray:
    """Runs of a state shorter than its floor take their neighbours' state.

    With ``agree`` both neighbours must be of one state, else the fallback is taken; without it
    the one before counts. A night's border counts as the fallback.
    """
    border = -1
    flat = np.full((states.shape[0], states.shape[1] + 1), border)
    flat[:, :-1][used] = states[used]
    flat = flat.ravel()
    for state, least in floors.items():
        opens = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))[: len(flat)]
        label, size = flat[opens], np.diff(np.append(opens, len(flat)))
        sides = [np.append(border, label[:-1]), np.append(label[1:], border)]
        before, after = (np.where(s == border, fallback, s) for s in sides)
        short = (label == state) & (size < least)
        label = np.where(short, np.where((before == after) | (not agree), before, fallback), label)
        flat = np.repeat(label, size)
    return flat.reshape(len(states), -1)[:, :-1]


def decoded(df: DataFrame, decode: Callable[[Nights], np.ndarray], columns: list[str] | None = None, k: int = 4,
            keys: list[str] = NIGHT, out: str = "state", kind: T.DataType | None = None, tables: list[str] | None = None) -> DataFrame:
    """One row per window with ``decode``'s value for it; ``columns`` become ``Nights.x``, ``tables`` are array columns
    that hold one value for a night and become ``Nights.tables``."""
    tables = tables or []

    @F.pandas_udf(T.ArrayType(kind or T.IntegerType()))
    def run(count: pd.Series, probabilities: pd.Series, further: pd.Series, *more: pd.Series) -> pd.Series:
        sizes, out = count.to_numpy(int), []
        for b in blocks(sizes, BLOCK):
            nights = Nights(sizes[b], probabilities.iloc[b], further.iloc[b], {t: m.iloc[b] for t, m in zip(tables, more)})
            out += nights.lists(decode(nights))
        return pd.Series(out, dtype=object)

    window = F.struct(
        "win", F.array(*[F.col(f"p{i}").cast("double") for i in range(k)]).alias("p"),
        F.array(*[F.col(c).cast("double") for c in (columns or ["win"])]).alias("x"),
    )
    nights = df.groupBy(*keys).agg(F.sort_array(F.collect_list(window)).alias("_w"), *[F.first(t).alias(t) for t in tables])
    values = nights.select(*keys, F.arrays_zip(F.col("_w.win").alias("win"), run(F.size("_w"), F.flatten("_w.p"), F.flatten("_w.x"), *tables).alias(out)).alias("_v"))
    return values.select(*keys, F.explode("_v").alias("_v")).select(*keys, F.col("_v")["win"].alias("win"), F.col("_v")[out].alias(out))


def viterbi(df: DataFrame, trans: Table, init: Table | None, temperature: float = 1.0, blend: float = 0.0,
            keys: list[str] = NIGHT) -> DataFrame:
    """Viterbi over ``p0..``; ``trans`` and ``init`` are probabilities of few classes.

    Without ``init`` a night starts with the mean of its own (blended) probabilities.
    """

    def decode(n: Nights) -> np.ndarray:
        p = smoothed(n.p, blend) if blend > 0 else n.p
        k = p.shape[-1]
        mean = (p * n.used[..., None]).sum(axis=1) / np.maximum(n.used.sum(axis=1), 1)[:, None]
        start = mean if init is None else n.table(init, k)
        return best_paths(logs(p) / temperature, logs(n.table(trans, k, k)), logs(start), n.used)

    k = 4 if isinstance(init, str) or init is None else len(init)
    return decoded(df, decode, k=k, keys=keys, tables=named(trans, init))


def viterbi_log(df: DataFrame, log_trans: np.ndarray, log_init: np.ndarray, blend: float = 0.2,
                keys: list[str] = NIGHT, temperature: float = 1.0) -> DataFrame:
    """Viterbi with given logarithms, for matrices with forbidden transitions."""
    log_trans, log_init = np.asarray(log_trans), np.asarray(log_init)

    def decode(n: Nights) -> np.ndarray:
        p = smoothed(n.p, blend) if blend > 0 else n.p
        return best_paths(logs(p) / temperature, log_trans, log_init, n.used)

    return decoded(df, decode, k=len(log_init), keys=keys)


def context_blend(df: DataFrame, alpha: float = 0.2, lookback: int = 3, keys: list[str] = NIGHT) -> DataFrame:
    """Each window's probabilities mixed with the mean of the previous mixed ones."""
    rows = decoded(df, lambda n: smoothed(n.p, alpha, lookback), keys=keys, out="_p", kind=T.ArrayType(T.DoubleType()))
    return rows.select(*keys, "win", *[F.col("_p")[i].alias(f"p{i}") for i in range(4)])


def _prior_power(n: Nights, fraction: np.ndarray, prior: Table, alpha: float) -> np.ndarray:
    """The position prior's row of each window, raised to ``alpha``."""
    prior = n.table(prior, -1, 4)
    bins = prior.shape[-2]
    at = np.clip((fraction * bins).astype(int), 0, bins - 1)
    return (prior[at] if prior.ndim == 2 else np.take_along_axis(prior, at[..., None], 1)) ** alpha


def cascade_decode(df: DataFrame, tau_awake: float, tau_rem: float, prior: Table, log_trans: Table,
                   log_init: Table, alpha: float = 0.6, keys: list[str] = NIGHT) -> DataFrame:
    """Awake gate, then REM gate, the rest light or deep by a two-state Viterbi."""

    def decode(n: Nights) -> np.ndarray:
        fraction, p_awake, p_rem = np.moveaxis(n.x, -1, 0)
        gated = np.select([p_awake >= tau_awake, p_rem >= tau_rem], [AWAKE, REM], border := -1)
        open_ = n.used & (gated == border)
        # the windows left open move to the front of their night and back again
        order = np.argsort(~open_, axis=1, kind="stable")
        front = np.take_along_axis(open_, order, 1)
        post = shares(shares(n.p[..., LIGHT : DEEP + 1]) * _prior_power(n, fraction, prior, alpha)[..., LIGHT : DEEP + 1])
        moved = smoothed(np.take_along_axis(post, order[..., None], 1), 0.2)
        calm = LIGHT + best_paths(logs(moved), n.table(log_trans, 2, 2), n.table(log_init, 2), front)
        back = np.empty_like(calm)
        np.put_along_axis(back, order, calm, 1)
        return lifted(np.where(open_, back, gated), n.used, FLOORS, False, LIGHT)

    return decoded(df, decode, ["fraction_of_night", "p_awake", "p_rem"], keys=keys, tables=named(prior, log_trans, log_init))


def hierarchical_decode(df: DataFrame, tau: float, prior: Table, log_trans: Table, log_init: Table,
                        gate_weight: float = 0.6, alpha: float = 0.6, min_run: int = 1, keys: list[str] = NIGHT) -> DataFrame:
    """Light, deep and REM by a three-state Viterbi; the awake gate overrides."""

    def decode(n: Nights) -> np.ndarray:
        fraction, p_awake, p_rem = np.moveaxis(n.x, -1, 0)
        asleep = n.p[..., LIGHT:] * [1.0, 1.0, 1 - gate_weight] + p_rem[..., None] * [0.0, 0.0, gate_weight]
        post = smoothed(shares(shares(asleep) * _prior_power(n, fraction, prior, alpha)[..., LIGHT:]), 0.2)
        stages = LIGHT + best_paths(logs(post), n.table(log_trans, 3, 3), n.table(log_init, 3), n.used)
        stages = lifted(stages, n.used, FLOORS, True, LIGHT)
        awake = (p_awake >= tau).astype(int)
        if min_run > 1:
            awake = lifted(awake, n.used, {1: min_run}, True, 0)
        return np.where(awake == 1, AWAKE, stages)

    return decoded(df, decode, ["fraction_of_night", "p_awake", "p_rem"], keys=keys, tables=named(prior, log_trans, log_init))


def gated_posterior(n: Nights, prior: Table, gate_weight: float, alpha: float) -> np.ndarray:
    """Class probabilities with both gates mixed in, times the position prior; ``x`` begins with fraction and gates."""
    fraction, p_awake, p_rem = np.moveaxis(n.x[..., :3], -1, 0)
    mix = np.array([gate_weight, 0.0, 0.0, gate_weight])
    gates = np.stack([p_awake, np.zeros_like(p_awake), np.zeros_like(p_awake), p_rem], axis=-1)
    return shares((1 - mix) * n.p + mix * gates) * _prior_power(n, fraction, prior, alpha)


def gain_decode(df: DataFrame, gains: list[str], prior: Table, log_trans: Table, log_init: Table, gate_weight: float = 0.6,
                alpha: float = 0.6, keys: list[str] = NIGHT) -> DataFrame:
    """Viterbi of the gated posterior under class gains (four columns, one value for a night), then the floors."""

    def decode(n: Nights) -> np.ndarray:
        p = smoothed(shares(gated_posterior(n, prior, gate_weight, alpha) * n.x[..., 3:]), 0.2)
        return lifted(best_paths(logs(p), n.table(log_trans, 4, 4), n.table(log_init, 4), n.used), n.used, FLOORS, True, LIGHT)

    return decoded(df, decode, ["fraction_of_night", "p_awake", "p_rem", *gains], keys=keys, tables=named(prior, log_trans, log_init))


def quota_decode(df: DataFrame, prior: Table, log_trans: Table, log_init: Table, target: str = "awake_target",
                 gate_weight: float = 0.6, alpha: float = 0.6, keys: list[str] = NIGHT) -> DataFrame:
    """Bisection (on a logarithmic scale) of each night's awake gain until the decoded awake share meets its target.

    All nights of a batch are bisected side by side; a night that is close enough rests.
    """

    def decode(n: Nights) -> np.ndarray:
        post = gated_posterior(n, prior, gate_weight, alpha)
        trans, start = n.table(log_trans, 4, 4), n.table(log_init, 4)
        goal = np.clip(n.x[:, 0, 3], 0.0, LARGEST_SHARE)
        bounds = np.log(np.tile(GAINS, (len(goal), 1)))
        states, active = np.zeros(n.used.shape, int), np.arange(len(goal))
        for _ in range(QUOTA_STEPS):
            if not len(active):
                break
            middle = bounds[active].mean(axis=1)
            gain = np.ones((len(active), 4))
            gain[:, AWAKE], gain[:, LIGHT] = np.exp(middle), LIGHT_GAIN
            used = n.used[active]
            p = smoothed(shares(post[active] * gain[:, None, :]), 0.2)
            own = [t[active] if isinstance(name, str) else t for t, name in ((trans, log_trans), (start, log_init))]
            states[active] = lifted(best_paths(logs(p), *own, used), used, FLOORS, True, LIGHT)
            share = ((states[active] == AWAKE) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
            bounds[active, (share >= goal[active]).astype(int)] = middle
            active = active[np.abs(share - goal[active]) >= CLOSE]
        return states

    return decoded(df, decode, ["fraction_of_night", "p_awake", "p_rem", target], keys=keys, tables=named(prior, log_trans, log_init))
