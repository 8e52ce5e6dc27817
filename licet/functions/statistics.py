"""Study statistics and the cost model, on small results."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seed and repetitions of the bootstrap.
SEED, REPETITIONS = 0x6A09E667F3BCC909, 2000
GUARDS = (1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5)


def lower_quantile(df: DataFrame, by: list[str], value: str, num: int, den: int) -> DataFrame:
    """The value at index (n - 1) * num div den of the sorted values, per ``by``."""
    w = Window.partitionBy(*by)
    out = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return out.where(F.col("_i") == F.floor((F.col("_n") - 1) * num / den)).select(*by, value)


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("share", F.col("_i") / F.count(F.lit(1)).over(w)).select(*by, value, "share")


def crossover(df: DataFrame, by: list[str]) -> DataFrame:
    """The least width at which the fused plan wins (null: never)."""
    return df.groupBy(*by).agg(F.min(F.when(F.col("fused") < F.col("selective"), F.col("rows"))).alias("crossover_rows"))


def guarded_choice(guard: float):
    return F.when(F.col("predicted_fused") * guard < F.col("predicted_selective"), "fused").otherwise("selective")


def guard_regret(df: DataFrame, guards=GUARDS) -> DataFrame:
    """Mean regret of each guard on (predicted_*, fused, selective)."""
    g = df.withColumn("guard", F.explode(F.array(*(F.lit(float(x)) for x in guards))))
    time = F.when(F.col("predicted_fused") * F.col("guard") < F.col("predicted_selective"), F.col("fused")).otherwise(F.col("selective"))
    return g.groupBy("guard").agg(F.avg(time / F.least("fused", "selective")).alias("regret"))


def best_guard(df: DataFrame, guards=GUARDS) -> float:
    return guard_regret(df, guards).orderBy("regret", F.desc("guard")).first().guard


def median(values) -> float:
    v = sorted(values)
    n = len(v)
    return float(v[n // 2]) if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


def xorshift(state: int) -> int:
    state ^= state << 13 & 0xFFFFFFFFFFFFFFFF
    state ^= state >> 7
    return state ^ (state << 17 & 0xFFFFFFFFFFFFFFFF)


def _states(seed: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    for i in range(n):
        seed = xorshift(seed)
        out[i] = seed
    return out


def _interval(medians: np.ndarray, repetitions: int) -> tuple[float, float]:
    medians = np.sort(medians)
    return float(medians[int(0.025 * repetitions)]), float(medians[int(0.975 * repetitions)])


def bootstrap_median(values, seed: int = SEED, repetitions: int = REPETITIONS) -> tuple[float, float]:
    """2.5 and 97.5 % points of resampled medians."""
    v = np.array(list(values), dtype=float)
    pick = (_states(seed, repetitions * len(v)) % np.uint64(len(v))).astype(int).reshape(repetitions, len(v))
    return _interval(np.median(v[pick], axis=1), repetitions)


def cluster_bootstrap_median(families: dict[str, list[float]], seed: int = SEED, repetitions: int = REPETITIONS) -> tuple[float, float]:
    """Families are drawn, then sources inside each."""
    names, state, out = sorted(families), seed, []
    for _ in range(repetitions):
        pick = []
        for _ in names:
            state = xorshift(state)
            inside = families[names[state % len(names)]]
            for _ in inside:
                state = xorshift(state)
                pick.append(inside[state % len(inside)])
        out.append(median(pick))
    return _interval(np.array(out), repetitions)


def sign_test(wins: int, n: int) -> float:
    """Exact upper tail of the binomial at 1/2."""
    return sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n


def wilcoxon_exact(ratios) -> float:
    """Two-sided exact signed-rank test on log ratios; ties and parity are an error."""
    logs = [math.log(r) for r in ratios]
    size = sorted(abs(x) for x in logs)
    if any(x == 0 for x in size) or any(a == b for a, b in zip(size, size[1:])):
        raise ValueError("ties or parity have no exact null distribution here")
    rank = {a: i + 1 for i, a in enumerate(size)}
    plus, n = sum(rank[abs(x)] for x in logs if x > 0), len(logs)
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
    low = min(plus, n * (n + 1) // 2 - plus)
    return min(1.0, 2 * sum(ways[: low + 1]) / 2**n)


def fit_cost(features: np.ndarray, nanoseconds: np.ndarray, ridge: float = 1e-6) -> dict:
    """Ridge regression of log time on standardised features (population deviation, 1 at least; the constant has no ridge)."""
    x = np.asarray(features, float)
    if len(x) < x.shape[1] + 1:
        raise ValueError("too few rows")
    mean, scale = x.mean(0), x.std(0)
    scale = np.maximum(scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    a = z.T @ z
    a[np.diag_indices_from(a)] += [0.0, *([ridge] * (len(a) - 1))]
    w = np.linalg.solve(a, z.T @ np.log(nanoseconds))
    return {"mean": mean, "scale": scale, "weights": w}


def fit_cost_frame(df: DataFrame, features: list[str], nanoseconds: str, ridge: float = 1e-6) -> dict:
    """:func:`fit_cost` on a DataFrame of any length: two aggregates give moments and the normal matrix."""
    k = len(features)
    r = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    if r.n < k + 1:
        raise ValueError("too few rows")
    mean = np.array([r[f"m{i}"] for i in range(k)], float)
    scale = np.array([r[f"s{i}"] for i in range(k)], float)
    scale = np.maximum(scale, 1.0)
    z = [F.lit(1.0)] + [(F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, mean, scale)]
    y = F.log(F.col(nanoseconds).cast("double"))
    cells = [F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    r = df.agg(*cells, *(F.sum(z[i] * y).alias(f"b{i}") for i in range(k + 1))).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    a[np.diag_indices_from(a)] += [0.0, *([ridge] * (len(a) - 1))]
    return {"mean": mean, "scale": scale, "weights": np.linalg.solve(a, np.array([r[f"b{i}"] for i in range(k + 1)], float))}


def predict_cost(model: dict, features: np.ndarray) -> np.ndarray:
    z = (np.asarray(features, float) - model["mean"]) / model["scale"]
    return np.exp(model["weights"][0] + z @ model["weights"][1:])


def regret_summary(df: DataFrame) -> DataFrame:
    """Accuracy and mean, median, 95th (index n * 95 div 100) and largest regret of (regret, right)."""
    from ..operators.rows import at_ranks

    n = df.count()
    whole = df.agg(F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg("regret").alias("mean"), F.percentile("regret", 0.5).alias("median"), F.max("regret").alias("max"))
    at = at_ranks(df.select("regret"), "regret", [min(n - 1, n * 95 // 100)]).agg(F.max("regret").alias("p95"))
    return whole.join(at, F.lit(True))


def rollup(df: DataFrame, levels: list[str], metrics: list[str]) -> DataFrame:
    """Medians per source, then medians of these per class: ``levels`` are class and source."""
    top, source = levels
    per = df.groupBy(top, source).agg(F.count(F.lit(1)).alias("cells"), *(F.percentile(m, 0.5).alias(m) for m in metrics))
    return per.groupBy(top).agg(F.count(F.lit(1)).alias("sources"), F.sum("cells").alias("cells"), *(F.percentile(m, 0.5).alias(m) for m in metrics))


def preflight_free(selected, rows, file_bytes, metadata_bytes, frames, structures, fused: bool):
    """What a plan costs before any of it is read: rows to decode, bytes and transfer operations (``structures``: how many kinds of index it has)."""
    payload = F.greatest(file_bytes - metadata_bytes, F.lit(0))
    partial = metadata_bytes + F.ceil(payload * selected / rows)
    whole = F.lit(fused) | (frames > 0)
    return {
        "selected_rows": selected, "decoded_rows": rows if fused else selected, "delivered_bytes": F.when(whole, file_bytes).otherwise(partial),
        "transfer_operations": F.lit(1) if fused else 1 + frames + structures, "frames_decoded": frames,
    }


#: The features of the cost model.
FEATURES = ("selected_rows", "decoded_rows", "delivered_bytes", "transfer_operations", "frames_decoded", "restart_entries", "rle_runs", "dictionary_entries", "patch_count", "nullable_nodes")
