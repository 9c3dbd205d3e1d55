"""Power planner: closed-form planning items, run where the plans are.

Items come from the shredded plans; each is a few numbers, so a plan table is planned by an Arrow map
without a shuffle. An item that lacks what its type needs gives a row with ``problem`` and null results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import dist
from auditloom.operators.drift import parse_object

MAX_N = 1_000_000


def t_power(ncp: float, df: float, alpha: float, alternative: str) -> float:
    """Power of a t test with a noncentral alternative."""
    if alternative == "two-sided":
        c = dist.t_ppf(1 - alpha / 2, df)
        return 1 - dist.nct_cdf(c, df, ncp) + dist.nct_cdf(-c, df, ncp)
    c = dist.t_ppf(1 - alpha, df)
    return 1 - dist.nct_cdf(c, df, ncp) if alternative == "greater" else dist.nct_cdf(-c, df, ncp)


def contrast_power(effect: float, terms: list[tuple[float, float, float]], alpha: float, alternative: str = "two-sided") -> float:
    """Welch contrast of (weight, sd, n) terms."""
    parts = [(w * w * s * s / n, n) for w, s, n in terms]
    var = sum(v for v, _ in parts)
    df = var * var / sum(v * v / (n - 1) for v, n in parts)
    return t_power(effect / math.sqrt(var), df, alpha, alternative)


def welch_power(diff: float, sd_a: float, sd_b: float, n_a: float, n_b: float, alpha: float, alternative: str = "two-sided") -> float:
    return contrast_power(diff, [(-1.0, sd_a, n_a), (1.0, sd_b, n_b)], alpha, alternative)


def paired_power(diff: float, sd: float, n: float, alpha: float, alternative: str = "two-sided") -> float:
    return t_power(diff / (sd / math.sqrt(n)), n - 1, alpha, alternative)


def two_proportion_power(p_a: float, p_b: float, n_a: float, n_b: float, alpha: float, alternative: str = "two-sided") -> float:
    """Normal test with a pooled null and an unpooled alternative."""
    pool = (p_a * n_a + p_b * n_b) / (n_a + n_b)
    s0 = math.sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b))
    s1 = math.sqrt(p_a * (1 - p_a) / n_a + p_b * (1 - p_b) / n_b)
    d = p_b - p_a
    if alternative == "two-sided":
        z = dist.norm_ppf(1 - alpha / 2)
        return dist.norm_cdf((d - z * s0) / s1) + dist.norm_cdf((-d - z * s0) / s1)
    z = dist.norm_ppf(1 - alpha)
    return dist.norm_cdf(((d if alternative == "greater" else -d) - z * s0) / s1)


def sparsity(p_a: float, p_b: float, n_a: float, n_b: float) -> str:
    """How far the normal approximation may be trusted, by the smallest expected count."""
    least = min(x for p, n in ((p_a, n_a), (p_b, n_b)) for x in (p * n, (1 - p) * n))
    return "poor" if least < 1 else "caution" if least < 5 else "ok"


def least_n(power: Callable[[int], float], target: float, low: int = 2) -> int | None:
    """The smallest n with enough power: doubling, then bisection; None beyond the cap."""
    high = low
    while power(high) < target:
        if high >= MAX_N:
            return None
        low, high = high, min(high * 2, MAX_N)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if power(mid) >= target else (mid, high)
    return low if power(low) >= target else high


def least_effect(power: Callable[[float], float], target: float, scale: float) -> float | None:
    """The smallest positive effect with enough power, by bracketing and bisection."""
    high = scale
    while power(high) < target:
        high *= 2
        if high > 1e9 * scale:
            return None
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if power(mid) >= target else (mid, high)
    return high


def inflated(n: int | None, attrition: float) -> int | None:
    return None if n is None else math.ceil(n / (1 - attrition))


# fixed values: the alternatives of a plan, and the tails they mean
ALTERNATIVES = {"two-sided": "two-sided", "larger": "greater", "smaller": "less", "greater": "greater", "less": "less"}


def _f(v: object) -> float | None:
    try:
        x = float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) and not isinstance(v, bool) else None


def plan_item(item: dict, defaults: dict) -> dict:
    """n (a group, or pairs), total_inflated, power, effect, target_met and problem of one item."""
    get = lambda k: _f(item.get(k)) if _f(item.get(k)) is not None else _f(defaults.get(k))
    alpha, target = [v if (v := get(k)) is not None else default for k, default in (("alpha", 0.05), ("target_power", 0.8))]
    alt, kind, solve = item.get("alternative") or "two-sided", item.get("type"), item.get("solve_for")
    alt = ALTERNATIVES.get(alt, "") if isinstance(alt, str) else ""
    out: dict = {"n": None, "inflated": None, "power": None, "effect": None, "target_met": None, "problem": None}
    try:
        if not 0 < alpha < 1 or not 0 < target < 1 or not alt:
            raise ValueError("alpha, target power or alternative")
        if kind == "welch_two_group_mean":
            a, b, n = get("sd_a"), get("sd_b"), get("n_a")
            fn = lambda e, m, m2=None: welch_power(e, a, b, m, m2 or m, alpha, alt)
            effect, scale = get("mean_difference"), max(a, b)
            n2 = get("n_b") or n
        elif kind == "paired_mean":
            s, n, n2 = get("sd_difference"), get("n_pairs"), None
            fn = lambda e, m, m2=None: paired_power(e, s, m, alpha, alt)
            effect, scale = get("mean_difference"), s
        elif kind == "welch_contrast":
            raw = item.get("contrast_terms")
            terms = [t for t in (raw if isinstance(raw, list) else [raw]) if isinstance(t, dict)]
            parts = [(_f(t.get("weight")), _f(t.get("sd")), _f(t.get("allocation_ratio")) or 1.0, _f(t.get("n"))) for t in terms]
            if len(parts) < 2 or any(w is None or sd is None or sd <= 0 for w, sd, _, _ in parts) or abs(sum(w for w, *_ in parts)) > 1e-9:
                raise ValueError("contrast terms")
            # a reference group's n is scaled by each level's allocation ratio
            fn = lambda e, m, m2=None: contrast_power(e, [(w, sd, max(2.0, math.ceil(m * r))) for w, sd, r, _ in parts], alpha, alt)
            effect, scale, n, n2 = get("contrast_effect"), max(sd for _, sd, _, _ in parts), parts[0][3], None
        elif kind == "independent_proportions":
            pa, pb, n = get("p_a"), get("p_b"), get("n_a")
            if not (0 < pa < 1 and 0 < pb < 1):
                raise ValueError("proportions")
            fn = lambda e, m, m2=None: two_proportion_power(pa, min(0.999999, pa + e), m, m2 or m, alpha, alt)
            effect, scale, n2 = pb - pa, 0.01, get("n_b") or n
        else:
            raise ValueError("type")
        if solve == "sample_size":
            if not effect:
                raise ValueError("no effect")
            out["n"] = least_n(lambda m: fn(effect, m), target)
            out["inflated"] = inflated(out["n"], get("attrition_rate") or 0.0)
            out["effect"], out["power"] = effect, None if out["n"] is None else fn(effect, out["n"])
        elif solve == "minimum_detectable_effect":
            if n is None or n < 2:
                raise ValueError("no n")
            sign = -1.0 if alt == "less" else 1.0
            out["n"], out["effect"] = int(n), least_effect(lambda e: fn(sign * e, n, n2), target, scale)
            out["power"] = None if out["effect"] is None else fn(sign * out["effect"], n, n2)
        elif solve == "prospective_power":
            if n is None or n < 2 or effect is None:
                raise ValueError("no n or effect")
            out["n"], out["effect"], out["power"] = int(n), effect, fn(effect, n, n2)
        else:
            raise ValueError("solve_for")
        out["target_met"] = None if out["power"] is None else out["power"] >= target - 1e-9
    except (TypeError, ValueError, ZeroDivisionError, OverflowError) as e:
        out["problem"] = f"incomplete: {e}"[:80]
    return out


def expand_items(plan: dict) -> Iterator[tuple[str, str, dict]]:
    """(item id, scenario id, item) of a plan: each item and its scenarios with their overrides."""
    many = lambda v: v if isinstance(v, list) else [v] if isinstance(v, dict) else []
    for item in many(plan.get("planning_items")):
        if not isinstance(item, dict):
            continue
        yield item.get("planning_item_id") or "", "", item
        for s in many(item.get("scenarios")):
            if isinstance(s, dict):
                over = s.get("overrides")
                over = parse_object(over) if isinstance(over, str) else over
                yield item.get("planning_item_id") or "", s.get("scenario_id") or "", item | (over if isinstance(over, dict) else {})


def plan_power(plans: DataFrame) -> DataFrame:
    """planning_id, plan_version, item_id, scenario_id, type, solve_for, n, inflated, power, effect, target_met, problem."""
    names = ["planning_id", "plan_version", "item_id", "scenario_id", "type", "solve_for", "n", "inflated", "power", "effect", "target_met", "problem"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[str, dict] = {}  # items repeat within and across plans
        for b in batches:
            rows = []
            for pid, ver, text in zip(b["planning_id"], b["plan_version"], b["payload"]):
                plan = parse_object(text)
                for item_id, scenario, item in expand_items(plan or {}):
                    key = json.dumps([{k: v for k, v in item.items() if k not in ("scenarios", "planning_item_id", "assumption_source")}, plan.get("alpha"), plan.get("target_power")], sort_keys=True)
                    if key not in done:
                        if len(done) > 100_000:
                            done.clear()
                        done[key] = plan_item(item, plan)
                    r = done[key]
                    rows.append((pid, ver, item_id, scenario, str(item.get("type") or ""), str(item.get("solve_for") or ""), r["n"], r["inflated"], r["power"], r["effect"], r["target_met"], r["problem"]))
            out = pd.DataFrame(rows, columns=names)
            for c in ("n", "inflated"):
                out[c] = out[c].astype("Int64")
            yield out

    # planning is computing, not reading: even a small table is spread over all cores
    spread = plans.where(F.col("payload").isNotNull()).select("planning_id", "plan_version", "payload").distinct().repartition(2 * plans.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(each, "planning_id string, plan_version string, item_id string, scenario_id string, type string, solve_for string, n bigint, inflated bigint, power double, effect double, target_met boolean, problem string")


# fixed values: what a scenario may change of each type of item
OVERRIDES = {
    "welch_two_group_mean": {"mean_difference", "sd_a", "sd_b", "n_a", "n_b", "alpha", "target_power", "attrition_rate"},
    "paired_mean": {"mean_difference", "sd_difference", "n_pairs", "alpha", "target_power", "attrition_rate"},
    "welch_contrast": {"contrast_effect", "contrast_terms", "alpha", "target_power", "attrition_rate"},
    "independent_proportions": {"p_a", "p_b", "n_a", "n_b", "alpha", "target_power", "attrition_rate"},
}


def validate_plan(plan: dict) -> list[tuple[str, str, str]]:
    """(severity, item, message): repeated ids, unknown types and goals, values out of range, overrides that a scenario may not make."""
    out: list[tuple[str, str, str]] = []
    many = lambda v: v if isinstance(v, list) else [v] if isinstance(v, dict) else []
    seen: set[str] = set()
    for i, item in enumerate(x for x in many(plan.get("planning_items")) if isinstance(x, dict)):
        name, kind = str(item.get("planning_item_id") or f"#{i}"), item.get("type")
        if name in seen:
            out.append(("error", name, "the id occurs twice"))
        seen.add(name)
        if kind not in OVERRIDES:
            out.append(("error", name, f"unknown type {kind}"))
            continue
        if item.get("solve_for") not in ("sample_size", "minimum_detectable_effect", "prospective_power"):
            out.append(("error", name, "unknown goal"))
        for key, low, high in (("alpha", 0, 1), ("target_power", 0, 1), ("attrition_rate", -1e-12, 1)):
            v = item.get(key, plan.get(key))
            if v is not None and not (_f(v) is not None and low < _f(v) < high):
                out.append(("error", name, f"{key} is out of range"))
        for s in (x for x in many(item.get("scenarios")) if isinstance(x, dict)):
            over = s.get("overrides")
            over = parse_object(over) if isinstance(over, str) else over
            for k in sorted(set(over if isinstance(over, dict) else {}) - OVERRIDES[kind]):
                out.append(("error", name, f"scenario {s.get('scenario_id')} may not change {k}"))
    if not seen:
        out.append(("error", "", "the plan has no items"))
    return out
