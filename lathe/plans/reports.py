"""Text reports of an analysis."""

from __future__ import annotations

from lathe.operators.profile import Profile
from lathe.options import OVERFIT_SUMMARY_GAP
from lathe.plans.analysis import AnalysisResult, Prepared


def profile_report(p: Profile) -> str:
    s = p.stats
    number = lambda x, f=".3f": "unknown" if x is None else format(x, f)
    lines = [
        f"{p.n_rows} rows, {p.n_cols} columns; {p.missing_total} cells are missing.",
        f"Target {p.target}: mean {number(s['mean'])}, standard deviation {number(s['std'])}, from {number(s['min'])} to {number(s['max'])}, skewness {number(s['skew'], '+.2f')}.",
        ", ".join(f"{len(p.named(kind))} {kind}" for kind in ("numeric", "categorical", "datetime", "id_like")) + " columns.",
    ]
    for said, columns in (("Dates", p.named("datetime")), ("Constant", p.low_variance), ("Many values", p.high_cardinality), ("Ids", p.named("id_like"))):
        if columns:
            lines.append(f"{said}: {', '.join(columns)}.")
    if p.missing_most():
        lines.append("Often missing: " + ", ".join(f"{c} ({pct:.1f} %)" for c, pct in p.missing_most()) + ".")
    if p.skewed:
        lines.append("The target is skewed; consider its logarithm.")
    return "\n".join(lines)


def preparation_report(prepared: Prepared) -> str:
    s = prepared.summary
    lines = [
        f"Rows: {s['n_train']} to train, {s['n_val']} to validate, {s['n_test']} to test (split: {s['split_strategy_used']}).",
        f"{s['n_features_after']} features from {len(s['numeric_cols'])} numeric, {len(s['low_cardinality_categorical'])} one-hot and {len(s['high_cardinality_categorical'])} frequency-encoded columns.",
        f"Target transform: {s['target_transform']}.",
    ]
    for said, key in (("Dates expanded", "datetime_cols_extracted"), ("Constant columns dropped", "low_variance_dropped"), ("Ids dropped", "id_like_columns_dropped")):
        if s[key]:
            lines.append(f"{said}: {', '.join(s[key])}.")
    return "\n".join(lines)


def training_report(result: AnalysisResult) -> str:
    order = sorted(result.results.values(), key=lambda r: (r.metrics["rmse"], -(r.metrics["r2"] or 0.0)))
    lines = [f"{k}. {r.name}: RMSE {r.metrics['rmse']:.4f}, MAE {r.metrics['mae']:.4f}, R2 {r.metrics['r2']:.4f}" for k, r in enumerate(order, start=1)]
    return "\n".join(["Models by test RMSE:", *lines])


def best_report(result: AnalysisResult) -> str:
    m = result.results[result.best].metrics
    lines = [f"Best: {result.best}", f"RMSE {m['rmse']:.4f} (training {m['rmse_train']:.4f}), MAE {m['mae']:.4f}, R2 {m['r2']:.4f} (training {m['r2_train']:.4f}), median error {m['median_ae']:.4f}"]
    if "cv_r2_mean" in m:
        lines.append(f"R2 over the folds: {m['cv_r2_mean']:.4f} with a standard deviation of {m['cv_r2_std']:.4f}")
    if m["r2_train"] - m["r2"] > OVERFIT_SUMMARY_GAP:
        lines.append("It may be overfitted: training rows fare much better than test rows.")
    return "\n".join(lines)
