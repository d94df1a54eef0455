"""Names of the window features, grouped in blocks."""

# Feature names in the order of the result columns.
HRV = ["mean_rr", "median_rr", "std_rr", "mad_rr", "rmssd", "sdsd", "cv_rr", "rr_diff_mean", "rr_diff_std"]
POINCARE = ["sd1", "sd2", "sd1_sd2_ratio"]
SHEWHART = ["shewhart_out_count", "shewhart_out_rate", "shewhart_max_abs_z", "shewhart_first_alarm_pos", "shewhart_first_alarm_time_sec"]
CUSUM = [
    "cusum_pos_max", "cusum_neg_max", "cusum_abs_max", "cusum_last_pos", "cusum_last_neg", "cusum_alarm_count",
    "cusum_first_alarm_pos", "cusum_first_alarm_time_sec", "cusum_time_in_alarm", "cusum_alarm_density",
]
EWMA = ["ewma_last", "ewma_max_abs", "ewma_slope", "ewma_alarm_count", "ewma_first_alarm_time_sec"]
MOVING_RANGE = ["mr_mean", "mr_median", "mr_max", "mr_mad", "mr_out_count"]
RUNS = ["longest_run_above_median", "longest_run_below_median", "trend_run_up_max", "trend_run_down_max", "n_runs_rule_violations"]
ECTOPY = [
    "ectopy_like_count", "ectopy_like_density", "short_long_sequence_count", "compensatory_pause_like_count",
    "bigeminy_like_pattern_count", "trigeminy_like_pattern_count", "atrial_tachy_like_run_count",
]
SPC = SHEWHART + CUSUM + EWMA + MOVING_RANGE + RUNS
ALL = HRV + POINCARE + SPC + ECTOPY

# How a feature of windows becomes one of the record; the median unless listed.
SUMMED = [
    "shewhart_out_count", "cusum_alarm_count", "ewma_alarm_count", "mr_out_count", "n_runs_rule_violations", "ectopy_like_count",
    "short_long_sequence_count", "compensatory_pause_like_count", "bigeminy_like_pattern_count", "trigeminy_like_pattern_count",
    "atrial_tachy_like_run_count",
]
EARLIEST = ["shewhart_first_alarm_time_sec", "cusum_first_alarm_time_sec", "ewma_first_alarm_time_sec"]
LARGEST = [
    "shewhart_max_abs_z", "cusum_pos_max", "cusum_neg_max", "cusum_abs_max", "ewma_max_abs", "mr_max", "longest_run_above_median",
    "longest_run_below_median", "trend_run_up_max", "trend_run_down_max",
]

# Blocks for evaluation; the same letters name other contents in the two families.
BLOCKS = {
    "full.A_HRV": HRV,
    "full.B_SPC": SPC,
    "full.C_HRV_SPC": HRV + SPC,
    "full.D_HRV_SPC_Poincare": HRV + SPC + POINCARE,
    "full.E_HRV_SPC_Poincare_Ectopy": HRV + SPC + POINCARE + ECTOPY,
    "reduced.A_HRV": ["rmssd", "cv_rr", "sd2"],
    "reduced.B_SPC": SPC,
    "reduced.C_HRV_SPC": ["rmssd", "cv_rr", "sd2"] + SPC,
    "reduced.D_HRV_SPC_Poincare": ["rmssd", "cv_rr", "sd2"] + SPC + ["sd1", "sd1_sd2_ratio"],
}


# Blocks for reading models, and the order in which one of several correlated features is kept.
INTERPRETABLE = {
    "hrv_full_actual": HRV + POINCARE,
    "hrv_reduced_interpretable": ["rmssd", "cv_rr", "sd2"],
    "hrv_minimal": ["rmssd", "sd2"],
    "B_SPC": SPC,
    "C_HRV_SPC": ["rmssd", "cv_rr", "sd2"] + SPC,
    "D_HRV_SPC_Poincare": ["rmssd", "cv_rr", "sd2"] + SPC + POINCARE,
}
PRIORITY = [
    "rmssd", "cv_rr", "sd2", "sd1", "sdsd", "mad_rr", "mean_rr", "median_rr", "rr_diff_mean", "rr_diff_std", "std_rr", "sd1_sd2_ratio",
    "cusum_abs_max", "cusum_pos_max", "cusum_neg_max", "cusum_last_pos", "cusum_last_neg", "ewma_slope", "ewma_last", "ewma_max_abs",
    "shewhart_out_rate", "shewhart_out_count", "shewhart_max_abs_z", "mr_mad", "mr_median", "mr_mean", "mr_max", "mr_out_count",
    "longest_run_above_median", "longest_run_below_median", "trend_run_up_max", "trend_run_down_max", "n_runs_rule_violations",
]


def priority(feature: str) -> int:
    """Place in PRIORITY; all features that it lacks share the place after the last."""
    return PRIORITY.index(feature) if feature in PRIORITY else len(PRIORITY)


def resolve(block: list[str], columns: list[str]) -> tuple[list[str], list[str]]:
    """The block's features that a table has, once each and in order, and those that it lacks."""
    have = set(columns)
    unique = list(dict.fromkeys(block))
    return [c for c in unique if c in have], [c for c in unique if c not in have]


def how(feature: str) -> str:
    """sum, min, max or median, in this precedence."""
    return "sum" if feature in SUMMED else "min" if feature in EARLIEST else "max" if feature in LARGEST else "median"
