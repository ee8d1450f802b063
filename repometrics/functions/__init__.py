from repometrics.functions.exact import distance_tail, u_distribution, upper_tail
from repometrics.functions.scalars import (
    any_contains,
    clamp_above,
    clamp_below,
    days_between,
    epoch_days,
    epoch_iso,
    import_short_name,
    nonblank_lines,
    strip,
)
from repometrics.functions.special import chi2_tail_df1, erfc, f_tail_df1, kolmogorov_tail, normal_tail
from repometrics.functions.versions import py_version_label, version_select, version_summary

__all__ = [
    "any_contains", "chi2_tail_df1", "clamp_above", "clamp_below", "days_between", "epoch_days", "epoch_iso", "distance_tail", "erfc",
    "f_tail_df1",
    "import_short_name", "kolmogorov_tail", "nonblank_lines", "normal_tail", "py_version_label",
    "strip", "u_distribution", "upper_tail", "version_select", "version_summary",
]
