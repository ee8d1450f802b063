from repometrics.plans.candidates import candidate_repos, extraction_lists, merged_metrics
from repometrics.plans.distributions import compare_distributions
from repometrics.plans.lint import (
    category_histogram,
    lint_by_category,
    lint_curves,
    lint_density_by_category,
    lint_density_by_repo,
    lint_significance,
    repo_histogram,
)
from repometrics.plans.profiles import import_analysis, version_analysis
from repometrics.plans.selection import select_ds, select_nonds

__all__ = [
    "candidate_repos", "category_histogram", "compare_distributions", "extraction_lists", "import_analysis",
    "lint_by_category", "lint_curves", "lint_density_by_category", "lint_density_by_repo", "lint_significance",
    "merged_metrics", "repo_histogram", "select_ds", "select_nonds", "version_analysis",
]
