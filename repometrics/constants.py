"""Values that results depend on.  Every one is a default and can be replaced."""

# --- fixed values: libraries that mark a file as data-science code ---------
DS_LIBRARIES = (
    "theano", "pytorch", "caffe", "keras", "tensorflow", "sklearn",
    "numpy", "scipy", "pandas", "statsmodels",
    "matplotlib", "seaborn", "plotly", "bokeh", "pydot",
    "xgboost", "catboost", "lightgbm", "eli5",
    "elephas", "spark", "nltk", "cntk", "scrapy", "gensim",
    "pybrain", "lightning", "spacy", "pylearn2",
    "nupic", "pattern", "imblearn", "pyenv",
)

# --- fixed values: modules that mark a file as test code -------------------
TEST_FRAMEWORKS = ("unittest", "pytest", "unittest2", "mock")

# --- fixed values: description fragments that exclude a candidate ----------
EXCLUDED_TERMS = (
    "machine learn", "machine-learn", "data sci", "data-sci",
    "big data", "big-data", "large data", "large-data",
    "data analy", "data-analy", "deep learn", "deep-learn",
    "data model", "data-model",
    "artificial intel", "artificial-intel",
    "mining", "topic modelling", "topic-modelling",
    "natural language pro", "natural-language-pro",
    "nlp", "data frame", "data proces", "ml",
    "tensorflow", "tensor flow", "tensor-flow",
    "theano", "caffe", "keras",
    "scikit-learn", "kaggle", "spark",
    "hadoop", "mapreduce", "hdfs",
    "neural net", "neural-net",
)

# --- fixed values: lint symbols whose curves are compared ------------------
LINT_DIMENSIONS = (
    "too-many-locals", "import-error", "too-many-arguments", "invalid-name",
    "broad-except", "bad-indentation", "consider-using-enumerate",
    "missing-class-docstring", "trailing-whitespace",
    "missing-function-docstring", "unsubscriptable-object",
    "inconsistent-return-statements", "wrong-import-position",
    "bad-whitespace", "too-many-instance-attributes",
    "unnecessary-comprehension", "missing-final-newline", "unused-variable",
    "ungrouped-imports", "too-few-public-methods", "too-many-public-methods",
    "missing-module-docstring", "too-many-statements",
    "attribute-defined-outside-init", "line-too-long", "bad-continuation",
    "bad-option-value", "consider-using-dict-comprehension",
    "trailing-newlines", "invalid-unary-operand-type", "reimported",
    "unused-import",
)

# --- fixed values: repository measures compared between the two groups -----
LOG_DIMENSIONS = ("stars", "size", "forks_count", "open_issues_count", "watch", "loc", "complexity")
LINEAR_DIMENSIONS = ("age", "number_of_contributors")

# --- fixed values: ids left out by hand ------------------------------------
BLACKLISTED_IDS = (858127,)

# --- fixed values: labels, thresholds and formats --------------------------
CAT_LIBRARY = "ml0"
CAT_NONE = "no-ml-dependency"
CAT_TEST = "test"
CATEGORIES = (CAT_LIBRARY, CAT_NONE, CAT_TEST)
VERSIONS = ("either", "neither", "python2", "python3")
FUNCTION_TYPES = ("method", "function")
LINT_PREFIX = "lint_"
SYNTAX_ERROR_ID = "E0001"
CONFIG_NOTICE = "Using config file"
PARSE_NOTICE = "Can't parse"
RATE_LIMIT_NOTICE = "rate limit"
LISTS_SINCE = "2015-07-01T00:00:00Z"
SELECT_SINCE = "2016-01-01T00:00:00Z"
MAX_AGE_DAYS = 1500
MIN_STARS = 80
LANGUAGE = "Python"
CHUNK_SIZE = 800
CONTRIBUTOR_PAGE = 30
SECONDS_PER_DAY = 86400
CURVE_EDGES = 1000
CURVE_PAD = 0.001
CURVE_FLOOR = 0.9
CURVE_CAP = 0.2
MAX_LINE_LENGTH = 100
MAX_MODULE_LINES = 1000
NOTE_TAGS = ("FIXME", "XXX", "TODO")
LONG_LINE_EXCEPTION = r"^\s*(# )?<?https?://\S+>?$"
