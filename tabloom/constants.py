"""Fixed values that results depend on."""

# Code points of the encodings.
HIDDEN = -100.0  # a query row's target, and a number cell holding no number
MISSING_BIN = 63  # a missing number in bin encoding
OTHER_LABEL = 62  # a label outside the kept classes
KEPT_LABELS = 62
NUM_BINS = 16
NULL_TEXT = "None"
PAD_PREFIX = "__LOOM_PAD_"
PAD_VALUE = "__LOOM_PAD__"

# Default sizes and thresholds.
MAX_AUTO_BAGS = 16
MAX_COLUMNS = 500
MAX_CONTEXT_ROWS = 8192
QUERY_CHUNK_ROWS = 1000
MIN_PROBE_ROWS = 150
TASK_ROWS = 100_000
LONG_TEXT_CHARS = 100
MAX_DISTINCT_RATIO = 0.2
MAX_NULL_RATIO = 0.5
REGRESSION_KEYWORD = "regression"
WINSOR_LIMITS = {"valid": (0.005, 0.995), "default": (0.02, 0.98)}
