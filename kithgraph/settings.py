"""Numbers that decide results."""

# These must equal the published behaviour for right results.
MAX_VALUE_HOLDERS = 50
MAX_RING_SIZE = 30
CV_FOLDS = 5
MIN_REASON_IMPACT = 0.02
FEEDBACK_WEIGHT = 5.0
MIN_CLASS_LABELS = 10
SEED = 42
MAX_GRAPH_NODES = 1500
PREVIEW_ROWS = 8
HISTOGRAM_BINS = 20
AT_K = [25, 50, 100, 200, 500, 1000]
CURVE_POINTS = 200
WINDOW_DAYS = 7
RING_EVIDENCE_ROWS = 12
HUB_REPORT_ROWS = 10

# At most this many of the most frequent keys take the broadcast path. A key outside the top k
# holds fewer than 1/k of all rows, so k bounds both the broadcast and the largest shuffle group.
HOT_KEYS = 1000
