"""Default values. Every one can be overridden by a keyword argument of the function that uses it."""

# --- Fixed values: must be exactly these for results to agree -------------------------------------
BLOCK_THRESHOLD = 0.65
AMBIGUOUS_LOWER = 0.40
AMBIGUOUS_UPPER = 0.70
EVAL_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
MIN_TEXT_LENGTH = 5
PREVIEW_LENGTH = 120
BENIGN_SHARE = 0.80
TRAIN_SHARE = 0.85
JACCARD_PERCENT = 85
MINHASH_PERMUTATIONS = 128
SEED = 42
CORPUS_COLUMNS = ("text", "label", "source", "attack_type")
EVAL_ONLY_MARK = "rogue"
# ---------------------------------------------------------------------------------------------------

# Bands x rows that minimise the summed false-positive and false-negative area of the published
# collision curve 1 - (1 - s^r)^b at Jaccard 0.85 with 128 permutations.
MINHASH_BANDS = 8
MINHASH_ROWS = 16
