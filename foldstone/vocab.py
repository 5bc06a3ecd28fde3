"""Closed vocabularies and column lists.

Everything in this module is a FIXED VALUE: results are only right if these
match the data sets and log formats they describe.
"""

# FIXED VALUES -- field codes of the base corpus file names
MODALITY = "03"
VOCAL_CHANNEL = "01"
EMOTIONS = {
    "01": "neutral",
    "02": "calm",
    "03": "happy",
    "04": "sad",
    "05": "angry",
    "06": "fearful",
    "07": "disgust",
    "08": "surprised",
}
INTENSITIES = {"01": "normal", "02": "strong"}
STATEMENTS = {"01": "kids", "02": "dogs"}
REPETITIONS = {"01": "1st", "02": "2nd"}
GROUP_DIR_PATTERN = r"^Person(\d{2})$"

# FIXED VALUES -- invariants of the base corpus
EXPECTED_ROWS = 1440
EXPECTED_GROUPS = 24
ROWS_PER_GROUP = 60
NEUTRAL_ROWS = 96
OTHER_LABEL_ROWS = 192
GROUPS_PER_GENDER = 12

# FIXED VALUES -- sources in reporting order and their published sizes
SOURCES = ("RAVDESS", "CREMA-D", "TESS", "SAVEE")
BASE_SOURCE = "RAVDESS"
PUBLISHED_COUNTS = {"RAVDESS": 1440, "CREMA-D": 7442, "TESS": 2800, "SAVEE": 480}
LABELS = ("neutral", "calm", "happy", "sad", "angry", "fearful", "disgust", "surprised")
CREMAD_EMOTION = {
    "NEU": "neutral",
    "HAP": "happy",
    "SAD": "sad",
    "ANG": "angry",
    "FEA": "fearful",
    "DIS": "disgust",
}
CREMAD_INTENSITY = {"XX": "unspecified", "LO": "low", "MD": "medium", "HI": "high"}
TESS_EMOTION = {
    "neutral": "neutral",
    "happy": "happy",
    "sad": "sad",
    "angry": "angry",
    "fear": "fearful",
    "disgust": "disgust",
    "ps": "surprised",
}
SAVEE_EMOTION = {
    "n": "neutral",
    "h": "happy",
    "sa": "sad",
    "a": "angry",
    "f": "fearful",
    "d": "disgust",
    "su": "surprised",
}
SAVEE_PATTERN = r"^(?:([A-Za-z]{2})[_-])?(sa|su|a|d|f|h|n)(\d+)$"
SAVEE_SPEAKERS = ("DC", "JE", "JK", "KL")

# FIXED VALUES -- column lists of the stored tables
INVENTORY_FIELDS = ("emotion", "intensity", "statement", "repetition", "actor_code")
INDEX_COLUMNS = (
    "filename", "filepath", "source", "speaker_id", "actor", "gender",
    "emotion", "intensity", "statement", "repetition",
    "emotion_label", "intensity_label", "statement_label", "repetition_label",
    "label", "label_idx",
)
FOLDS_COLUMNS = ("protocol", "fold", "filename", "split")
RESULTS_COLUMNS = (
    "run_id", "timestamp", "owner", "protocol", "fold", "feature_config",
    "model", "hyperparams", "accuracy", "macro_f1", "notes",
)
PROTOCOLS = (
    "speaker_independent", "random_stratified", "statement_holdout", "statement_holdout_si",
)
MERGED_PROTOCOLS = (
    "speaker_independent_merged", "corpus_holdout", "random_stratified_merged",
)
ARMS = ("ravdess_only", "pooled", "two_stage", "two_stage_frozen")
SLICE_COLUMNS = ("gender", "intensity_label", "emotion_label")

# FIXED VALUES -- superclasses used by the two error-structure reports
HIGH_AROUSAL = ("angry", "happy", "fearful", "surprised")
HIGH_AROUSAL_WIDE = ("angry", "happy", "fearful", "surprised", "disgust")

# FIXED VALUES -- numeric settings
SEED = 42
N_SPLITS = 5
INNER_SPLITS = 3
N_BOOT = 2000
TARGET_RATE = 16000
CLIP_LEVEL = 0.999
DELTA_CONTEXT_MS = 288.0
GROUP_EPS = 1e-8
WEIGHT_GRID = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01)
RATIO_CLIP = 10.0
NOISE_SIGMAS = (0.05, 0.1, 0.2, 0.4)
MIX_RATIOS = (0.5, 1.0, 2.0)
MIX_ALPHA = 0.4
AUGMENT_TAG = "__"
AGGREGATIONS = ("mean", "mean_std", "mean_std_min_max", "percentiles")
PERCENTILES = (10, 25, 50, 75, 90)
POOLINGS = ("mean", "mean_std", "std")
NORMALISATIONS = ("none", "global", "per_speaker")
EXTRAS = ("chroma", "spectral_contrast", "spectral_centroid", "rolloff", "zcr", "rms")

# FIXED VALUES -- what an ablation changes, one axis at a time
ABLATION_AXES = {
    "framing": ({"n_fft": 400, "hop_length": 160}, {"n_fft": 640, "hop_length": 160}),
    "n_mfcc": ({"n_mfcc": 13}, {"n_mfcc": 20}),
    "deltas": ({"deltas": False, "delta_deltas": False}, {"deltas": True, "delta_deltas": False}),
    "aggregation": ({"aggregation": "mean"}, {"aggregation": "mean_std_min_max"}, {"aggregation": "percentiles"}),
    "normalisation": ({"normalisation": "global"}, {"normalisation": "per_speaker"}),
    "trim": ({"trim": False},),
    "extras": ({"extras": ("chroma",)}, {"extras": ("spectral_contrast",)}, {"extras": ("chroma", "spectral_contrast", "spectral_centroid", "zcr")}),
    "n_mels": ({"n_mels": 40}, {"n_mels": 80}),
    "fmin": ({"fmin": 50.0},),
}
