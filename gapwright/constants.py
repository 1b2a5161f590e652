"""Fixed values.

Everything in this module is a domain constant whose value decides results:
physical bounds, mnemonic priorities, seeds, canonical orders, test families.
They are stated once, in natural order, and imported everywhere else.
"""

# --- fixed values: depth axis and windows -------------------------------------------
STEP_M = 0.1524
STEP_TOL = 1e-3
WINDOW = 256
STRIDE = 64

# --- fixed values: channels ----------------------------------------------------------
LOGS = ("GR", "RHOB", "NPHI")
BOUNDS = {"GR": (0.0, 400.0), "RHOB": (1.2, 3.1), "NPHI": (-0.05, 1.0)}
MNEMONICS = {
    "GR": ("GR", "SGR", "CGR", "GRD", "GRN"),
    "RHOB": ("RHOB", "RHOZ", "DEN", "DENS"),
    "NPHI": ("NPHI", "TNPH", "NPOR", "PHIN"),
}
UNITS = {"GR": "gAPI", "RHOB": "g/cm3", "NPHI": "frac"}
PERCENT_P99 = 1.5
ABERRANT_GR_MEDIAN = 6.0

# --- fixed values: missingness scenarios --------------------------------------------
SCENARIOS = ("single", "block", "profile", "blackout")
EMPIRICAL = "blackout_emp"
ALL_SCENARIOS = SCENARIOS + (EMPIRICAL,)
EVAL_SEED = {"single": 1000, "block": 1001, "profile": 1002, "blackout": 1003, "blackout_emp": 1004}
SEED_STRIDE = 100_000
N_POINTS = 5
BLOCK_LENGTHS = (20, 100)
BLACKOUT_FRACTION = (0.3, 0.9)
COOCCUR_DEFAULT = {1: 0.035, 2: 0.759, 3: 0.206}

# --- fixed values: methods -----------------------------------------------------------
ORDER = ("mean", "locf", "rf", "xgb", "mice", "saits", "brits", "unet", "ae", "gnn", "stgnn")
LEARNED = ("rf", "xgb", "mice", "saits", "brits", "unet", "ae", "gnn", "stgnn")
WITHIN_WELL = ("mean", "locf", "rf", "xgb", "mice", "saits", "brits", "unet", "ae",
               "locf_win", "ridge", "knn", "interp_linear", "interp_pchip", "xgb_miss",
               "xgb_chain_asc", "xgb_chain_desc", "saits_mix", "brits_mix")
SPATIAL = ("gnn", "stgnn", "idw", "nnwell", "okrige", "gnn_noneigh", "stgnn_noneigh",
           "gnn_shuffle", "stgnn_shuffle")
FAMILY = {
    "mean": "baseline", "locf": "baseline",
    "rf": "tabular", "xgb": "tabular", "mice": "tabular",
    "saits": "sequential", "brits": "sequential", "unet": "sequential", "ae": "sequential",
    "gnn": "spatial", "stgnn": "spatial",
    "locf_win": "sequential", "interp_linear": "sequential", "interp_pchip": "sequential",
    "saits_mix": "sequential", "brits_mix": "sequential",
    "ridge": "tabular", "knn": "tabular", "xgb_miss": "tabular",
    "xgb_chain_asc": "tabular", "xgb_chain_desc": "tabular",
    "idw": "spatial", "nnwell": "spatial", "okrige": "spatial",
    "gnn_noneigh": "spatial", "stgnn_noneigh": "spatial",
    "gnn_shuffle": "spatial", "stgnn_shuffle": "spatial",
}
DISPLAY = {
    "mean": "MEAN", "locf": "LOCF", "rf": "RF", "xgb": "XGBoost", "mice": "MICE",
    "saits": "SAITS", "brits": "BRITS", "unet": "U-Net", "ae": "AE", "gnn": "GNN",
    "stgnn": "ST-GNN",
    "locf_win": "LOCF (window)", "ridge": "Ridge", "knn": "kNN",
    "interp_linear": "Linear interp.", "interp_pchip": "PCHIP interp.",
    "xgb_miss": "XGBoost (miss.-aware)", "xgb_chain_asc": "XGBoost chain (asc.)",
    "xgb_chain_desc": "XGBoost chain (desc.)", "saits_mix": "SAITS (curriculum)",
    "brits_mix": "BRITS (curriculum)", "idw": "IDW", "nnwell": "Nearest well",
    "okrige": "Ordinary kriging", "gnn_noneigh": "GNN (no neighbours)",
    "stgnn_noneigh": "ST-GNN (no neighbours)", "gnn_shuffle": "GNN (shuffled)",
    "stgnn_shuffle": "ST-GNN (shuffled)",
}

# --- fixed values: declared test families -------------------------------------------
PAIRS_MAIN = {
    "profile": (("stgnn", "gnn"), ("stgnn", "mice"), ("gnn", "mice"),
                ("xgb", "mice"), ("xgb", "stgnn"), ("xgb", "gnn"),
                ("unet", "mice"), ("unet", "stgnn"), ("unet", "gnn")),
    "blackout": tuple(("locf", m) for m in LEARNED),
}
PAIRS_EXTENDED = {
    "profile": (("saits_mix", "saits"), ("brits_mix", "brits"),
                ("gnn", "gnn_noneigh"), ("stgnn", "stgnn_noneigh"),
                ("gnn", "gnn_shuffle"), ("stgnn", "stgnn_shuffle"),
                ("stgnn", "idw"), ("stgnn", "okrige"), ("mice", "okrige"),
                ("unet", "ridge"), ("mice", "ridge")),
    "blackout": (("xgb_miss", "xgb"), ("xgb_chain_asc", "xgb_chain_desc"),
                 ("saits_mix", "saits"), ("brits_mix", "brits"),
                 ("locf", "interp_linear")),
    "blackout_emp": (("locf", "locf_win"), ("locf", "interp_linear"))
                    + tuple(("locf", m) for m in LEARNED),
}
PAIRS_POOLED = (
    ("profile", "stgnn", "mice"), ("profile", "stgnn", "gnn"), ("profile", "mice", "gnn"),
    ("profile", "stgnn", "saits"), ("profile", "stgnn", "locf"),
    ("single", "brits", "stgnn"), ("blackout", "locf", "stgnn"), ("blackout", "mice", "xgb"),
)
PAIRS_NEIGHBOUR_GAIN = (("gnn", "gnn_noneigh"), ("stgnn", "stgnn_noneigh"),
                        ("gnn", "gnn_shuffle"), ("stgnn", "stgnn_shuffle"))
BOOTSTRAP_SEED = 20261016
BOOTSTRAP_REPS = 10_000
ALPHA = 0.05

# --- fixed values: imputer hyper-parameters ------------------------------------------
RIDGE_ALPHA = 1.0
KNN_K = 10
FOREST = {"numTrees": 200, "minInstancesPerNode": 2}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8}
GRAPH_K = 8
SHUFFLE_SEED_BASE = 10_000
VARIOGRAM_GRID = 60
IDW_MIN_KM = 1e-3


def method_rank(name: str) -> tuple[int, str]:
    """Canonical position: the eleven main methods first, the others by name."""
    return (ORDER.index(name), "") if name in ORDER else (len(ORDER), name)


def eval_seed(scenario: str, mask_seed: int = 0) -> int:
    """Seed of the evaluation masks of one scenario under one mask seed."""
    return EVAL_SEED[scenario] + SEED_STRIDE * int(mask_seed)
