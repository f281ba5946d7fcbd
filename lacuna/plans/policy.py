"""Policy values of the engine, in one place."""

# fixed values: limits and weights of the published policy
DISAGREEMENT = 75.0
ALIGN_RADIUS = 20
ALIGN_SCALES = [1.0, 0.99, 1.01, 0.98, 1.02]
TRIM_KEEP = 0.99
MIN_OVERLAP = 0.6
SEARCH_SAMPLES = 384
MIN_SAMPLES = 20
SCORABLE = 0.80
PUBLISHABLE = 0.95
BOUNDARY = 0.80
REVIEWABLE = 0.75
NEAR_FLAT = 20.0
START_MASK = 0.10
END_MASK = 0.03
PEER_GAP = 40
PRIOR_PENALTY = 100.0
WARNING_WEIGHT = 0.01
SCORE_GAP = 7500.0
BORDERLINE = 15.0
SCORE_WEIGHTS = {"errors": 100000, "warnings": 10000, "missing": 10, "max_gap": 1, "layout_cost": 100, "annotation": 25000, "permissive": 250000}
DISAGREEMENT_WEIGHT = 25.0
GAP_WARNING = 10
GAP_WARNINGS_PER_SERIES = 2
TRANSITION = 0.15
GIB = 1 << 30
MIN_FREE = 5 * GIB
RESERVE_FACTOR = 16
CONSERVATIVE_THRESHOLD = 0.1
REVIEW_LAYOUT = 0.75
NATIVE_LAYOUT = 0.3
NATIVE_MEDIAN = 0.7
NATIVE_P10 = 0.2
REVIEW_LEADS = 0.9
LOW_RESOLUTION = {"max_edge": 600, "median_rmse": 60.0, "lead_rmse": 75.0, "leads": 9, "jump_margin": 2}
LEADS = 12
CORE = 5
NEURAL = 12
GEOMETRY_3X4 = 0.6
GEOMETRY_6X2 = 0.5
UPSCALE = 1200
PREPARATION = {"sharpness": 200.0, "long_edge": 1200, "trace": 0.35, "weak_grid": 0.50, "smooth_trace": 0.90, "smooth_grid": 0.40}
FIDELITY = {"layout": 0.45, "median": 0.70, "p10": 0.45, "coverage": 0.80, "coverage_plain": 0.85, "unsupported": 0.40, "unsupported_plain": 0.12, "crossing_p95": 0.45, "crossing_jump": 1.15, "home_row": 0.55}
CROSSING = {"ink": 5.0, "home": 4.0, "linear": 0.0025, "square": 0.000018, "candidate": 0.28, "connected": 0.24, "states": 48, "thirds": 6, "gap": 2, "gap_share": 0.08}
BAND = 0.24
TIME_RANGES = {"share": 0.20, "least": 40, "onset": 0.55}
SIX_BY_TWO = {"seconds": 5.0, "narrow": 0.02, "wide": 0.42, "widest": 0.60, "sustained": 0.75, "single": (0.85, 1.15), "double": (1.85, 2.15), "split": 0.08, "search": (0.04, 0.24), "early": 0.03, "gutter": (0.485, 0.515), "gutter_run": 0.004, "later": 0.01, "apart": 0.08, "kept": 0.85}
THREE_BY_FOUR = {"seconds": 2.5, "narrow": 0.055, "widest": 1.08, "label": 0.06, "search": (0.04, 0.36), "window": 0.04}
TWELVE = {"seconds": 10.0, "support": 0.70, "band": 0.20, "origin_band": 0.055, "left": (0.04, 0.20), "right": (0.80, 0.98), "window": 0.04, "continuity": 0.45, "edges": 2, "corrected": 3, "tolerance_mm": 0.75, "span": (0.78, 0.96), "scale": 0.12, "mm": (1.0, 40.0)}
TWELVE_ORIGIN = {"least": 80, "widest": 0.97, "first": 0.012, "last": 0.18, "early": 0.08, "early_run": 0.045, "pulse_mm": 5.5, "onset": 0.012, "onset_mm": 6.0, "start_fit": 0.025, "end_fit": 0.035, "spread": 0.18}
LABEL_ROWS = [["I", "aVR", "V1", "V4"], ["II", "aVL", "V2", "V5"], ["III", "aVF", "V3", "V6"]]
LABEL_GRID = {"columns": (0.12, 0.30), "rows": (0.09, 0.30), "skew": 0.06, "font": (0.02, 0.18), "x": 0.04, "y_font": 0.6, "y": 0.04, "rhythm_x": 0.12, "rhythm_y": 0.25, "box": (0.65, 0.6, 3.4)}
EXCURSION = {"near": 0.04, "flank": (0.08, 0.12), "band": 2.0, "band_share": 0.1, "pulse": 0.3, "known": 2, "peers": 3, "peer_columns": 2, "peer_valid": 0.9}
SUSTAINED = {"window": 0.024, "least": 24, "run": 0.004, "run_least": 5, "hole_least": 4, "share": 0.72}
