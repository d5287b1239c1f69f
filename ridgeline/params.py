"""Fixed values of the domain model: score tables, weights, limits and projection constants.

Everything here is data, not logic.  Functions take these as default
arguments, so a caller can pass other tables without touching the code.
"""

# ---------------------------------------------------------------- fixed values
# Base of the helicopters (degrees) and the search radius around an incident.
BASE_LAT = 38.25
BASE_LON = 128.50
RESCUE_RADIUS_M = 500.0
EARTH_RADIUS_M = 6_371_000.0

# Grade -> suitability score.
SLOPE_SCORE = {0: 1.0, 1: 0.70, 2: 0.35}
DENSITY_SCORE = {0: 1.0, 1: 0.85, 2: 0.21, 3: 0.00}
HEIGHT_SCORE = {0: 1.0, 1: 0.61, 2: 0.31}
ELEVATION_SCORE = {0: 1.0, 1: 0.70, 2: 0.35}
ELEVATION_GRADE_EDGES = (500.0, 1200.0)
LAND_CODES = (0, 1, 2)
RIVER_CODE = 2

# Suitability weights by aircraft size and tactic.
TACTIC_WEIGHTS = {
    "small_landing": {"slope": 0.42, "density": 0.10, "height": 0.08, "elevation": 0.08,
                      "wind": 0.20, "wind_dir": 0.12},
    "small_hoist": {"slope": 0.12, "density": 0.15, "height": 0.20, "elevation": 0.08,
                    "wind": 0.30, "wind_dir": 0.15},
    "large_landing": {"slope": 0.46, "density": 0.14, "height": 0.08, "elevation": 0.12,
                      "wind": 0.12, "wind_dir": 0.08},
    "large_hoist": {"slope": 0.10, "density": 0.24, "height": 0.18, "elevation": 0.18,
                    "wind": 0.18, "wind_dir": 0.12},
}
MODES = tuple(TACTIC_WEIGHTS)
STATIC_PARTS = ("slope", "density", "height", "elevation")
SAFE_FROM = 0.80
CAUTION_FROM = 0.55
CLASS_LABELS = {0: "safe", 1: "caution", 2: "danger"}
WIND_LABELS = {1.0: "headwind", 0.0: "tailwind", 0.5: "crosswind"}

# Wind speed edges (m/s) of the three positive wind scores.
WIND_SCORES = (1.0, 0.6, 0.2)
TRAIN_WIND_EDGES = (5.0, 10.0, 15.0)
SIZE_WIND_EDGES = {"small": (5.0, 8.0, 10.0), "large": (5.0, 12.0, 20.0)}

# Risk weights: mode = tactic letter + aircraft class.
RISK_WEIGHTS = {
    "L_Light": {"slope": 0.42, "density": 0.10, "height": 0.08,
                "wind_speed": 0.20, "wind_dir": 0.12, "altitude": 0.08},
    "L_Heavy": {"slope": 0.46, "density": 0.14, "height": 0.08,
                "wind_speed": 0.12, "wind_dir": 0.08, "altitude": 0.12},
    "H_Light": {"slope": 0.12, "density": 0.15, "height": 0.20,
                "wind_speed": 0.30, "wind_dir": 0.15, "altitude": 0.08},
    "H_Heavy": {"slope": 0.10, "density": 0.24, "height": 0.18,
                "wind_speed": 0.18, "wind_dir": 0.12, "altitude": 0.18},
}
RISK_MODE_KEYS = {("landing", "light"): "L_Light", ("landing", "heavy"): "L_Heavy",
                  ("hoist", "light"): "H_Light", ("hoist", "heavy"): "H_Heavy"}
SLOPE_RISK_REF = 30.0
WIND_RISK_REF = 18.0
DENSITY_RISK_REF = 100.0
CANOPY_RISK_REF = 20.0
ALTITUDE_BASE_M = 200.0
ALTITUDE_TOP_M = 1708.0
MISSING_RISK = 0.5

# Step risks: (upper edge, risk) pairs and the risk above the last edge.
STEP_SLOPE = {"landing": (((7, 0.00), (15, 0.60)), 1.00),
              "hoist": (((7, 0.00), (15, 0.15), (25, 0.30), (40, 0.70)), 1.00)}
STEP_DENSITY = {"light": (((10, 0.00), (30, 0.10), (70, 0.60)), 1.00),
                "heavy": (((10, 0.00), (30, 0.30), (70, 0.85)), 1.00)}
STEP_HEIGHT = {"light": (((2, 0.00), (8, 0.30), (17, 0.60)), 0.85),
               "heavy": (((2, 0.00), (8, 0.45), (17, 0.75)), 0.95)}
STEP_WIND = {"light": (((5, 0.00), (10, 0.40), (15, 0.80)), 1.00),
             "heavy": (((5, 0.00), (10, 0.20), (15, 0.50)), 0.90)}
STEP_WIND_DIR = {"light": (0.70, 0.95), "heavy": (0.50, 0.885)}

# Operating limits.
WIND_LIMIT = {"light": 10.0, "heavy": 20.0}
WIND_LIMIT_DEFAULT = 15.0
WIND_PENALTY_FROM = 10.0
HOIST_MAX_WIND = 18.0
HOIST_MAX_SLOPE = 40.0
HOIST_SLOPE_RELIEF = 10.0
HOIST_MAX_CANOPY = 12.0
WORK_ALTITUDE_M = 60.0
CRUISE_SPEED_MS = 42.0
FLIGHT_MARGIN_M = 150.0
FALLBACK_WIND = (6.5, 270.0)

# Interpolation.
IDW_VERTICAL_SCALE = 180.0
IDW_POWER = 2.0
IDW_ZERO_M = 1e-6
WIND_PROFILE_ALPHA = 0.27
WIND_REF_HEIGHT = 10.0

# Terrain layer.
CURVATURE_SPACING_M = 15.0
RIDGE_CURVATURE = 0.02
OPEN_CANOPY_M = 0.0
FOREST_CANOPY_M = 10.0
FOREST_DENSITY = 0.6
FOREST_RATIO_FROM = 0.5

# Routing.
ROUTE_CELL_M = 10.0
DIAGONAL = 1.414
FLIGHT_MARGIN_CELLS = 50
WALK_MARGIN_CELLS = 20
FLIGHT_WEIGHTS = {"wind_dir": 0.6, "wind_speed": 0.5, "ridge": 0.3, "climb": 0.3}
WALK_WEIGHTS = {"density": 1.5, "canopy": 0.5}
CLIFF_SLOPE = 45.0
CLIFF_GOAL_COST = 9999.0
ESCALATION = ((0, 50, None), (1, 75, None), (2, 100, 18.0), (3, 100, 20.0))
CORRIDOR_COST = 5.0

# Path decisions.
PATH_RISK_WEIGHTS = {"wind": 0.2, "slope": 0.5, "forest": 0.2, "ridge": 0.1}
LOCK_WIND = 12.0
LOCK_BAND = 1.0
REROUTE_GAIN = 0.25
DIRECTION_DISCOUNT = 0.15
DIRECTION_LOOKAHEAD = 3

# Lambert conformal conic forecast grid (km, degrees, grid offsets).
LCC = {"radius_km": 6371.00877, "grid_km": 5.0, "lat1": 30.0, "lat2": 60.0,
       "lon0": 126.0, "lat0": 38.0, "x0": 43.0, "y0": 136.0}

# Training-set augmentation.
SCENARIO_WINDS_FULL = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0)
SCENARIO_WINDS_BASIC = (0.0, 15.0)
BLOCK_SLOPE = 45.0
BLOCK_DENSITY = 2.0
SENSITIVITY_WINDS = (0.0, 5.0, 10.0, 15.0, 25.0)
FEATURES = ("elevation", "slope_grade", "density_grade", "height_grade", "wind_speed",
            "wind_dir_sin", "wind_dir_cos", "land_0", "land_1", "land_2",
            "tree_risk", "aero_risk", "slope_wind_risk")
