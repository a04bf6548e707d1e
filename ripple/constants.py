"""Fixed values that must equal the original application's for equal results.

FIXED VALUES — keep exactly as listed (domain rules of the incident
application: token lists, category sets, thresholds, lookup tables).
"""

# ---- FIXED VALUES: cleaning -------------------------------------------------
NULL_TOKENS = ("NULL", "nan")
NOISE_CAUSE = "test_demo"
DEFAULT_CORRIDOR = "Non-corridor"
DEFAULT_PRIORITY = "Low"
DEFAULT_ZONE = "Unknown"
DEFAULT_JUNCTION = "Unknown"
DEFAULT_CAUSE = "others"
NOT_NAMED_CORRIDORS = ("Non-corridor", "NULL", "")
LOCAL_TZ = "Asia/Kolkata"

# ---- FIXED VALUES: vehicles -------------------------------------------------
VEHICLE_UNKNOWN_TOKENS = ("nan", "", "0")
HEAVY_TYPES = ("heavy_vehicle", "truck", "bmtc_bus", "ksrtc_bus", "private_bus")
VEHICLE_CATEGORIES = (
    ("public_transit", ("bmtc_bus", "ksrtc_bus")),
    ("freight", ("heavy_vehicle", "truck", "lcv")),
    ("private", ("private_car", "private_bus", "taxi", "auto")),
)

# ---- FIXED VALUES: causes and time ------------------------------------------
CIVIC_CAUSES = ("public_event", "procession", "vip_movement", "protest")
CIVIC_GROUP = "civic_event"
SEED_CAUSES = ("water_logging", "tree_fall", "pot_holes", "construction")
PEAK_HOURS = ((19, 22), (4, 6))
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
             "Saturday", "Sunday")

# ---- FIXED VALUES: cascade labelling ----------------------------------------
FOLLOW_MINUTES = 120
MIN_FOLLOWERS = 3
DASHBOARD_FOLLOW_MINUTES = 130
DASHBOARD_MIN_FOLLOWERS = 4
LOOKBACK_HOURS = (2, 6)
SEED_LOOKBACK_HOURS = 3
VALID_RESOLUTION_MAX = 43200          # 30 days, dashboard KPI
REPORT_RESOLUTION_MAX = 20000         # descriptive report

# ---- FIXED VALUES: alerts and deployment ------------------------------------
RESOURCE_CAPS = (("traffic_police", 50), ("breakdown_units", 8), ("barricades", 20))
CONFIDENCE_BANDS = ((0.70, "HIGH"), (0.40, "MEDIUM"))   # else LOW
TIER_CUTS = ((0.60, "RED"), (0.30, "AMBER"))            # else GREEN
# (min risk, police, breakdown, barricades, priority flag)
BASE_REQUESTS = ((0.70, 4, 2, 3, "PRIORITY DEPLOYMENT"),
                 (0.40, 3, 1, 2, ""),
                 (0.00, 2, 0, 1, ""))
AVG_RESOLUTIONS = {
    "vehicle_breakdown": 58,
    "accident": 48,
    "water_logging": 4358,
    "pot_holes": 5047,
    "construction": 4351,
    "tree_fall": 2427,
    "road_conditions": 5989,
    "congestion": 75,
    "procession": 55,
    "civic_event": 191,
    "debris": 19190,
    "fog / low visibility": 120,
    "others": 2227,
}
DEFAULT_RESOLUTION_MIN = 60
RESOLUTION_SAMPLE_N = {
    "vehicle_breakdown": 6500,
    "water_logging": 400,
    "pot_holes": 450,
    "construction": 380,
    "tree_fall": 240,
    "accident": 300,
    "debris": 3,
    "road_conditions": 20,
    "others": 500,
    "civic_event": 60,
}
DEFAULT_SAMPLE_N = 100
LIMITED_DATA_N = 10
NEIGHBOUR_ZONES = {
    "Central Zone 2": "East Zone",
    "Central Zone 1": "West Zone",
    "North Zone 1": "North Zone 2",
    "North Zone 2": "North Zone 1",
    "South Zone 1": "South Zone 2",
    "South Zone 2": "South Zone 1",
}
DEFAULT_NEIGHBOUR = "neighboring zone"
TOP_CAUSE_EXPECTED = "vehicle_breakdown"
SHORTFALL_FLAG = "RESOURCE SHORTFALL: request backup"
ALLOCATED_FLAG = "ALLOCATED"
FEATURE_LABELS = {
    "hour_of_day": "Hour of day profile",
    "day_of_week": "Day of week pattern",
    "is_weekend": "Weekend traffic load",
    "is_peak_hour": "Peak commute hours",
    "is_heavy_vehicle": "Heavy vehicle risk",
    "corridor_risk_score": "Corridor baseline risk",
    "corridor_events_2h": "Recent event rate (2h)",
    "corridor_events_6h": "Persistent event rate (6h)",
    "seed_event_present_3h": "Recent infrastructure seeds",
    "cascade_density": "Historical cascade density",
    "event_cause_encoded": "Incident cause severity",
    "corridor_encoded": "Corridor local vulnerability",
}
CONTRIBUTION_FLOOR = 0.001
# what-if flags derived from the chosen cause
WHATIF_HEAVY_CAUSES = ("vehicle_breakdown", "construction", "accident")
WHATIF_SEED_CAUSES = ("water_logging", "pot_holes", "tree_fall", "construction")
WHATIF_CLOSURE_CAUSES = ("water_logging", "tree_fall", "accident")
# GREEN tier extras
GREEN_BREAKDOWN_CAUSES = ("accident", "vehicle_breakdown", "tree_fall")
GREEN_BARRICADE_CAUSES = ("accident", "water_logging", "tree_fall")

# ---- FIXED VALUES: models ---------------------------------------------------
FEATURES_A = (
    "hour_of_day", "day_of_week", "is_weekend", "is_peak_hour",
    "is_heavy_vehicle", "corridor_risk_score", "corridor_events_2h",
    "corridor_events_6h", "seed_event_present_3h", "cascade_density",
    "event_cause_encoded", "corridor_encoded",
)
FEATURES_B = (
    "hour_of_day", "day_of_week", "is_weekend", "is_peak_hour",
    "is_heavy_vehicle", "corridor_risk_score",
    "event_cause_encoded", "corridor_encoded", "secondary_count",
)
FEATURES_C = ("day_of_week", "hour_of_day", "corridor_encoded",
              "count_lag_1", "count_lag_24", "count_lag_168")
LAGS = (1, 24, 168)
RECALL_TARGET = 0.80
THRESHOLD_GRID = (0.1, 0.9, 9)
FINE_THRESHOLD_GRID = (0.1, 0.9, 81)
SPLIT_CUTOFF = "2024-04-01"
