"""Fixed values of the domain."""

# Camera number -> approach it films.
CAMERA_DIRECTIONS = {1: "north", 2: "east", 3: "south", 4: "west"}
DIRECTIONS = ["north", "east", "south", "west"]

# Zone names.
ENTER = "enter"
EXIT = "exit"
CIRCULATING_LEFT = "circulating_left"
CIRCULATING_RIGHT = "circulating_right"
CIRCULATING = [CIRCULATING_LEFT, CIRCULATING_RIGHT]

# (start zone, end zone) pairs that count as a journey.
JOURNEY_PATTERNS = [
    (CIRCULATING_LEFT, CIRCULATING_RIGHT),
    (CIRCULATING_LEFT, EXIT),
    (ENTER, CIRCULATING_RIGHT),
]

# Origin-destination pairs that get a column of their own.
OD_PAIRS = [
    (ENTER, CIRCULATING_RIGHT),
    (ENTER, EXIT),
    (CIRCULATING_LEFT, CIRCULATING_RIGHT),
    (CIRCULATING_LEFT, EXIT),
]

# Vehicle classes with a count column of their own.
COUNTED_CLASSES = ["car", "truck", "bus", "motorcycle"]

# Congestion labels by severity 0..3; missing is -1.
CONGESTION = ["free flowing", "light delay", "moderate delay", "heavy delay"]
MISSING = -1

RUSH_HOURS = [7, 8, 9, 16, 17, 18]
WINDOW_SECONDS = 300.0
LAGS = [1, 2, 3]
ROLLING = [3, 6, 12]
SHIFT = 7

LAG_METRICS = [
    "entry_count", "entry_flow_rate", "exit_count", "exit_flow_rate",
    "circulating_occupancy_avg", "circulating_flow_rate", "speed_avg_km_h",
]
ROLLING_METRICS = [
    "entry_count", "entry_flow_rate", "exit_count", "exit_flow_rate",
    "circulating_occupancy_avg", "speed_avg_km_h",
]

# Per-camera features carried into the fused table.
FUSED_FEATURES = [
    "entry_count", "exit_count", "entry_flow_rate", "exit_flow_rate",
    "entry_count_car", "entry_count_truck", "entry_count_bus",
    "exit_count_car", "exit_count_truck", "exit_count_bus",
    "circulating_occupancy_avg", "circulating_occupancy_max", "circulating_flow_rate",
    "speed_avg_km_h", "speed_std_km_h", "entry_speed_avg_km_h", "circulating_speed_avg_km_h",
    "entry_exit_balance", "entry_circulating_ratio", "circulating_density",
]
TIME_FEATURES = ["hour_of_day", "day_of_week", "is_weekend", "is_rush_hour", "time_since_midnight"]

# Video file endings of the catalog queries.
VIDEO_ENDINGS = [".mp4", ".avi", ".mov"]

PHASES = ["train", "test_input_15", "test_output_5"]
