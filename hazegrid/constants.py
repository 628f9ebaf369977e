"""Fixed values of the air-quality domain (tables, thresholds, texts, patterns)."""

# --- Fixed values: EPA breakpoints as (c_low, c_high, i_low, i_high) -----------------
BREAKPOINTS = {
    "pm2_5": [
        (0.0, 12.0, 0, 50),
        (12.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 150.4, 151, 200),
        (150.5, 250.4, 201, 300),
        (250.5, 350.4, 301, 400),
        (350.5, 500.4, 401, 500),
    ],
    "pm10": [
        (0, 54, 0, 50),
        (55, 154, 51, 100),
        (155, 254, 101, 150),
        (255, 354, 151, 200),
        (355, 424, 201, 300),
        (425, 504, 301, 400),
        (505, 604, 401, 500),
    ],
    "co": [
        (0.0, 4.4, 0, 50),
        (4.5, 9.4, 51, 100),
        (9.5, 12.4, 101, 150),
        (12.5, 15.4, 151, 200),
        (15.5, 30.4, 201, 300),
        (30.5, 40.4, 301, 400),
        (40.5, 50.4, 401, 500),
    ],
    "so2": [
        (0.0, 35, 0, 50),
        (36, 75, 51, 100),
        (76, 185, 101, 150),
        (186, 304, 151, 200),
        (305, 604, 201, 300),
        (605, 804, 301, 400),
        (805, 1004, 401, 500),
    ],
    "o3": [
        (0.0, 54, 0, 50),
        (55, 70, 51, 100),
        (71, 85, 101, 150),
        (86, 105, 151, 200),
        (106, 200, 201, 300),
    ],
    "no2": [
        (0, 53, 0, 50),
        (54, 100, 51, 100),
        (101, 360, 101, 150),
        (361, 649, 151, 200),
        (650, 1249, 201, 300),
        (1250, 1649, 301, 400),
        (1650, 2049, 401, 500),
    ],
}
# Unit each pollutant's table is written in, and its precision (decimals).
TABLE_UNIT = {"pm2_5": "ug/m3", "pm10": "ug/m3", "co": "ppm", "so2": "ppb", "o3": "ppb", "no2": "ppb"}
TABLE_DECIMALS = {"pm2_5": 1, "pm10": 0, "co": 1, "so2": 0, "o3": 0, "no2": 0}

# Molar masses (g/mol) and molar volume (l/mol) for ug/m3 -> ppb.
MOLAR_MASS = {"co": 28.01, "no2": 46.01, "so2": 64.07, "o3": 48.00, "co2": 44.01}
MOLAR_VOLUME = 24.45
MS_TO_KMH = 3.6

# --- Fixed values: bands -------------------------------------------------------------
# Closed bands with gaps between them; anything outside is "Hazardous".
STRICT_BANDS = [
    (0, 50, "Good", "aqi-good"),
    (51, 100, "Moderate", "aqi-moderate"),
    (101, 150, "Unhealthy for Sensitive Groups", "aqi-unhealthy-sensitive"),
    (151, 200, "Unhealthy", "aqi-unhealthy"),
    (201, 300, "Very Unhealthy", "aqi-very-unhealthy"),
]
STRICT_ELSE = ("Hazardous", "aqi-hazardous")

# Contiguous bands by upper bound: (upper, label, advice).
RISK_BANDS = [
    (50, "Excellent", "Enjoy outdoor activities! Air quality is good."),
    (100, "Moderate", "Safe for most, but sensitive groups should monitor symptoms."),
    (150, "Unhealthy for Sensitive Groups",
     "Limit prolonged outdoor exertion, especially for children, elderly, and those with respiratory issues."),
    (200, "Unhealthy", "Everyone should reduce outdoor activities. Sensitive groups should avoid them."),
    (300, "Very Unhealthy", "Health warnings of emergency conditions. Avoid all outdoor exertion."),
    (None, "Hazardous", "Serious health effects. Remain indoors and keep windows closed."),
]
# (upper, status, description)
STATUS_BANDS = [
    (50, "Excellent Air Quality", "Perfect for all outdoor activities"),
    (100, "Good Air Quality", "Safe for everyone"),
    (150, "Moderate Air Quality", "Sensitive groups be cautious"),
    (None, "Unhealthy Air Quality", "Limit outdoor exposure"),
]
# (upper score, level, advice, severity)
RISK_SCORES = [
    (2, "Low Risk", "You're generally safe!", "success"),
    (4, "Moderate Risk", "Take some precautions", "warning"),
    (6, "High Risk", "Limit outdoor exposure", "error"),
    (None, "Very High Risk", "Stay indoors!", "error"),
]
# Four recommendations per status band: (upper, [(title, text), ...]).
RECOMMENDATIONS = [
    (50, [
        ("Exercise", "Perfect for outdoor running and sports"),
        ("Windows", "Open windows for fresh air circulation"),
        ("Children", "Safe for extended outdoor play"),
        ("Activities", "Ideal for gardening and outdoor work"),
    ]),
    (100, [
        ("Exercise", "Good for walking and light activities"),
        ("Indoor", "Consider indoor activities for sensitive people"),
        ("General", "Safe for most healthy adults"),
        ("Timing", "Best outdoor time is early morning"),
    ]),
    (150, [
        ("Exercise", "Limit intense outdoor activities"),
        ("Masks", "Consider N95 masks when outside"),
        ("Sensitive Groups", "Children and elderly stay indoors"),
        ("Windows", "Keep windows closed"),
    ]),
    (None, [
        ("Stay Indoors", "Avoid outdoor activities"),
        ("Masks", "Essential when going outside"),
        ("Air Purifiers", "Use HEPA filters at home"),
        ("Health", "Monitor respiratory symptoms"),
    ]),
]
# Hazard alerts, highest first: (threshold, type, title, text after "AQI n - ", minutes shown).
ALERT_LEVELS = [
    (301, "error", "CRITICAL: Hazardous Air Quality", "Emergency conditions! Stay indoors immediately.", 30),
    (300, "error", "DANGEROUS: Very Unhealthy Air", "Health emergency for all! Avoid outdoor activities.", 20),
    (200, "warning", "ALERT: Unhealthy Air Quality", "Health effects for everyone. Limit outdoor exposure.", 15),
    (150, "warning", "CAUTION: Unhealthy for Sensitive Groups",
     "Sensitive individuals should avoid outdoor activities.", 10),
]
# Ranking by air quality: rank -> (medal, title); ranks beyond have none.
RANK_MEDALS = [
    (1, "gold", "Best Air Quality"),
    (2, "silver", "Moderate Quality"),
    (3, "bronze", "Needs Attention"),
]
# Forecast horizon in hours -> display label.
HORIZON_LABELS = {24: "Today", 48: "Tomorrow", 72: "Day After Tomorrow"}
HORIZONS = (24, 48, 72)
# Default feature values by substring of the lower-cased name, first match wins, else 0.
DEFAULT_BY_NAME = [
    (("aqi",), 50.0),
    (("temp",), 25.0),
    (("humidity",), 60.0),
    (("wind",), 5.0),
    (("pm25", "pm10", "o3", "no2", "so2", "co"), 10.0),
]
DEFAULT_OTHER = 0.0

# Type, title, message and minutes of the alert for a poll without a value.
UNAVAILABLE_ALERT = ("warning", "Data Unavailable", "Unable to fetch current AQI data. Please check your connection.", 5)

# --- Fixed values: feature engineering -----------------------------------------------
POLLUTANTS = ("pm2_5", "pm10", "co", "no2", "so2", "o3")
WEATHER = ("temperature", "humidity", "wind_speed", "wind_direction")
LAG_OFFSETS = (0, 12, 24, 48, 72, 96)
TARGET_ROLLS = (24, 48, 72)
POLLUTANT_ROLLS = {"pm10": (24,), "pm2_5": (24,), "co": (24, 48), "no2": (24, 48), "so2": (24, 48), "o3": (24, 48)}
RATE_CHANGES = (24, 48, 72)
FEATURES_KEPT = {24: 10, 48: 15, 72: 8}
STORE_COLUMNS = ("temperature", "humidity", "wind_speed", "wind_direction", "pm2_5", "pm10",
                 "co", "so2", "o3", "no2", "aqi", "hour", "day", "weekday")
HISTORY_COLUMNS = ("aqi", "pm25", "pm10", "o3", "no2", "so2", "co",
                   "temperature", "humidity", "wind_direction", "wind_speed")

# --- Fixed values: validation and registry --------------------------------------------
CV_TRAIN, CV_TEST, CV_STEP = 8 * 7 * 24, 4 * 7 * 24, 2 * 24
SUSPICIOUS_NAMES = ("future", "ahead", "target")
BEST_MODEL_PATTERNS = (
    r"The best model for \d+h is ([A-Za-z]+)",
    r"Best model: ([A-Za-z]+)",
    r"Model: ([A-Za-z]+)",
)
CANONICAL_MODELS = {
    "extratrees": "ExtraTrees",
    "catboost": "CatBoost",
    "xgboost": "XGBoost",
    "lightgbm": "LightGBM",
    "gradientboosting": "GradientBoosting",
    "randomforest": "RandomForest",
    "decisiontree": "DecisionTree",
}
MODEL_FORMATS = {
    "CatBoost": "cbm",
    "XGBoost": "json",
    "LightGBM": "txt",
    "GradientBoosting": "pkl",
    "ExtraTrees": "pkl",
    "RandomForest": "pkl",
    "DecisionTree": "pkl",
}
DEFAULT_FORMAT = "pkl"
