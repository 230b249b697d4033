"""Texts, bounds and tables that results must match exactly."""

FORECAST_ZONE = "Europe/Sofia"

# --- Domains -----------------------------------------------------------------
AVAILABLE_STATUSES = ["mock", "manual", "baseline", "real"]
MISSING = "missing"
CONFIDENCE_LEVELS = ["low", "medium", "high"]
RISK_LEVELS = ["low", "medium", "high"]
CONVERGENCE_SIGNALS = ["absent", "weak", "moderate", "strong"]
MAX_SAFE_INTEGER = 9007199254740991

# --- Patterns ----------------------------------------------------------------
# \z instead of $: the dollar sign would also match before a final line break.
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}\z"
INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?Z\z"
SLUG_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
SLUG_MAX_LENGTH = 80

# --- Sizes -------------------------------------------------------------------
MAX_SUMMARY_SITES = 7
COMPARISON_SITE_COUNT = 3
STRIP_DAYS = 5
STRIP_TODAY_INDEX = 2
MAX_WIND_LEVELS = 6

# --- Seed site catalog: id, slug, name, latitude, longitude ---------------------
SEED_SITES = [
    (1, "sofia-vitosha-kominite", "Sofia - Vitosha (Kominite)", 42.60222, 23.28927),
    (2, "zlatitsa", "Zlatitsa", 42.71506, 24.13749),
    (3, "sopot", "Sopot", 42.68776, 24.74996),
    (4, "nevsha", "Nevsha", 43.27155, 27.29945),
    (5, "shumen", "Shumen", 43.27667, 26.92917),
    (6, "pastrina", "Pastrina", 43.42481, 23.30355),
    (7, "dobrich-region", "Dobrich region", 43.56667, 27.83333),
]

# --- Scenario adjustments: day offset, cloudbase, 100, 200, 300 km points -------
DAY_ADJUSTMENTS = [
    (-2, -150, -10, -5, -2),
    (-1, -75, -5, -2, -1),
    (0, 0, 0, 0, 0),
    (1, 100, 8, 4, 1),
    (2, 50, -3, -1, 0),
]

# --- Labels ------------------------------------------------------------------
STATUS_LABELS = {
    "baseline": "Baseline data",
    "manual": "Manual data",
    "missing": "Unavailable",
    "mixed": "Mixed data",
    "mock": "Mock data",
    "real": "Real data",
}
CONFIDENCE_LABELS = {
    "high": "High confidence",
    "low": "Low confidence",
    "medium": "Medium confidence",
    "mixed": "Mixed confidence",
    "unavailable": "Confidence unavailable",
}
CONFIDENCE_SEGMENTS = {"high": 3, "medium": 2, "low": 1, "mixed": 0, "unavailable": 0}
UNAVAILABLE_TEXT = "Unavailable"
TODAY_TEXT = "Today"

# Output panel: output field, label, unit suffix.
OUTPUT_PANEL = [
    ("cloudbaseMslM", "Cloudbase", " m MSL"),
    ("chance100KmPct", "100+ km chance", "%"),
    ("chance200KmPct", "200+ km chance", "%"),
    ("chance300KmPct", "300+ km chance", "%"),
    ("overdevelopmentRisk", "Overdevelopment", ""),
]
# Order in which outputs are read for the roll-ups.
ROLLUP_ORDER = [
    "chance100KmPct",
    "cloudbaseMslM",
    "chance200KmPct",
    "chance300KmPct",
    "overdevelopmentRisk",
]

# Input panel: input field, label, unit suffix, kind of text.
INPUT_PANEL = [
    ("surfaceTemperatureC", "Surface temperature", " °C", "number"),
    ("dewPointC", "Dew point", " °C", "number"),
    ("boundaryLayerHeightM", "Boundary-layer height", " m", "integer"),
    ("thermalStrengthMps", "Thermal strength", " m/s", "number"),
    ("boundaryLayerWindSpeedKmh", "Boundary-layer wind", " km/h", "number"),
    ("boundaryLayerWindDirectionDeg", "BL wind direction", "°", "number"),
    ("windByAltitude", "Wind by altitude", "", "wind"),
    ("windShearMpsPerKm", "Wind shear", " m/s/km", "number"),
    ("relativeHumidityPct", "Relative humidity", "%", "number"),
    ("capeJPerKg", "CAPE", " J/kg", "number"),
    ("cinJPerKg", "CIN", " J/kg", "number"),
    ("lapseRateCPerKm", "Lapse rate", " °C/km", "number"),
    ("lowCloudCoverPct", "Low cloud", "%", "number"),
    ("totalCloudCoverPct", "Total cloud", "%", "number"),
    ("precipitationMm", "Precipitation", " mm", "number"),
    ("surfacePressureHpa", "Surface pressure", " hPa", "number"),
    ("convergenceSignal", "Convergence", "", "word"),
]

# Input bounds: field -> (least, greatest); None is open.
INPUT_BOUNDS = {
    "surfaceTemperatureC": (-80, 70),
    "dewPointC": (-100, 70),
    "boundaryLayerHeightM": (0, None),
    "thermalStrengthMps": (-10, 20),
    "boundaryLayerWindSpeedKmh": (0, None),
    "boundaryLayerWindDirectionDeg": (0, 360),
    "windShearMpsPerKm": (0, None),
    "relativeHumidityPct": (0, 100),
    "capeJPerKg": (0, None),
    "cinJPerKg": (0, None),
    "lapseRateCPerKm": (-20, 20),
    "lowCloudCoverPct": (0, 100),
    "totalCloudCoverPct": (0, 100),
    "precipitationMm": (0, None),
    "surfacePressureHpa": (800, 1100),
}
# Output bounds.
OUTPUT_BOUNDS = {
    "cloudbaseMslM": (0, None),
    "chance100KmPct": (0, 100),
    "chance200KmPct": (0, 100),
    "chance300KmPct": (0, 100),
}

# --- Message texts -------------------------------------------------------------
NO_FORECAST = "No forecast exists for site '%s' on %s."
NO_DAY_FORECAST = "No 100+ km forecast is available for site '%s' on %s."
NO_SITE = "No forecast site exists for slug '%s'."
INVALID_REQUEST = "The request parameters are invalid."
DATE_FORMAT_MESSAGE = "Expected a date in YYYY-MM-DD format."
DATE_REAL_MESSAGE = "Expected a real calendar date."
UNIQUE_SLUGS_MESSAGE = "Expected unique site slugs."
SUMMARY_DATE_MESSAGE = "Expected the summary date to match the response date."
SUMMARY_ID_MESSAGE = "Expected one summary per site ID."
SUMMARY_SLUG_MESSAGE = "Expected one summary per site slug."
SUMMARY_ORDER_MESSAGE = "Expected summaries to be ordered by ascending site ID."
STRIP_DATE_MESSAGE = "Expected forecast date %s."
CHANCE_100_200_MESSAGE = "The 100+ km chance cannot be lower than the 200+ km chance."
CHANCE_200_300_MESSAGE = "The 200+ km chance cannot be lower than the 300+ km chance."
CHANCE_100_300_MESSAGE = "The 100+ km chance cannot be lower than the 300+ km chance."
DUPLICATE_ID_MESSAGE = "Duplicate site ID: %s"
DUPLICATE_SLUG_MESSAGE = "Duplicate site slug: %s"
PROBLEM_FIELD_MESSAGE = "Expected %s to match problem code %s."
OTHER_DAYS_SITE_MESSAGE = "The forecast service returned days for a different location."
OTHER_SUMMARY_DATE_MESSAGE = "The forecast service returned summaries for a different date."
OTHER_SUMMARY_SITE_MESSAGE = (
    "The forecast service returned a summary for an unrequested location."
)
OTHER_DETAIL_MESSAGE = (
    "The forecast service returned a detailed forecast for a different location or date."
)
CARD_UNAVAILABLE = "100 or more kilometre chance unavailable. "
CARD_CHANCE = " percent chance of 100 or more kilometres. "

# A request id has 1 to 128 of these characters.
REQUEST_ID_PATTERN = r"\A[A-Za-z0-9._:-]{1,128}\z"

# --- Problem codes: code, title, status ----------------------------------------
PROBLEM_CODES = [
    ("VALIDATION_ERROR", "Invalid request", 400),
    ("SITE_NOT_FOUND", "Site not found", 404),
    ("FORECAST_NOT_FOUND", "Forecast not found", 404),
    ("ROUTE_NOT_FOUND", "Route not found", 404),
    ("RESPONSE_CONTRACT_ERROR", "Response contract failure", 500),
    ("INTERNAL_SERVER_ERROR", "Internal server error", 500),
]

# --- Rule messages of this library (the checks are fixed, the wording is ours) ---
WRONG_ID = "Expected a whole number from 1 to 9007199254740991."
WRONG_SLUG = "Expected a slug of 1 to 80 lower-case letters, digits and single dashes."
WRONG_NAME = "Expected a text that is not blank."
WRONG_NUMBER = "Expected a finite number within bounds."
WRONG_WORD = "Expected one of the allowed words."
WRONG_INSTANT = "Expected an ISO instant that ends in Z."
WRONG_COUNT = "Expected an allowed number of items."
WRONG_BRANCH = "Expected the fields of one branch: available or missing."
WRONG_ZONE = "Expected the time zone Europe/Sofia."
REQUIRED = "Expected a single value."
UNKNOWN_FIELD = "Unrecognized field: %s"
WRONG_TYPE = "Expected another JSON type."
WRONG_SHAPE = "Expected the declared keys with their JSON types."
WRONG_REQUEST_ID = "Expected 1 to 128 letters, digits, dots, dashes, colons or underscores."
