"""Fixed values.

Everything in this file is data that results depend on: name hints, text tokens, labels, unit spellings,
conversion constants and option bounds. Nothing here is computed.
"""

# Column-name hints, matched as lower-case substrings.
TIME_HINTS = ("time", "date", "datetime", "timestamp", "year", "month", "day")
LATITUDE_HINTS = ("lat", "latitude", "y")
LONGITUDE_HINTS = ("lon", "lng", "longitude", "x")
VARIABLE_HINTS = (
    "temp", "temperature", "precip", "precipitation", "rain", "humidity", "wind", "pressure", "co2",
)
TEMPERATURE_HINTS = ("temp", "temperature")
PRECIPITATION_HINTS = ("precip", "rain")

# Role inference.
DATETIME_MIN_SHARE = 0.8

# File suffix -> format.
FILE_FORMATS = {
    ".csv": "csv",
    ".grb": "grib",
    ".grib": "grib",
    ".grib2": "grib",
    ".nc": "netcdf",
    ".parquet": "parquet",
    ".tif": "geotiff",
    ".tiff": "geotiff",
    ".xls": "xlsx",
    ".xlsx": "xlsx",
}

# CSV cells read as missing (the default list of pandas.read_csv).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Datetime patterns tried on text that is not in ISO form, most specific first.
DATETIME_PATTERNS = (
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
    "yyyyMMddHHmmss", "yyyyMMdd",
    "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
)

# Period frequencies and their spellings.
FREQUENCY_NAMES = {
    "D": "D", "DAY": "D", "DAILY": "D",
    "M": "ME", "ME": "ME", "MONTH": "ME", "MONTHLY": "ME",
    "Y": "YE", "YE": "YE", "YEAR": "YE", "YEARLY": "YE",
}
FREQUENCY_LABELS = {"D": "daily", "ME": "monthly", "YE": "yearly"}
AGGREGATIONS = ("mean", "min", "max", "range", "sum", "count", "std")
DEFAULT_AGGREGATIONS = ("mean", "min", "max")

# Calendar labels.
SEASONS = ("winter", "spring", "summer", "autumn")
SEASON_MONTHS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}
MONTH_LABELS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# The 1991-2020 climate normal used when no baseline is asked for.
NORMAL_START = "1991-01-01"
NORMAL_END = "2020-12-31"

# Option defaults and bounds (default, lowest, highest).
HIGH_QUANTILE = (0.95, 0.5, 0.999)
LOW_QUANTILE = (0.05, 0.001, 0.5)
HOUR_OFFSET = (0.0, -14.0, 14.0)
HISTOGRAM_BINS = (50, 10, 100)
Z_THRESHOLD = 2.0
FOREST_TREES = 200
FORECAST_LAGS = 6
FORECAST_HORIZON = 12
GRID_LAT_BINS = 45
GRID_LON_BINS = 90
PREVIEW_ROWS = (100, 1, 1000)
ROLLING_WINDOW = 7

# Smallest inputs an analysis accepts.
MIN_ROWS = 3
MIN_PERIODS = 3
MIN_YEARS = 3
MIN_HOURS = 2
MIN_REGRESSION_ROWS = 10
MIN_FOREST_ROWS = 30
FORECAST_EXTRA_ROWS = 5

# Unit conversion.
KELVIN_OFFSET = 273.15
KMH_PER_MS = 3.6
MPH_PER_MS = 2.2369362921
PA_PER_HPA = 100.0

# Recipe operation -> suffix of the suggested output name.
RECIPE_SUFFIXES = {
    "kelvin_to_celsius": "c",
    "kelvin_to_fahrenheit": "f",
    "celsius_to_kelvin": "k",
    "ms_to_kmh": "kmh",
    "ms_to_mph": "mph",
    "pa_to_hpa": "hpa",
    "multiply_constant": "mul",
    "divide_constant": "div",
    "add_constant": "add",
    "subtract_constant": "sub",
    "rolling_mean": "rollmean",
    "aggregate_by_day": "daymean",
    "aggregate_by_month": "monthmean",
}

# Unit spellings (lower case) -> (recipe operation, reason).
UNIT_RECIPES = {
    "k": ("kelvin_to_celsius", "its unit is kelvin"),
    "kelvin": ("kelvin_to_celsius", "its unit is kelvin"),
    "pa": ("pa_to_hpa", "its unit is pascal"),
    "pascal": ("pa_to_hpa", "its unit is pascal"),
    "pascals": ("pa_to_hpa", "its unit is pascal"),
    "m/s": ("ms_to_kmh", "its unit is metre per second"),
    "m s-1": ("ms_to_kmh", "its unit is metre per second"),
    "m s**-1": ("ms_to_kmh", "its unit is metre per second"),
    "mps": ("ms_to_kmh", "its unit is metre per second"),
}
KELVIN_NAME_SUFFIX = "_k"
KELVIN_NAME_REASON = "its name ends like that of a kelvin column"

# Tables tried in this order when one table has to stand for a whole result.
PRIMARY_TABLES = ("summary", "monthly_pattern", "seasonal_pattern", "anomalies", "forecast")
