"""Window lengths, guards, names and labels that results depend on."""

# Column names of a daily bar.
KEY, TIME = "symbol", "date"
BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]
VALUE_COLUMNS = ["open", "high", "low", "close", "volume"]

# Window lengths in rows.
SMA_WINDOWS = [5, 10, 20, 50, 100, 200]
EMA_SPANS = [5, 10, 20, 50, 100, 200]
PRICE_VS_SMA_WINDOWS = [5, 20, 50, 200]
RSI_WINDOWS = [14, 7]
MACD_SPANS = (12, 26, 9)
ROC_STEPS = [1, 5, 10, 20]
LAG_STEPS = [1, 2, 3, 5, 10, 20]
TRADING_DAYS = 252

# Guards added to denominators.
RATIO_GUARD = 1e-9
MAPE_GUARD = 1e-8

# Choices offered for the label horizon and the forecast length.
HORIZONS = [1, 5, 21]
FORECAST_LENGTHS = [7, 14, 30, 60]

# Stand-ins when a context series has no rows at all.
VIX_WHEN_EMPTY = 20.0
RETURN_WHEN_EMPTY = 0.0

# Signal bands (upper, lower).
RSI_BANDS = (70, 30)
STOCHASTIC_BANDS = (80, 20)
WILLIAMS_BANDS = (-20, -80)
CCI_BANDS = (100, -100)

# Symbols offered by default, with their display names.
UNIVERSE = [
    ("AAPL", "Apple (AAPL)"),
    ("MSFT", "Microsoft (MSFT)"),
    ("NVDA", "NVIDIA (NVDA)"),
    ("GOOGL", "Alphabet (GOOGL)"),
    ("AMZN", "Amazon (AMZN)"),
    ("TSLA", "Tesla (TSLA)"),
    ("META", "Meta (META)"),
    ("BRK-B", "Berkshire (BRK-B)"),
    ("JPM", "JPMorgan (JPM)"),
    ("SPY", "S&P 500 ETF (SPY)"),
    ("IBIT", "Bitcoin ETF (IBIT)"),
]

# Default history length in days.
DEFAULT_HISTORY_DAYS = 5 * 365

# Company facts, text fields with defaults and numeric fields.
COMPANY_TEXT_DEFAULTS = {"sector": "N/A", "industry": "N/A", "recommendationKey": "N/A"}
COMPANY_NUMBERS = [
    "marketCap",
    "trailingPE",
    "forwardPE",
    "priceToBook",
    "dividendYield",
    "beta",
    "fiftyTwoWeekHigh",
    "fiftyTwoWeekLow",
    "averageVolume",
    "currentPrice",
    "targetMeanPrice",
    "shortRatio",
    "trailingEps",
    "revenueGrowth",
]

# Names by month (1..12) and by weekday (Monday = 0).
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Feature groups and the name parts that put a feature into a group.
FEATURE_GROUPS = {
    "Moving Averages": ["SMA_", "EMA_", "Price_vs", "GoldenCross"],
    "Momentum": ["RSI", "MACD", "Stoch", "Williams", "CCI", "ROC"],
    "Volatility": ["BB_", "ATR", "HV"],
    "Volume": ["OBV", "Volume"],
    "Price Action": ["HL_Range", "OC_Range", "Shadow", "Daily_Return"],
    "Lag Features": ["_Lag"],
    "Time Features": ["DOW", "Month", "Quarter", "Week", "DayOf"],
    "Market Context": ["VIX", "SP500"],
}

# Market regimes.
REGIME_COUNT = 3
REGIME_LABELS = {0: "Bullish / Low-Vol", 1: "High-Vol / Uncertain", 2: "Bearish / Drawdown"}
REGIME_MIN_ROWS = 30
ELBOW_RANGE = range(2, 9)
KMEANS_RESTARTS = 10
SEED = 42

# Model names, in registry order (ties in the choice of the best go to the first).
LINEAR = "Linear Regression"
RIDGE = "Ridge Regression"
FOREST = "Random Forest"
XGBOOST = "XGBoost"
BOOSTING = "Gradient Boosting"
MODEL_NAMES = [LINEAR, RIDGE, FOREST, XGBOOST, BOOSTING]

# Metric names.
METRIC_NAMES = ["RMSE", "MAE", "R2", "MAPE", "Direction_Acc"]

# Columns (lower-cased) that are never features.
NOT_FEATURES = {
    "symbol",
    "date",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "adj close",
    "dividends",
    "stock splits",
    "target",
    "ma5",
    "ma20",
    "pos",
    "n_rows",
}

# Rational approximations of the normal quantile (Wichura, AS 241), lowest power first.
# (numerator, denominator) near the centre, in the tails, and far out in the tails.
NORMAL_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
NORMAL_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
NORMAL_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
