"""Fixed values that results depend on.

FIXED VALUES: the strings, lists and constants below must keep exactly these
values for results to agree with the published pipeline's semantics.  They
are stated plainly and in their natural order; do not edit them casually.
"""

# --- FIXED VALUES: analysis defaults -------------------------------------
RETURN_LAGS = (1, 3, 5)
VOL_WINDOW = 22
PERSISTENCE_WINDOW = 3
TRAIN_FRACTION = 0.8
SEQ_LEN = 30
MIN_SEQ_ROWS = 40
TARGET_DAILY_VOL = 0.01
VOL_CLIP = (0.005, 0.1)
POSITION_CLIP = (0.0, 2.0)
ANNUALISATION = 252
FORWARD_HORIZON = 5
REGIME_THRESHOLDS = (0.015, 0.03)
REGIME_LABELS = ("Low Risk/Stable", "Moderate", "High Swing/Risk")
INGEST_CUTOFF = "2020-01-01"
SHORT_TEXT_LIMIT = 1000
LONG_TEXT_LIMIT = 10000
RETRY_TEXT_LIMIT = 2000
CALENDAR_SEARCH_DAYS = 7
SMOOTHING_DAYS = 30
APP_TIME_FRAMES = {"1 Month": 30, "3 Months": 90, "6 Months": 180, "1 Year": 365}
US_CLOSE = (16, 0)
US_OPEN = (9, 30)
EG_CLOSE = (14, 30)
EG_OPEN = (10, 0)

# --- FIXED VALUES: categories ----------------------------------------------
IMPACT_TYPES = ("Direct", "Indirect", "None")
US_ASSETS = ("NVDA", "USO")          # New York calendar
EG_ASSETS = ("EGX",)                 # Sunday to Thursday
SYMBOL_TO_ASSET = {
    "NASDAQ:NVDA": "NVDA",
    "ICEEUR:BRN1!": "USO",
    "EGX:EGX70EWI": "EGX",
}
MERGE_KEEP_KEYS = ("title", "lead", "category", "date", "author",
                   "provider", "tags", "body", "url")

# --- FIXED VALUES: feature sets ---------------------------------------------
FEATURES_BASELINE = ("log_return_1d", "log_return_3d", "log_return_5d", "vol_roc_1d")
FEATURES_FINBERT = FEATURES_BASELINE + ("finbert_mean",)
FEATURES_GEMMA = FEATURES_BASELINE + (
    "gemma_dispersion", "sentiment_persistence_3d", "article_impact_index",
    "gemma_conf_weighted", "direct_mean_score", "indirect_mean_score")
FEATURES_HYBRID = FEATURES_BASELINE + (
    "garch_residual", "gemma_dispersion", "sentiment_persistence_3d",
    "article_impact_index")
FEATURES_FORWARD = (
    "log_return_1d", "log_return_3d", "log_return_5d", "vol_roc_1d",
    "gemma_mean", "gemma_dispersion", "gemma_conf_weighted",
    "sentiment_persistence_3d", "article_impact_index")

# --- FIXED VALUES: scoring prompts (per asset, chosen by substring) --------
PROMPT_NVDA = """You are a quantitative financial analyst specializing in the semiconductor and technology sectors. Your task is to perform Target-Based Financial Sentiment Analysis.
TARGET ASSET: NVIDIA Corporation (NVDA)
ASSET CONTEXT: AI hardware, data centers, semiconductor supply chain, and global tech sector movements.
INSTRUCTIONS:
1. Entity Isolation: Determine if the news directly impacts NVDA, its supply chain, its competitors (e.g., AMD, Intel), or the broader tech macro-environment.
2. Reasoning: Provide a concise, step-by-step logical link between the news event and NVDA's potential stock price volatility.
3. Scoring: Assign a sentiment score from -1.0 (highly negative for NVDA) to 1.0 (highly positive for NVDA). Assign a confidence score from 0.0 (uncertain) to 1.0 (highly certain).
4. Strict Output: You must output ONLY a valid JSON object. Do not include markdown formatting, backticks, or any conversational text before or after the JSON.
OUTPUT SCHEMA:
{
"asset": "NVDA",
"reasoning": "string",
"impact_type": "Direct" | "Indirect" | "None",
"sentiment_score": float,
"confidence_score": float
}"""

PROMPT_BRENT = """You are a quantitative financial analyst specializing in global commodities and energy markets. Your task is to perform Target-Based Financial Sentiment Analysis.
TARGET ASSET: Brent Crude Oil (BRN1!)
ASSET CONTEXT: Global energy markets, OPEC+ production decisions, geopolitical tensions, macroeconomic supply and demand dynamics.
INSTRUCTIONS:
1. Entity Isolation: Determine if the news directly impacts global oil supply/demand, geopolitical stability in oil-producing regions, or currency impacts (like the USD) that affect commodity pricing.
2. Reasoning: Provide a concise, step-by-step logical link between the news event and Brent Crude's potential price volatility.
3. Scoring: Assign a sentiment score from -1.0 (highly bearish for Brent prices) to 1.0 (highly bullish for Brent prices). Assign a confidence score from 0.0 (uncertain) to 1.0 (highly certain).
4. Strict Output: You must output ONLY a valid JSON object. Do not include markdown formatting, backticks, or any conversational text before or after the JSON.
OUTPUT SCHEMA:
{
"asset": "BRN1!",
"reasoning": "string",
"impact_type": "Direct" | "Indirect" | "None",
"sentiment_score": float,
"confidence_score": float
}"""

PROMPT_EGX = """You are a quantitative financial analyst specializing in emerging markets and Middle Eastern equities. Your task is to perform Target-Based Financial Sentiment Analysis. If the input text is in Arabic, internally translate and analyze it, but generate the final output strictly in English.
TARGET ASSET: EGX70 EWI (Egyptian Exchange 70 Equal Weight Index)
ASSET CONTEXT: Egyptian small and medium-sized enterprises, local inflation rates, Egyptian Pound (EGP) currency fluctuations, Central Bank of Egypt policies, and regional geopolitical stability.
INSTRUCTIONS:
1. Entity Isolation: Determine if the news impacts the Egyptian macro-economy, specific local sectors (like real estate, agriculture, or local manufacturing), or currency liquidity. Remember this index excludes the top 30 largest companies, so focus on broader SME economic conditions.
2. Reasoning: Provide a concise, step-by-step logical link between the news event and the EGX70's potential price volatility.
3. Scoring: Assign a sentiment score from -1.0 (highly negative for the Egyptian local market) to 1.0 (highly positive for the Egyptian local market). Assign a confidence score from 0.0 (uncertain) to 1.0 (highly certain).
4. Strict Output: You must output ONLY a valid JSON object. Do not include markdown formatting, backticks, or any conversational text before or after the JSON.
OUTPUT SCHEMA:
{
"asset": "EGX70",
"reasoning": "string",
"impact_type": "Direct" | "Indirect" | "None",
"sentiment_score": float,
"confidence_score": float
}"""

PROMPT_FALLBACK = "Perform target-based financial sentiment analysis. Output ONLY a JSON object with keys: asset, reasoning, impact_type, sentiment_score, confidence_score."

# Order of the substring cascade: first matching needle wins.
PROMPT_CASCADE = (
    (("NVDA",), PROMPT_NVDA),
    (("USO", "BRN"), PROMPT_BRENT),
    (("EGX",), PROMPT_EGX),
)
PROMPT_INPUT_SEPARATOR = "\n\nINPUT TEXT:\n"

# --- FIXED VALUES: page noise containers removed before field extraction --
NOISE_CLASSES = ("ad", "syndigate_disclaimer", "footnote-disclaimer")

# --- FIXED VALUES: default lexicon of the built-in scorer -----------------
# The built-in scorer is a stand-in for an external model; any scorer that
# maps text to (label, probability) can replace it (see operators.scoring).
POSITIVE_WORDS = ("gain", "gains", "growth", "profit", "profits", "rise", "rises",
                  "strong", "beat", "beats", "record", "up", "bullish", "good",
                  "improve", "improved", "surge", "positive", "high", "best")
NEGATIVE_WORDS = ("loss", "losses", "decline", "drop", "drops", "fall", "falls",
                  "weak", "miss", "misses", "down", "bearish", "bad", "risk",
                  "cut", "crash", "negative", "low", "worst", "debt")
