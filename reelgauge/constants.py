"""Fixed values that results depend on."""

# Award titles, compared after trim and lower-case.
AWARD_TITLES = ("Whiplash", "Juno", "Get Out", "Forrest Gump", "Gladiator")

# Theme names in order of precedence, with their seed words.
THEME_WORDS = {
    "love": ("love", "like", "relationship", "kiss", "heart", "date"),
    "friendship": ("friend", "buddy", "together", "trust", "hang", "group"),
    "betrayal": ("lie", "secret", "cheat", "betray", "deceive"),
    "family": ("dad", "mom", "sister", "brother", "home", "family"),
    "freedom": ("run", "escape", "free", "break", "leave"),
    "identity": ("name", "truth", "real", "who", "self", "believe"),
    "ambition": ("win", "goal", "dream", "try", "future", "career"),
    "conflict": ("fight", "argue", "battle", "war", "enemy", "kill"),
    "fear": ("scared", "afraid", "fear", "hide", "monster"),
    "sacrifice": ("sacrifice", "give", "cost", "save", "risk"),
    "war": ("battle", "war", "fight", "enemy", "soldier"),
    "survival": ("survive", "die", "kill", "safe", "danger"),
    "justice": ("court", "law", "judge", "justice", "truth"),
}
NO_THEME = "Misc"
THEME_SIMILARITY = 0.6
THEME_MIN_LOG_PROB = -15.0
# Chance to find a pair of vectors at the similarity bar.
SIMILARITY_RECALL = 0.999
TOPIC_COUNT = 5
WORDS_PER_TOPIC = 10
TOPIC_SEED = 42

# Header of the film CSV, in column order.
FILM_CSV_HEADER = (
    "Title", "Release Date", "BoxOffice", "BoxOffice(adj)", "IMDb Rating",
    "Rotten Tomatoes", "Cast", "Director", "Budget", "Star Power",
    "Total Star Power", "Sentiment Shift", "ArcComplexity1", "ArcComplexity2",
    "ArcComplexity3", "Lexical Diversity", "Named Themes", "Dominant Topics",
    "Indie Quality Score",
)
MISSING_TEXT = "N/A"

# CSV cells that pandas reads as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Cut-offs of the text steps, offered as options.
SCRIPT_CHAR_LIMIT = 200_000
LINE_TOKEN_LIMIT = 512
SCORER_BATCH_SIZE = 16

# Ratings and pages.
CRITIC_SOURCE = "Rotten Tomatoes"
BUDGET_LABEL = "Budget"
DETAIL_URL_PREFIX = "https://www.boxofficemojo.com/title/"
DETAIL_URL_SUFFIX = "/?ref_=bo_se_r_1"

# Star weights, index base year, present-day price factor.
LEAD_WEIGHT = 1.0
SUPPORT_WEIGHT = 0.5
INDEX_BASE_YEAR = 2025
PRICE_FACTOR = 1.20

# Score shapes, weights, bin edges, trim, significance.
SENTIMENT_PEAK = 0.20
SENTIMENT_SLOPE = 10.0
LEXICAL_CENTER = 0.24
LEXICAL_WIDTH = 0.02
IQ_WEIGHTS = {"sentiment": 0.3, "lexical": 0.2, "arc": 0.5}
LEXICAL_EDGES = (0.0, 0.333, 0.667, 1.0)
TRIM_QUANTILES = (0.05, 0.95)
SIGNIFICANCE = 0.05
BAND_LEVEL = 0.95

# Verdict texts and thresholds.
MONEY_THRESHOLD = 0.5
CREATIVE_THRESHOLD = 0.3
VERDICT_GEM = "🎯 Hidden Gem (High Script, Undervalued)"
VERDICT_MONEY = "💰 Financially Undervalued"
VERDICT_SCRIPT = "🧠 Critically Underrated Script"
VERDICT_HYPED = "🚫 Overhyped & Underwhelming"
VERDICT_FAIR = "✅ Fairly Valued"
REPORT_SIZE = 10

# Our own small default lexicon for the word-based sentiment scorer.
DEFAULT_LEXICON = {
    **dict.fromkeys((
        "amazing", "beautiful", "best", "better", "brave", "brilliant",
        "calm", "celebrate", "charming", "cheer", "clever", "delight", "easy",
        "enjoy", "excellent", "fair", "fine", "free", "friend", "fun",
        "generous", "gentle", "glad", "good", "grateful", "great", "happy",
        "help", "honest", "hope", "joy", "kind", "laugh", "like", "love",
        "lovely", "lucky", "nice", "peace", "perfect", "pleasant", "proud",
        "safe", "smile", "strong", "sweet", "thank", "thanks", "true", "trust",
        "warm", "welcome", "win", "wise", "wonderful", "yes",
    ), 1),
    **dict.fromkeys((
        "afraid", "alone", "anger", "angry", "awful", "bad", "betray",
        "bitter", "blame", "broken", "cheat", "cold", "cruel", "cry", "damn",
        "danger", "dead", "death", "die", "dirty", "enemy", "evil", "fail",
        "fear", "fight", "fool", "guilty", "hate", "hell", "horrible", "hurt",
        "kill", "liar", "lie", "lose", "lost", "mad", "murder", "nasty",
        "never", "no", "pain", "poor", "sad", "scared", "shame", "sick",
        "sorry", "stupid", "suffer", "terrible", "ugly", "war", "weak",
        "wicked", "worse", "worst", "wrong",
    ), -1),
}
