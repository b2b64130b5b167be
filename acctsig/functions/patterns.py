"""Fixed values that must equal the original detector's for equal results.

Everything below is data, written in Python ``re`` syntax exactly as the
detector matches it. ``acctsig.functions.text.java_regex`` turns a pattern
into the equivalent Java regex (Unicode ``\\b``/``\\w``/``\\s``) that Spark
evaluates JVM-side. The lists are function parameters everywhere, so a
caller can pass its own.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original detector; keep order and spelling)
# ---------------------------------------------------------------------------

# Competition score weights: 4*TP - 1*FN - 2*FP.
SCORE_TP = 4
SCORE_FN = -1
SCORE_FP = -2

# Engagement-bait patterns, case-insensitive. Any language other than 'en'
# uses the French list.
EN_BAIT_PATTERNS = [
    r"\bDM\b", r"\bfollow\b", r"check my bio", r"\bclick\b",
    r"opt[\s-]?in", r"link in bio", r"subscribe", r"join\s+(us|me)",
    r"🔒", r"\bfree\b.*\b(access|content)", r"pinned\b.*\btweet",
    r"\bcheck\b.*\b(out|my)", r"don't miss",
]

FR_BAIT_PATTERNS = [
    r"\bDM\b", r"\bsuiv(re|ez)\b", r"\babonne[zr]?\b", r"lien dans",
    r"\bbio\b", r"\bclique[zr]?\b", r"\brejoign", r"🔒",
    r"\bgratuit\b", r"\bdécouvr", r"ne\s+manquez?\s+pas",
]

# Generic hashtags, case-insensitive, prefix match (no right boundary).
GENERIC_HASHTAG_PATTERNS = [
    r"#(Love|Peace|Unity|Gratitude|PositiveVibes|Blessed|Mindful)",
    r"#(ManifestingMagic|TokyoVibes|UnexpectedJourneys|AnimeVsPop)",
    r"#(LoveInTheCrust|relatablefail|EpicFail|FacePalm|AwkwardMoment)",
    r"#(TeaTime|Relaxation|SelfCare|Wellness|Motivation)",
    r"#(NowPlaying|MusicNews|NewRelease|MusicDiscovery)",
    r"#(SportsUpdate|GameDay|TeamSpirit)",
    r"#(MindfulEscapes|NatureLovers|ZenLife)",
    r"#(VieQuotidienne|PourquoiMoi|InspirationDuJour)",
]

# Per-post token patterns.
URL_PATTERN = r"https?://\S+|t\.co/\S+"
HASHTAG_PATTERN = r"#\w+"
MENTION_PATTERN = r"@\w+|@mention"
EMOJI_PATTERN = r"[\U0001F300-\U0001F9FF\u2600-\u27BF\U0001FA00-\U0001FA6F\U0001FA70-\U0001FAFF]"
PROFILE_EMOJI_PATTERN = r"[\U0001F300-\U0001F9FF\u2600-\u27BF\U0001FA00-\U0001FA6F]"

# Topic keyword sets (exact lower-cased token match).
TOPIC_KEYWORDS = {
    "sports": ["nba", "nhl", "game", "team", "play", "win", "score", "hockey",
               "basketball", "player", "match", "league"],
    "music": ["music", "song", "album", "pop", "track", "playlist", "melody",
              "concert", "artist", "genre"],
    "movies": ["movie", "film", "cinema", "director", "scene", "watch", "series",
               "episode", "streaming"],
    "politics": ["politics", "government", "vote", "election", "president",
                 "liberal", "conservative", "policy"],
    "tech": ["iphone", "apple", "tech", "app", "software", "ai", "internet",
             "digital", "phone"],
    "food": ["food", "recipe", "cooking", "eat", "restaurant", "chef", "meal",
             "delicious"],
    "life": ["life", "day", "morning", "night", "feel", "love", "happy", "dream",
             "beautiful"],
}

# Formal markers, case-insensitive search.
FORMAL_PATTERN = (
    r"(I've |I'm |It's |Let's |Don't |Can't |shouldn't|couldn't|"
    r"perhaps|indeed|furthermore|however|therefore|magnificent|"
    r"fascinating|extraordinary|remarkable|delightful)"
)

# Slang markers (EN and FR), case-insensitive search.
SLANG_PATTERN = (
    r"\b(lol|lmao|wtf|omg|bruh|ngl|tbh|rn|smh|af|imo|idk|fr|"
    r"ong|mf|finna|lowkey|highkey|deadass|bussin|mfs|nah|yall|"
    r"ain't|gotta|gonna|wanna|tryna|fam|dawg|bro|sis|"
    r"mdr|mdrrr|ptdr|jsp|slt|tkt|bg|ptn|osef|fdp|tmtc)\b"
)

# AI-style phrases, case-insensitive search.
AI_PHRASE_PATTERN = (
    r"(can't help but|it's (nice|great|amazing) to|"
    r"here's (how|what|why)|let's (dive|explore|talk)|"
    r"in (this|today's) (post|thread|tweet)|"
    r"what are your thoughts|share your|"
    r"drop your|who else|anyone else|"
    r"honestly[,.]|seriously[,.]|"
    r"(loving|feeling|enjoying|appreciating) the (vibes|energy|moment)|"
    r"(a|the) (sprinkle|dose|bit) of)"
)

# Generic daily-life phrases, case-insensitive search.
GENERIC_LIFE_PATTERN = (
    r"(just another day|living (my|her|his) best life|"
    r"who else (loves|thinks|feels)|can we (talk|appreciate)|"
    r"(morning|evening) (routine|stroll|walk)|"
    r"(happy|excited) to (announce|share)|"
    r"(passionate|proud) (about|of|to)|"
    r"(empowering|inspiring|motivating)|"
    r"(sustainability|initiative|innovati))"
)

# Punctuation characters counted by punctuation_diversity (18 characters).
PUNCTUATION_CHARS = ".,;:!?-—–()[]{}'\"…"

# Prompt-leak patterns, matched on the lower-cased post (no other flags).
LLM_LEAK_PATTERNS = [
    r"here are some of my recent tweets",
    r"here are the re-?written",
    r"here are some (?:recent )?rewrites",
    r"here are some (?:modified|revised|alternative) versions",
    r"rewritten tweet",
    r"here are some changes i made",
    r"as an ai\b",
    r"as a language model",
    r"voici (?:quelques|mes) (?:récents? )?tweets",
    r"voici (?:les|des) versions? (?:révisée|modifiée)",
]

# URL typo markers (plain substrings).
URL_TYPO_MARKERS = ["htts://", "htt://"]

# Location markers (plain, case-sensitive substrings).
LOCATION_MARKERS = [":null:", "O:", ".:"]

# Rule reasons, in priority order (first match wins).
RULE_REASONS = ["garbled_name", "llm_leak", "url_typo", "weird_location"]

# Caps on consecutive-post comparisons.
JACCARD_PAIRS = 40        # pairs (i, i+1) for i < 40
BIGRAM_ANCHORS = 30       # anchors i < 30
BIGRAM_LOOKAHEAD = 4      # compared with i+1 .. i+4

# Thresholds (hour-of-day night window, rapid fire, regularity, uniformity).
NIGHT_LAST_HOUR = 6       # hours 0..6 inclusive
RAPID_FIRE_SECONDS = 60
REGULAR_TOLERANCE = 0.1
UNIFORM_TOLERANCE = 0.5
LONG_WORD_LEN = 8
SHORT_POST_LEN = 60

# TF-IDF vocabulary: terms of >= 2 word chars, df >= 2, df <= 0.95 * n,
# top 3000 by corpus count; smoothed idf + 1, L2 norm.
TFIDF_MAX_FEATURES = 3000
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.95

# Ensemble blend weights (learner A, B, C).
BLEND_WEIGHTS = (0.35, 0.35, 0.30)

# Threshold sweep: 0.10, 0.11, ..., 0.94 (85 values).
SWEEP_START = 0.10
SWEEP_STEP = 0.01
SWEEP_COUNT = 85
DEFAULT_THRESHOLD = 0.5

# Fixed corpus layout: practice dataset id -> language.
PRACTICE_LANG = {30: "en", 31: "fr", 32: "en", 33: "fr"}

# Top-k of the importance reports.
TOP_FEATURES_PRINT = 20
TOP_FEATURES_PLOT = 15

# Score histogram bins per class.
HISTOGRAM_BINS = 30
# Cross-dataset validation: (training, test) datasets.
CROSS_PAIRS = ((30, 32), (32, 30), (31, 33), (33, 31))
