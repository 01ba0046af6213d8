"""Word lists, patterns, label tables and sizes that results depend on."""

from __future__ import annotations

# --- sizes and thresholds -------------------------------------------------------------
SEED = 42
TEST_SHARE = 0.15
FOLDS = 3
WORD_VOCABULARY = 60_000
CHAR_VOCABULARY = 20_000
WORD_SELECTED = 24_000
CHAR_SELECTED = 8_000
CLASS_CAP = 15_000
FIRST_PERSON_THRESHOLD = 0.35
MIN_WORDS = 10
MAX_URLS = 2
SCORABLE_WORDS = 3
LINEAR_TRIALS = 30
FLAT_BOOST_TRIALS = 50
META_BOOST_TRIALS = 75
BOOST_PATIENCE = 20

# --- forum name -> label --------------------------------------------------------------
LABELS = {
    "EDAnonymous": "eating_disorder",
    "addiction": "substance_use_disorder",
    "adhd": "adhd",
    "alcoholism": "alcohol_use_disorder",
    "anxiety": "generalized_anxiety",
    "autism": "autism_spectrum",
    "bipolarreddit": "bipolar_disorder",
    "bpd": "borderline_personality",
    "depression": "major_depressive",
    "healthanxiety": "illness_anxiety",
    "lonely": "social_isolation",
    "socialanxiety": "social_anxiety",
    "suicidewatch": "suicidal_risk",
    "ptsd": "ptsd",
    "schizophrenia": "schizophrenia",
    "non-mental": "non-mental",
}
OTHER_LABEL = "non-mental"

# --- label -> (display name, risk level) ----------------------------------------------
RISK = {
    "adhd": ("ADHD", "LOW"),
    "alcohol_use_disorder": ("Alcohol Use Disorder", "MODERATE"),
    "autism_spectrum": ("Autism Spectrum", "LOW"),
    "bipolar_disorder": ("Bipolar Disorder", "HIGH"),
    "borderline_personality": ("Borderline Personality", "MODERATE"),
    "eating_disorder": ("Eating Disorder", "MODERATE"),
    "generalized_anxiety": ("Generalized Anxiety", "MODERATE"),
    "illness_anxiety": ("Illness Anxiety", "LOW"),
    "major_depressive": ("Major Depressive", "HIGH"),
    "non-mental": ("No MH Indicator", "NONE"),
    "ptsd": ("PTSD", "HIGH"),
    "schizophrenia": ("Schizophrenia", "HIGH"),
    "social_anxiety": ("Social Anxiety", "LOW"),
    "social_isolation": ("Social Isolation", "LOW"),
    "substance_use_disorder": ("Substance Use Disorder", "MODERATE"),
    "suicidal_risk": ("Suicidal Risk", "CRITICAL"),
}
UNKNOWN_RISK = "UNKNOWN"
NOTICE_LEVELS = ("CRITICAL", "HIGH")

# --- keywords to mask; the order is the match order -----------------------------------
MASKED_TERMS = (
    "depression", "depressed", "depressive", "mdd", "major depressive",
    "anxiety", "anxious", "generalized anxiety", "gad", "panic disorder", "panic attack",
    "adhd", "add", "attention deficit", "hyperactivity",
    "autism", "autistic", "asd", "asperger", "aspie",
    "bipolar", "bipolar disorder", "mania", "manic", "hypomania", "hypomanic",
    "bpd", "borderline", "borderline personality",
    "ptsd", "post traumatic", "posttraumatic", "trauma",
    "schizophrenia", "schizophrenic", "schizoaffective", "psychosis", "psychotic",
    "hallucination",
    "ocd", "obsessive compulsive", "obsessive-compulsive",
    "anorexia", "anorexic", "bulimia", "bulimic", "binge eating", "ednos", "arfid",
    "eating disorder",
    "addiction", "addicted", "alcoholism", "alcoholic", "substance abuse",
    "suicid", "suicidal", "suicide", "self harm", "self-harm", "selfharm", "cutting",
    "social anxiety", "social phobia", "social anxiety disorder",
    "health anxiety", "hypochondria", "hypochondriac",
    "r/depression", "r/anxiety", "r/adhd", "r/autism", "r/bipolarreddit", "r/bpd",
    "r/ptsd", "r/schizophrenia", "r/socialanxiety", "r/suicidewatch", "r/edanonymous",
    "r/addiction", "r/alcoholism", "r/healthanxiety", "r/lonely",
)
MASK_TOKEN = "[MH]"
NUMBER_TOKEN = "[NUM]"

# --- noise ----------------------------------------------------------------------------
FIRST_PERSON = ("i", "me", "my", "myself", "mine")
DELETED_TEXTS = ("[removed]", "[deleted]", "", "nan")
BOT_AUTHOR = r"bot$|_bot$|^bot_|automod|automoderator"
MODERATOR_POST = (
    r"weekly\s+(thread|check.?in|discussion)"
    r"|daily\s+(thread|check.?in|discussion)"
    r"|monthly\s+(thread|check.?in|discussion)"
    r"|^(rules|announcement|mod\s+post|welcome\s+to|pinned)"
    r"|megathread|resource\s+(thread|list|post)"
)
URL = r"https?://\S+|www\.\S+"
HANDLE = r"@\w+|#\w+"
NUMBER = r"\d+[.,]?\d*"

# --- self-disclosure ------------------------------------------------------------------
DISCLOSURE_INCLUDE = (
    r"\bI\b.{0,60}\b(was|have been|got|am|were)\b.{0,40}\bdiagnosed\b",
    r"\bI\b.{0,60}\bhave\b.{0,40}\b(disorder|condition|illness)\b",
    r"\bI\b.{0,50}\b(feel|felt|feeling|been feeling)\b",
    r"\bI\b.{0,50}\b(struggle|struggled|struggling)\b",
    r"\bI\b.{0,50}\b(suffer|suffered|suffering)\b",
    r"\bI\b.{0,50}\b(experience|experienced|experiencing)\b",
    r"\bI\b.{0,50}\b(can'?t|cannot|couldn'?t)\b.{0,30}\b(sleep|eat|focus|function|get out)\b",
    r"\bI\b.{0,50}\b(don'?t|didn'?t)\b.{0,30}\b(want to|feel like|care|know)\b",
    r"\bI'?ve\b.{0,50}\b(been|had|started|noticed)\b",
    r"\bI\b.{0,30}\b(just|recently|always|never|sometimes|still)\b",
    r"\bmy\b.{0,40}\b(life|mind|brain|thoughts|head|body|therapist|doctor|medication)\b",
    r"\b(help me|need help|anyone else|does anyone|can anyone)\b",
)
DISCLOSURE_EXCLUDE = (
    r"\bmy\s+(mom|dad|mother|father|brother|sister|son|daughter|friend|partner"
    r"|spouse|husband|wife|boyfriend|girlfriend|colleague|coworker)\b"
    r".{0,60}\b(has|have|was|diagnosed|struggling|suffering)\b",
    r"\b(not sure|unsure)\s+if\s+I\b",
    r"\bI\b.{0,20}\bnot\b.{0,20}\bdiagnosed\b",
    r"\b(asking|posting)\s+(for|on behalf of)\b",
    r"\b(article|study|research|paper|news|published)\b.{0,60}\b(found|shows|suggests)\b",
    r"\bhow\s+to\s+(help|support|talk to)\b.{0,40}\b(someone|person|friend|family)\b",
)

# --- features -------------------------------------------------------------------------
WORD_TOKEN = r"\b[a-zA-Z\[\]][a-zA-Z\[\]]+\b"
EMOTIONS = (
    "anger", "anticipation", "disgust", "fear", "joy",
    "negative", "positive", "sadness", "surprise", "trust",
)
VAD = ("valence", "arousal", "dominance")
VAD_STATISTICS = ("mean", "max", "std")
POS_TAGS = ("PRON", "ADJ", "ADV", "VERB", "AUX", "INTJ", "NOUN")
CATEGORIES = (
    "negative_emotion", "sadness", "fear", "anger", "pain", "suffering", "torment",
    "disappointment", "shame", "neglect", "nervousness", "irritability", "hate", "rage",
    "disgust", "envy", "horror", "swearing_terms", "positive_emotion", "joy", "love",
    "affection", "optimism", "cheerfulness", "zest", "contentment", "pride", "fun",
    "health", "body", "sleep", "eating", "hygiene", "healing", "death", "kill",
    "violence", "injury", "medical_emergency", "sexual", "family", "friends",
    "social_media", "communication", "trust", "deception", "fight", "dispute", "help",
    "listen", "hearing", "speaking", "children", "confusion", "surprise",
    "anticipation", "weakness", "strength", "power", "anonymity", "work", "occupation",
    "school", "college", "money", "poor", "wealthy", "home", "achievement", "religion",
    "worship", "divine",
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- sentiment (published rule-based model: constants and word lists) --------------------
SENTIMENT_ALPHA = 15.0
BOOST = 0.293
NEGATION_FACTOR = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAMATION, EXCLAMATION_MAX = 0.292, 4
QUESTION, QUESTION_LIMIT = 0.18, 0.96
BOOSTERS_UP = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably",
    "decidedly", "deeply", "effing", "enormous", "enormously", "entirely", "especially",
    "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "flipping",
    "flippin", "frackin", "fracking", "fricking", "frickin", "frigging", "friggin",
    "fully", "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly",
    "hugely", "incredible", "incredibly", "intensely", "major", "majorly", "more",
    "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously",
    "uber", "unbelievably", "unusually", "utter", "utterly", "very",
)
BOOSTERS_DOWN = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of",
    "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly",
    "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta", "sortof",
    "sort-of",
)
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't",
    "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "don't", "hadn't",
    "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't", "never",
    "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt",
    "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't",
    "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom",
    "despite",
)

# --- contractions: (pattern, replacement), applied in order; $1 keeps the writer's case -
CONTRACTIONS = (
    (r"\b(ca)n['’]t\b", "$1nnot"),
    (r"\b(w)on['’]t\b", "$1ill not"),
    (r"\b(sha)n['’]t\b", "$1ll not"),
    (r"\b(let)['’]s\b", "$1 us"),
    (r"\b(y)['’]all\b", "$1ou all"),
    (r"\b(ai|are|could|did|does|do|had|has|have|is|might|must|need|ought|should|was|were|would)"
     r"n['’]t\b", "$1 not"),
    (r"\b(i)['’]m\b", "$1 am"),
    (r"\b(you|we|they|who|what|there)['’]re\b", "$1 are"),
    (r"\b(i|you|we|they|who|could|should|would|might|must)['’]ve\b", "$1 have"),
    (r"\b(i|you|he|she|it|we|they|who|that|there)['’]ll\b", "$1 will"),
    (r"\b(i|you|he|she|it|we|they|who|that|there)['’]d\b", "$1 would"),
    (r"\b(he|she|it|that|what|who|where|there|here|how|when|why)['’]s\b", "$1 is"),
)

# --- texts that a CSV reader takes as missing --------------------------------------------
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
