"""Fixed values. Results depend on these exact lists, tables, thresholds and formats, so they are kept as plain data
in one place; every operator that uses one also takes it as a parameter."""

# --- fixed values: label spaces -------------------------------------------------------------------------------
SENTIMENTS = ["positive", "neutral", "negative"]
EMOTIONS = [
    "joy", "affection", "excitement", "relief", "neutral", "confusion", "surprise",
    "sadness", "anxiety", "fear", "frustration", "anger", "disgust",
]
TONES = [
    "friendly", "professional", "casual", "humorous", "supportive", "apologetic", "concerned",
    "sarcastic", "defensive", "dismissive", "cold", "frustrated", "aggressive", "passive-aggressive",
]
ESCALATION_TENSION = 60.0
SCHEMA_VERSION = "1.0.0"

# --- fixed values: emotion and tone dimensions ----------------------------------------------------------------
INTENSITY = {
    "joy": 0.35, "affection": 0.25, "excitement": 0.45, "relief": 0.18, "neutral": 0.10, "confusion": 0.28,
    "surprise": 0.35, "sadness": 0.40, "anxiety": 0.50, "fear": 0.55, "frustration": 0.62, "anger": 0.82,
    "disgust": 0.70,
}
UNKNOWN_INTENSITY = 0.1
AROUSAL = {
    "joy": 0.6, "affection": 0.3, "excitement": 0.8, "relief": -0.2, "neutral": 0.0, "confusion": 0.1,
    "surprise": 0.5, "sadness": -0.5, "anxiety": 0.3, "fear": 0.4, "frustration": 0.6, "anger": 0.9, "disgust": 0.7,
}
VALENCE = {
    "joy": 0.8, "affection": 0.7, "excitement": 0.7, "relief": 0.5, "neutral": 0.0, "confusion": -0.1,
    "surprise": 0.1, "sadness": -0.7, "anxiety": -0.5, "fear": -0.6, "frustration": -0.6, "anger": -0.8,
    "disgust": -0.7,
}
WARMTH = {
    "friendly": 0.8, "supportive": 0.9, "apologetic": 0.4, "concerned": 0.3, "casual": 0.5, "humorous": 0.7,
    "professional": 0.2, "sarcastic": -0.5, "defensive": -0.3, "dismissive": -0.6, "cold": -0.7, "frustrated": -0.6,
    "aggressive": -0.9, "passive-aggressive": -0.6,
}
SENTIMENT_CODE = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}
EMOTION_SENTIMENT = {
    "joy": "positive", "affection": "positive", "excitement": "positive", "relief": "positive",
    "neutral": "neutral", "surprise": "neutral", "confusion": "neutral",
    "frustration": "negative", "anxiety": "negative", "fear": "negative", "disgust": "negative",
    "sadness": "negative", "anger": "negative",
}
EMOTION_TENSION = {
    "joy": 8.0, "affection": 8.0, "excitement": 14.0, "relief": 8.0, "neutral": 12.0, "surprise": 22.0,
    "confusion": 26.0, "frustration": 45.0, "anxiety": 48.0, "fear": 52.0, "disgust": 50.0, "sadness": 42.0,
    "anger": 58.0,
}

# --- fixed values: word lists ---------------------------------------------------------------------------------
POSITIVE = [
    "good", "great", "awesome", "nice", "love", "loved", "perfect", "thanks", "thank", "happy", "glad", "cool",
    "excellent", "amazing", "wonderful", "best", "sweet", "excited", "fantastic", "brilliant", "enjoy", "enjoyed",
    "fun", "yay", "win", "appreciate", "appreciated", "helpful", "works", "smooth", "beautiful", "solid",
]
NEGATIVE = [
    "bad", "worst", "hate", "hated", "terrible", "awful", "horrible", "angry", "annoyed", "annoying", "frustrated",
    "frustrating", "ridiculous", "stupid", "pathetic", "useless", "broken", "crashed", "fail", "failed", "failure",
    "never", "wrong", "waste", "late", "again", "still", "sick", "tired", "exhausted", "unbelievable",
    "overwhelmed", "screwed", "messed", "liar", "lie", "lying", "betrayed", "unfair", "ignore", "ignored",
]
SARCASM_MARKERS = [
    "yeah", "sure", "great", "perfect", "obviously", "totally", "brilliant", "fantastic", "wonderful", "amazing",
    "right", "exactly", "congrats", "thanks",
]
SINCERE_FRAMES = {
    "sure": [
        "i was sure", "i'm sure", "im sure", "make sure", "for sure", "not sure", "wasn't sure", "be sure",
        "sure that", "sure if", "sure about", "sure to", "sure thing", "sure you",
    ],
    "right": [
        "that's right", "that is right", "you're right", "you are right", "all right", "right now", "right away",
        "right there", "right back", "isn't right", "not right",
    ],
    "great": ["great to hear", "great news", "that's great", "feel great"],
    "thanks": ["thanks for", "thanks so much", "thanks a lot", "no thanks"],
}
IRONY_MARKERS = ["wow", "ah", "oh", "great", "perfect", "just", "exactly", "clearly"]
INTERJECTIONS = ["wow", "oh", "ah"]
BELIEF_UPDATE = [
    "wait", "no way", "i was sure", "i thought", "really?", "for real", "you did", "did you", "already",
    "wasn't expecting", "didn't expect", "turns out",
]
CONCESSIVE_PHRASES = [
    "fine.", "whatever.", "do what you want", "okay then.", "ok then.", "no problem.", "as you wish",
    "i'm not angry", "i'm not mad", "do whatever you want", "suit yourself", "if you say so",
    "i guess it's fine", "sure, go ahead", "it's fine, really",
]
EXAGGERATION = ["literally", "never", "always", "everyone", "nobody", "everything", "nothing"]
COOPERATIVE = [
    "thanks", "thank you", "i'll", "let's", "happy to", "will do", "sounds good", "no worries", "appreciate", "sorry",
]
REPEAT_STOP_WORDS = ["to", "the", "a", "an", "i", "you", "it", "and", "that", "is", "my"]
NEGATIVE_CONTEXT = [
    "crashed", "again", "late", "broken", "wrong", "failed", "sorry", "unfortunately", "problem", "issue", "stuck",
    "delay", "angry", "annoyed", "frustrated",
]
THREAD_POSITIVE = ["good", "great", "thanks", "love", "nice", "awesome", "best"]
THREAD_NEGATIVE = ["bad", "hate", "awful", "terrible", "worst", "stupid", "wrong"]
SLANG = {
    "u": "you", "ur": "your", "r": "are", "ya": "yes", "yep": "yes", "nope": "no", "gonna": "going to",
    "wanna": "want to", "gotta": "got to", "dunno": "do not know", "k": "ok", "kk": "ok", "thx": "thanks",
    "pls": "please", "plz": "please", "omg": "oh my god", "smh": "shaking my head", "brb": "be right back",
    "idc": "i do not care", "idk": "i do not know", "nvm": "never mind", "btw": "by the way", "tbh": "to be honest",
    "smgdh": "shake my god damn head",
}

# --- fixed values: emoji --------------------------------------------------------------------------------------
EMOJI_POLARITY = {
    "😀": 0.8, "😃": 0.8, "😄": 0.8, "😁": 0.7, "😊": 0.7, "🙂": 0.5, "😍": 0.8, "🥰": 0.8, "😂": 0.6, "🤣": 0.6,
    "😉": 0.4, "👍": 0.6, "❤️": 0.8, "🔥": 0.5, "🎉": 0.7, "✅": 0.4, "😢": -0.7, "😭": -0.7, "😡": -0.9, "🤬": -0.9,
    "😠": -0.8, "😑": -0.3, "🙄": -0.5, "😒": -0.6, "😞": -0.7, "😔": -0.6, "☹️": -0.6, "👎": -0.6, "😬": -0.3,
    "😩": -0.6, "🤦": -0.5, "💀": -0.3, "🫠": -0.4, "🥲": -0.5, "😅": -0.1,
}
EMOJI_SARCASM = ["🙄", "😒", "🫠", "🥲", "😅", "🙃", "😌", "🤡"]

# --- fixed values: patterns (same syntax in Java and RE2; word characters are letters, digits and underscore) ---
EMOJI_RUN = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F02F}\x{2190}-\x{21FF}"
    r"\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+"
)
SPACE = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NOT_SPACE = SPACE.replace("[", "[^", 1)
NOT_WORD = r"[^\p{L}\p{N}_]+"
URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
REPEATED_PUNCTUATION = r"!{2,}|\?{2,}"
ELLIPSIS = r"\.{3,}|…"
LAUGH_WORD = r"^(?:(?:ha)+|lol+|lmao+|rote?fl)$"
SWEAR_WORD = r"^(?:fuck|shit|bitch|bastard|asshole|damn|hell|crap|dumb|idiot|moron)s?$"
CAPS_WORD = r"^[A-Z]{2,}$"
ISO_TIMESTAMP = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
)

# --- fixed values: export formats -----------------------------------------------------------------------------
PHONE_HEADER = (
    r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4}),?\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*"
    r"(?:([APap])\.?[Mm]\.?)?\s*[-–]\s*([^:]+?):\s(.*)$"
)
SYSTEM_MARKERS = [
    "<Media omitted>", "<This message was edited>", "Messages and calls are end-to-end encrypted", "created group",
    "added you", "changed the subject", "joined using this group",
]
CLOCK_HEADER = r"^\[?([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\]?\s+([^:]+):\s(.*)$"
SPEAKER_LINE = r"^([^:]{1,32}):\s(.*)$"
MAX_EXPORT_BYTES = 8 * 1024 * 1024

# --- fixed values: label adapters -----------------------------------------------------------------------------
SOURCE_LABELS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity", "desire",
    "disappointment", "disapproval", "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief", "joy",
    "love", "nervousness", "optimism", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
]
LABEL_PRIORITY = [
    ("joy", "joy"), ("amusement", "joy"), ("gratitude", "affection"), ("love", "affection"), ("caring", "affection"),
    ("admiration", "affection"), ("optimism", "excitement"), ("excitement", "excitement"), ("desire", "excitement"),
    ("relief", "relief"), ("anger", "anger"), ("annoyance", "frustration"), ("disappointment", "frustration"),
    ("disapproval", "frustration"), ("nervousness", "anxiety"), ("embarrassment", "anxiety"), ("fear", "fear"),
    ("grief", "sadness"), ("sadness", "sadness"), ("remorse", "sadness"), ("disgust", "disgust"),
    ("surprise", "surprise"), ("confusion", "confusion"), ("realization", "surprise"), ("approval", "neutral"),
    ("curiosity", "neutral"), ("neutral", "neutral"),
]
DIALOGUE_EMOTIONS = ["neutral", "anger", "disgust", "fear", "joy", "sadness", "surprise"]
SENTIMENT_TONE = {"positive": "friendly", "negative": "frustrated", "neutral": "casual"}

# --- fixed values: fusion -------------------------------------------------------------------------------------
FUSION_WEIGHTS = {"text": 0.30, "context": 0.22, "memory": 0.14, "behavior": 0.12, "temporal": 0.10, "hidden": 0.12}

# --- fixed values: evidence texts -----------------------------------------------------------------------------
EVIDENCE = {
    "sarcasm_context": "positive wording in negative context",
    "sarcasm_markers": "marker words: %s",
    "sarcasm_repeat": "repeated wording: %s",
    "sarcasm_cooperative": "cooperative intent markers present (argues against sarcasm)",
    "sarcasm_belief": "belief-update wording (argues against an echoic reading)",
    "sarcasm_emoji": "sarcasm-typical emoji: %s",
    "sarcasm_exclaim": "exclamation emphasis",
    "sarcasm_spike": "tension spike (+%.0f after this message)",
    "irony_context": "literal meaning opposes situational context",
    "irony_interjection": "evaluative interjection ('wow'/'oh')",
    "irony_quote": "quoted wording may echo context",
    "pa_phrase": 'concessive phrase: "%s"',
    "pa_cold": "short cold response pattern",
    "pa_rising": "rising tension trajectory",
    "negative": "negative wording: %s",
    "positive": "positive wording: %s",
    "exclaim": "intensified punctuation (%d× '!')",
    "ellipsis": "trailing ellipsis (unfinished thought)",
    "exaggeration": "absolute/exaggerated words: %s",
    "emoji": "emoji polarity %+.1f",
    "markers": "irony-prone markers: %s",
    "phrase": 'concessive phrase: "%s"',
    "swear": "strong language (%d)",
    "caps": "elevated CAPS ratio (shouting-style emphasis)",
    "short": "minimal-length response",
    "rose": "tension rose %+.0f vs previous turn",
    "eased": "tension eased %+.0f vs previous turn",
    "emotion_shift": "emotional shift %s → %s",
    "sentiment_shift": "sentiment shift %s → %s",
    "speaker_state": "speaker's previous state was %s",
    "sarcasm": "sarcasm evidence: %s",
    "pa": "passive-aggression evidence: %s",
    "window": "interpreted against the preceding conversation window",
    "change_negative": "negative wording",
    "change_intensity": "increased linguistic intensity",
    "change_cold": "concessive/cold phrasing",
    "change_sarcasm": "sarcasm at the boundary",
    "change_carry": "carry-over of speaker's prior emotional state",
    "change_short": "abrupt short-response pattern",
    "change_none": "no dominant single signal; cumulative context shift",
}
