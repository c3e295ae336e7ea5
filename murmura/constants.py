"""Numbers and words that fix the results of the moderation operators."""

# Thresholds of the scoring and statistics rules.
CONTEXT_GATE = 10
CONTEXT_DEPTHS = [(4, 8), (6, 6), (10, 4)]
MAX_DEPTH = 8
EXTREME, HIGH, MODERATE = 1.4, 0.8, 0.3
RISE, FALL = 0.75, 0.5
ALERT_AVERAGE = 0.35
RING = 10
SUSTAINED_SAMPLES, SUSTAINED_MEAN = 3, 1.0
TIMEOUT_CAP = 86_400
DECAY_DAYS = 14
PARTIAL_HEAT = 0.2
ARCHIVE_LIMIT = 100_000
ARCHIVE_CUT = 1.5
SHORTEN_TO = 1000
BAR_CELLS = 20
GRAPH_ROWS, GRAPH_COLUMNS = 20, 100
AFFECTION_LIMIT = 10.0

# Phrases that count as signs of debate.
CONDITIONALS = ["if ", " then ", " would ", " could ", " should ", " might ", " may "]
DEBATE_PHRASES = [
    "i think", "i believe", "i argue", "i'd say", "i'd argue",
    "however", "therefore", "thus", "hence", "conversely",
    "on the other hand", "in contrast", "one could argue",
    "would you agree", "don't you think", "i'm right",
    "controversy", "controversial", "hot take", "actually",
    "objectively", "claim", "argument", "point", "evidence",
]

# Common English three-letter sequences.
TRIGRAMS = ["the", "and", "ing", "ion", "ent", "her", "for", "tha", "nth", "was", "you", "ith", "ver", "all", "thi", "ter", "hat", "ere", "his", "res"]

# What a reaction adds to affection.
HEARTS = ["❤️", "💗", "💚", "💙", "🩵", "💜", "🖤", "💛", "🤍", "🤎", "💕", "💞", "💓", "💖", "💝", "💘", "💟", "❣️", "💌"]
HEART_AFFECTION, DEFAULT_AFFECTION = 0.12, 0.01
REACTIONS = {"👍": 0.03, "💀": 0.0, "☠️": 0.0, "👎": -0.05}

# Symbols and separators that obfuscated words are spread with.
SYMBOL_MARKS = "♥♦♪♫☆★✓✗✘✔✕✖☑☒☐☓❤💔💖💗💝💘💞💟░▒▓█⊶⋆⊨⊸✦✧✩✪✫✬✭✮✯☙❀❁❂❃❄✿∿～"
SYMBOLS_DROPPED = "♥♦♪♫☆★✓✗✘✔✕✖☑☒☐☓❤💔💖💗💝💘💞💟" "░▒▓█▄▅▆▇█▉▊▋▌▍▎▏|║─═╭╮╯╰┌┐┘└├┤┬┴┼" "⊶⋆⨳⊹⊸✦✧✩✪✫✬✭✮✯☙❀❁❂❃❄✿"
SYMBOLS_SPACED = "～∿⊸〜═──┈┉┊┋┣┫┳┻╋"
SEPARATORS = r"[\-._:;/\\~`]"

#: Letters and digits, the word characters of the boundary rule.
ALNUM = r"[\p{L}\p{Nd}]"

# Addresses of image attachments.
IMAGE_URL = r"\Ahttps://(cdn|media)\.discordapp\.(com|net)/attachments/.*\.(jpg|jpeg|png|gif|bmp|webp|tiff)(\?.*)?\z"
# Fixed value: what the name of a member that isn't known begins with.
UNKNOWN_MEMBER = "Unknown_User_"
