"""Fixed values.

Everything in this file is data that results depend on: label names, the two
label orders, thresholds, weights, word and emoji lists, explanation sentences.
Change one and the produced tables no longer agree with published ones.
"""

# Stance labels.
BELIEVES = "believes the fake news"
CRITICIZES = "criticizes the fake news"
NEUTRAL = "neutral"
STANCES = (BELIEVES, CRITICIZES, NEUTRAL)

# The two label numberings in use; they disagree on 1 and 2.
LABEL_IDS_FROM_ANNOTATIONS = {BELIEVES: 0, NEUTRAL: 1, CRITICIZES: 2}
LABEL_IDS_FROM_GOLD = {BELIEVES: 0, CRITICIZES: 1, NEUTRAL: 2}

# Sentence a comment is judged against, one per candidate label.
HYPOTHESIS_TEMPLATE = "This comment {}."

# Triage.
CONFIDENCE_THRESHOLD = 0.6
SARCASM_THRESHOLD = 0.7
# Where the explanations turn, in the order of their rules: sarcasm above, confidence below, sarcasm below.
CLEAR_SARCASM, LOW_CONFIDENCE = 0.7, 0.5
LIKELY_SARCASM = 0.6
SOME_DOUBT = 0.6
LITTLE_SARCASM = 0.4
SARCASM_PROMPT = "detect sarcasm: "
SARCASM_MAX_CHARS = 512
SARCASM_LABELS = ("irony", "non_irony")

# Text cues.
CUE_EMOJI = "🤦🙄😂🤣😅🤔😏"
NEGATION_WORDS = ("not", "no", "never", "fake", "hoax")

# Explanation sentences.
SARCASTIC_CRITICISM = "Likely sarcastic criticism — ironic disbelief or mockery of the fake news."
IRONIC_ENDORSEMENT = "Possible ironic endorsement — sarcasm misinterpreted as belief."
AMBIGUOUS_TONE = "Ambiguous tone — sarcastic or humorous uncertainty."
SARCASTIC_QUESTION = "Sarcastic questioning — likely expressing doubt or disbelief."
SARCASTIC_EMOJI = "Sarcastic tone reinforced by emoji."
SKEPTICAL = "Likely critical or skeptical language."
STRONG_EMOTION = "Strong emotion, possibly genuine belief."
NEEDS_REVIEW = "Ambiguous or uncertain expression — may need manual review."

# Impact.
REACTIONS_WEIGHT = 0.5
SUB_COMMENTS_WEIGHT = 0.5
SARCASM_WEIGHT = 0.5
NORMALISATION_EPSILON = 1e-6
POLARITY = {BELIEVES: 1, CRITICIZES: -1, NEUTRAL: 0}
POLARITY_SHORT_KEYS = {"believes": 1, "criticizes": -1, "neutral": 0}
STRENGTHENING = "strengthening"
WEAKENING = "weakening"
BALANCED = "balanced"
TOP_K = 10
EXCERPT_CHARS = 150

# Human annotation covers the leading rows of every file.
ANNOTATED_ROWS = 40

# Training-set preparation.
ENCODED_LENGTH = 128
ENCODED_LENGTH_SHORT = 64
DISTILL_TEMPERATURE = 2.0
DISTILL_ALPHA = 0.5
BEGIN_ID, PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3

# Text model.
MAX_FEATURES = 5000
MAX_ITERATIONS = 1000
TOLERANCE = 1e-4

# Spellings of the comment time. Single letters accept one or two digits.
COMMENT_TIME_PATTERNS = ("M/d/yyyy h:mm:ss a", "M/d/yy H:mm")
COMMENT_TIME_24H_PATTERN = "M/d/yyyy H:mm:ss"
