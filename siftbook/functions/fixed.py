"""Fixed values.

Patterns, word lists and thresholds that decide results. They are stated in the form both Java and
RE2 regular expressions accept, so that a DuckDB check can use the same text.
"""

# Whitespace in any script: what trimming removes.
SPACE = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Names of an answer that its passage lacks, as many as a report lists.
UNGROUNDED_LISTED = 12

# Chunk size and input limits, in characters.
MAX_SECTION_CHARS = 4000
PRETRAIN_MIN_CHARS = 100
GENERATION_MIN_CHARS = 300
MCQ_PASSAGE_CHARS = 2000
NOTE_CHARS = 2000
VERIFY_PASSAGE_CHARS = 3000
MIN_ABSTRACT_CHARS = 80

# Layout rules.
LARGE_HEADING_FACTOR = 1.4
SMALL_BOLD_FACTOR = 0.9
HEADING_CHARS = (3, 120)
DEFAULT_FONT_SIZE = 10.0
BOLD_SHARE = 0.6
MONO_SHARE = 0.6
REPEAT_LIMIT = 3
REPEAT_CHARS = 200

# Section and caption patterns.
STOP_SECTION = r"(?i)^(References|Bibliography|Acknowledgements?|Funding|Supplementary)"
CAPTION = r"(?i)^(Fig(ure)?\.?\s*\d+|Table\s+\d+[\.\:\s])"
TOP_LEVEL_SECTION = (
    r"(?i)^(Introduction|Background|Methods?|Materials\s+and\s+Methods|Experimental\s+Procedures?|"
    r"Results?|Discussion|Conclusions?|Summary|Perspectives?|Significance)"
)

# Provenance header in front of a chunk.
HEADER = r"(?s)\A\[Document:.*?\]\n\n"

# Topic words and the least number of mentions a kept document has.
TOPIC = r"(?i)tubercul|mycobact"
MIN_MENTIONS = 3

# Question enumerations.
LETTERS = ("A", "B", "C", "D")
LEVELS = ("recall", "understanding", "application", "analysis")
TOPICS = (
    "drug_resistance", "host_pathogen", "virulence", "genomics", "transcriptomics",
    "metabolomics", "protein_structure", "drug_targets", "signal_transduction",
    "epigenomics", "biofilm", "latency_dormancy", "vaccine", "diagnosis", "clinical",
)
VERDICTS = ("original_verified", "original_replaced")
REVIEW_VERDICTS = ("good", "ambiguous", "wrong_key", "bad_distractor", "passage_specific", "other")
TARGET_CATEGORIES = ("premise_correction", "methodology_critique", "result_interpretation")
MIN_QUESTION_CHARS = 20
MIN_CHOICE_CHARS = 40

# Answer-letter patterns, first match wins.
ANSWER_PATTERNS = (
    r"Answer:\s*([A-D])\b",
    r"answer\s+is\s+(?:option\s+)?([A-D])\b",
    r"correct\s+answer\s+is\s+(?:option\s+)?([A-D])\b",
    r"\bchoose\s+(?:option\s+)?([A-D])\b",
    r"\bselect\s+(?:option\s+)?([A-D])\b",
    r"^([A-D])[).]\s",
    r"\b([A-D])\s+is\s+(?:the\s+)?correct\b",
    r"option\s+([A-D])\s+is\s+(?:the\s+)?correct\b",
    r"^\s*([A-D])\s*$",
)
WRONG_PENALTY = -0.5

# Judge scores, 1 to 5.
METRICS = ("factual_accuracy", "coherence", "naturalness", "completeness")

# Generated-text contamination, lower case.
CONTAMINATION = (
    "response training examples", "## step", "step 1:", "step 2:", "step 3:",
    "first training example", "second training example", "instruction-response pair",
)
META_LEAK = (
    r"(?im)step \d+:|instruction-response pair|training example|^\s*here (is|are) (the|your|an?) |"
    r"^\s*(Instruction|Input|Output):|\bas an ai\b|seed example"
)

# Entity names and the ones that never count.
ENTITY = r"\bRv\d{4}c?\b|\b[a-z]{3}[A-Z]\d?\b|\b[A-Z][a-z]{2}[A-Z0-9]\w*\b|\b[A-Z]{2,}[A-Za-z0-9-]*\b"
STOP_ENTITIES = ("TB", "MTB", "DNA", "RNA", "PCR", "HIV", "WHO", "AND", "THE", "FOR", "USA", "ATP")
TOKEN = r"[a-z0-9][a-z0-9-]{3,}"

# Record audit.
AUDIT_GENE = r"\bRv\d{4}[A-Za-z]?\b"
AUDIT_MEASURE = r"\d+(\.\d+)?\s*(mM|uM|µM|nM|ug/mL|µg/mL|mg/mL|°C|nm|rpm|%)"
AUDIT_FIRST_PERSON = (
    r"(?i)\b(we performed|we screened|they confirmed|was purified|we have identified|we propose)\b"
)
AUDIT_TRIGGER = (
    r"(?i)interpret|critique|evaluate|flag|artifact|follow[- ]up|think through|propose|mechanis|steer|correct"
)
AUDIT_ALTERNATIVE = (
    r"(?i)could|might|may|one possibility|alternatively|another explanation|two mechanisms|rather than"
)
AUDIT_ACTION = (
    r"(?i)I'd|I would|next step|to test|to distinguish|suggest|recommend|it would help to know"
)
AUDIT_MIN_WORDS = 60
AUDIT_SHORT_WORDS = 25
QC_WORDS = (150, 300)

# Retrieval.
TOP_K = 8
GATE_DISTANCE = 0.0676
CONTEXT_SEPARATOR = "\n\n---\n\n"

# Publication cutoff: the first acceptable public date.
CUTOFF = "2024-01-01"

# Stop words for the language vote.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "are", "this", "which", "by", "on"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "ist", "im", "dem", "nicht", "ein", "eine"),
    "fr": ("le", "la", "les", "et", "des", "du", "une", "un", "dans", "est", "que", "pour", "qui", "sur", "par", "avec"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "del", "se", "por", "con", "para", "no"),
}

# Layout and text patterns.
CHAPTER_NUMBER = r"^(\d+)\."
CHAPTER_NAME = r"(?i)^Chapter\s+(\d+)"
NO_LETTERS = r"\A[\d\W]+\z"
HTTP_REQUEST = r"^(GET|POST|PUT|DELETE|PATCH)\s+https?://"
FENCE_START = r"\A```(?:json)?\s*"
FENCE_END = r"\s*```\z"

# Numbered instruction blocks.
BLOCK_START = r"\n(?=\d+[.)])"
INSTRUCTION_PART = r"(?is)\*{0,2}Instruction:?\*{0,2}\s*(.+?)(?=\n\*{0,2}Input:|\z)"
INPUT_PART = r"(?is)\*{0,2}Input:?\*{0,2}\s*(.+?)(?=\n\*{0,2}Output:|\z)"
OUTPUT_PART = r"(?is)\*{0,2}Output:?\*{0,2}\s*(.+?)(?=\n\d+[.)]|\z)"

# Titles and abstracts in the raw text of article files.
ABSTRACT_PATTERNS = (r"(?s)<dc:description>(.*?)</dc:description>", r"(?s)<abstract[^>]*>(.*?)</abstract>")
TITLE_PATTERNS = (r"(?s)<dc:title[^>]*>(.*?)</dc:title>", r"(?s)<article-title[^>]*>(.*?)</article-title>")
