"""Results depend on these exact texts."""

# Subjects allowed into the multiple-choice corpus.
STEM_SUBJECTS = [
    "abstract_algebra",
    "anatomy",
    "astronomy",
    "college_biology",
    "college_chemistry",
    "college_computer_science",
    "college_mathematics",
    "college_physics",
    "computer_security",
    "conceptual_physics",
    "electrical_engineering",
    "elementary_mathematics",
    "high_school_biology",
    "high_school_chemistry",
    "high_school_computer_science",
    "high_school_mathematics",
    "high_school_physics",
    "high_school_statistics",
    "machine_learning",
]

# Fixed value: the line that opens every multiple-choice prompt.
MCQA_HEADER = (
    "The following are multiple choice questions (with answers) about knowledge and skills "
    "in advanced master-level STEM courses.\n\n"
)

# Fixed value: options are lettered A to Z, so a prompt shows 26 choices at most.
MAX_LETTERS = 26

# Fixed value: one lettered choice inside a packed options string.
CHOICE_PATTERN = r"[a-e]\s*\)\s*([^,]+)"

# Separators (regular expressions) for cutting Markdown, strongest first.
MARKDOWN_SEPARATORS = [
    "\n#{1,6} ",
    "```\n",
    "\n\\*\\*\\*+\n",
    "\n---+\n",
    "\n___+\n",
    "\n\n",
    "\n",
    " ",
    "",
]

# Fixed value: the marker that closes a reasoning passage.
REASONING_CLOSE = "</think>"

# Default sizes.
MAX_TOKENS = 2048
PAIR_MAX_TOKENS = 1000
TEST_FRACTION = 0.05
SEED = 42
