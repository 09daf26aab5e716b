"""Parameters shared by the named queries and their SQL equivalents."""

from datetime import date

from placelore.operators.windows import windows_ending

WINDOWS = windows_ending(date(2024, 1, 30))
FIRST_DAY, LAST_DAY = date(2024, 1, 1), date(2024, 1, 30)
MIN_CLICKS = 15
REVIEW_DAY = date(2024, 1, 10)
SESSION_GAP_MINUTES = 24 * 60
CONFIRMED, EXPLORATORY = ("purchase", "signup"), ("click", "view")
SOURCE_WEIGHTS = {"src0": 1.0, "src1": 0.8, "src2": 0.6}
OPINION_WORDS, MENU_WORDS = ("the", "and", "is"), ("of", "that", "was")
LABELS = sorted(f"Brand#{i}" for i in range(1, 26))
LABEL_PATTERN = "Brand#[0-9]+"
EVAL_LEVEL = 2  # path segment used as prediction category
BUDGET = 300
CHUNK = 10
PROMPT_ROWS = 3  # small, so that days of the test data are split
BACKWARD_EVERY = 7  # days; the production cadence. A daily fold is MemoryOptions(backward_every=1)
PRICES = (15.0, 60.0)  # per million prompt and completion tokens
BOOTSTRAP_DRAWS = 10_000
EXPLICIT_TEMPLATE = "examples: {few_shot}\ndemographics: {demographic_prompt}\nreviews:\n{user_prompt}"
FEW_SHOT_RICH, FEW_SHOT_SPARSE = "rich", "sparse"
PREDICTION_TEMPLATE = "memory:\n{memory_context}\ncategories: {category_list}\nanswer with ten categories"
UNCONSOLIDATED = ["no_memory", "full_context", "flat_memory", "fixed_hierarchy", "ablation_backward"]  # presets without backward pass
ATTRIBUTES = ["segment", "nation"]
MAX_AGE = 10  # days; the test data spans a month
HALF_LIFE = 7  # days; held evidence weighs half as much after them
LINK_THRESHOLD = 0.5
HEALTH_DATES = [date(2024, 1, 9), date(2024, 1, 16), date(2024, 1, 23), LAST_DAY]
