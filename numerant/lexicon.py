"""Words, units, scales, currencies and patterns that decide what a figure is."""

# Words and their meaning.
DERIVED_WORDS = ["margin", "growth", "cagr", "ratio", "rate", "difference", "change", "increase", "decrease", "sum", "gap", "variance"]
NEGATIVE_WORDS = ["decline", "declined", "decrease", "decreased", "fell", "fall", "loss", "negative", "down", "lower", "minus", "reduction", "reduced", "drop", "dropped"]
POSITIVE_WORDS = ["rose", "rise", "grew", "grow", "up", "increase", "increased", "higher", "gain", "gained"]
LEVEL_WORDS = ["loss", "negative", "minus", "lower", "higher"]  # they say a sign, but not that the figure is a change
CHANGE_NOUNS = ["increase", "decrease", "rise", "fall", "decline", "drop", "reduction", "growth", "change", "difference"]
MEASURE_WORDS = ["points", "point", "pp", "bps", "percent", "per"]
STOP_WORDS = ["the", "and", "for", "from", "with", "was", "were", "this", "that", "year", "years", "its", "their", "which", "are", "has", "have", "had", "total", "all", "per", "not", "but", "also", "into", "over", "than"]

# Powers of ten by scale word, currencies by symbol, units by spelling.
SCALES = {"k": 3, "thousand": 3, "m": 6, "mn": 6, "mm": 6, "mln": 6, "million": 6, "b": 9, "bn": 9, "bln": 9, "billion": 9, "tn": 12, "trn": 12, "trillion": 12}
CURRENCIES = {"£": "GBP", "$": "USD", "us$": "USD", "€": "EUR"}
CODES = ["GBP", "EUR", "USD", "CHF", "JPY", "SEK", "NOK", "DKK"]
UNITS = {
    "%": "%", "percent": "%", "per cent": "%", "percentage point": "pp", "percentage points": "pp", "pp": "pp", "ppt": "pp", "ppts": "pp", "pts": "pp", "bp": "bps", "bps": "bps",
    "x": "x", "×": "x", "p": "p", "pence": "p", "c": "c", "cent": "c", "cents": "c", "¢": "c", "kg": "kg", "kgs": "kg", "t": "t", "teu": "TEU", "m3": "m3", "m2": "m2", "pcs": "pcs",
}
PERCENT_UNITS = ["%", "pp", "bps"]
PERCENT_WORDS = ["%", "pct", "percent"]
RESULT_UNITS = {"x": "multiples (x)", "p": "pence", "c": "cents", "kg": "kilograms", "t": "tonnes", "TEU": "TEU", "m3": "cubic metres", "m2": "square metres", "pcs": "pieces", "pp": "percentage points"}
SYMBOLS = {"GBP": "£", "USD": "$", "EUR": "€"}
HEADER_SCALES = {"m": 6, "mn": 6, "million": 6, "millions": 6, "bn": 9, "billion": 9, "billions": 9, "k": 3, "thousand": 3, "thousands": 3, "'000": 3, "'000s": 3, "000s": 3}

# Patterns.
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
LOOSE_NUMBER = r"\d[\d,]*(?:\.\d+)?"
WORD = r"[a-z][a-z&'-]+"
CITATION_ID = r"(?:D\d+:p\d+:[bc]\d+|D\d+:s\d+:[A-Z]{1,3}\d+|[CWL]\d+)"
SKIPPED_TAGS = ["script", "style", "nav", "header", "footer", "noscript", "svg", "form"]
BLOCK_TAGS = ["p", "li", "td", "th", "h1", "h2", "h3", "h4", "div", "tr", "br", "section", "article"]

# Lines that state a unit for what follows, and page numbers in running heads.
UNIT_LINE = r"(?i)(?:GBP|USD|EUR|CHF|£|\$|€)\s?(?:m|bn|k|million|billion|thousand)s?\b|\bin (?:millions|billions|thousands)\b"
PAGE_HEADS = [r"^\s*(\d{1,4})\s+\S[^|\n]{2,120}\|", r"\|[^|\n]*?\s(\d{1,4})\s*$"]
BARE_PAGE = r"^[\s<>|]*(\d{1,4})[\s<>|]*$"

# Markup in texts that were read from pages.
FOOTNOTE_MARKS = [r"\$\s*\{\s*\}\s*\^\{[^}]*\}\s*\$", r"\^\{[^}]*\}"]
INLINE_FORMULA = r"\$([^$\n]*\\[^$\n]*)\$"
