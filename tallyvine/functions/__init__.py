from tallyvine.functions.comparison import as_text, compare, follows, known, parse_literal, precedes
from tallyvine.functions.measures import mean, percentage, total, two_decimals

__all__ = ["as_text", "compare", "follows", "known", "mean", "parse_literal", "percentage", "precedes", "total", "two_decimals"]
