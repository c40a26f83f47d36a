"""Column functions over text: word counts, answer rules, labels, slugs, templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The hedging phrases that discard a response, in test order.
UNCERTAINTY_MARKERS = (
    "maybe",
    "possibly",
    "unclear",
    "might",
    "could be",
    "i'm not sure",
    "uncertain",
    "hard to say",
    "difficult to determine",
)
# Words that speak for and against the clause.  Every longer "no" phrase
# contains NO, so NO and ABSENT decide the same as the full list.
YES_WORDS = ("YES", "CONTAINS", "PRESENT", "FOUND")
NO_WORDS = ("NO", "ABSENT")

# Blanks are the Unicode blanks and the four information separators U+001C to U+001F.
BLANK = r"\s\x1c-\x1f"
WORD_PATTERN = rf"(?U)[^{BLANK}]+"

# The word limits of a response.
MAX_RESPONSE_WORDS = 750
MIN_RESPONSE_WORDS = 10


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def has_words(text: Column, n: int) -> Column:
    """Whether a text has at least ``n`` words; reads no further than the n-th."""
    return text.rlike(rf"(?U)^[{BLANK}]*+(?:[^{BLANK}]++[{BLANK}]++){{{n - 1}}}[^{BLANK}]")


def words(text: Column) -> Column:
    """The blank-separated words of a text, without empty edge items."""
    return F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"))


def flag_reason(response: Column, upper: Column, lower: Column, max_words: int = MAX_RESPONSE_WORDS) -> Column:
    """Why a response is discarded, or NULL when it is kept; the first rule that fits wins.

    ``upper`` and ``lower`` are the response in upper and lower case, made once by the caller.  A
    text of n words has at least 2n - 1 characters, so only longer texts are counted.
    """
    n_words = word_count(response)
    rule = F.when(
        (F.char_length(response) > 2 * max_words) & (n_words > max_words),
        F.concat(F.lit("too_long ("), n_words.cast("string"), F.lit(" words)")),
    ).when(~contains_any(upper, ("YES", "NO")), F.lit("missing_answer"))
    for marker in UNCERTAINTY_MARKERS:
        rule = rule.when(F.contains(lower, F.lit(marker)), F.lit(f"uncertainty ({marker})"))
    return rule.when(~has_words(response, MIN_RESPONSE_WORDS), F.lit("too_short"))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(part)) for part in parts])


def parse_answer(upper: Column) -> Column:
    """YES, NO, or NULL when the upper-case response says both or neither."""
    yes, no = contains_any(upper, YES_WORDS), contains_any(upper, NO_WORDS)
    return F.when(yes & ~no, F.lit("YES")).when(no & ~yes, F.lit("NO"))


def truthy(value: Column, data_type: T.DataType) -> Column:
    """TRUE unless the value is null, false, zero, an empty text or an empty collection."""
    if isinstance(data_type, T.BooleanType):
        test = value
    elif isinstance(data_type, T.NumericType):
        test = value != 0
    elif isinstance(data_type, T.StringType):
        test = value != ""
    elif isinstance(data_type, (T.ArrayType, T.MapType)):
        test = F.size(value) > 0
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def yes_no(value: Column, data_type: T.DataType) -> Column:
    return F.when(truthy(value, data_type), F.lit("YES")).otherwise(F.lit("NO"))


def slug(text: Column) -> Column:
    """Lower case; letters, digits, '-' and '_' stay, all else becomes '-'; outer '-' go."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_-]", "-"), r"^-+|-+$", ""
    )


def clause_prompt(text: Column, category: Column, max_chars: int | None = None) -> Column:
    """The question put to a reviewer about one clause, with the whole text unless ``max_chars`` cuts it."""
    # The wording of the question.
    return F.concat(
        F.lit("Given this contract text, does it contain a "),
        category,
        F.lit(" clause?\n\nContract:\n"),
        text if max_chars is None else F.substring(text, 1, max_chars),
        F.lit(
            "\n\nInstructions:\n- Answer YES or NO\n- Provide a brief explanation citing specific"
            " contract text\n- Be concise (under 200 words)\n\nAnswer:"
        ),
    )


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Replace each ``{{key}}`` of a template by the value of its column."""
    out: Column = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(value, F.lit("")))
    return out


def show_value(value: Column, data_type: T.DataType, cut: int | None = None) -> Column:
    """Floats with four decimals; anything else as text, cut to ``cut`` characters if given."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), F.format_string("%.4f", value.cast("double")))
    text = value.cast("string")
    return F.substring(text, 1, cut) if cut else text


def markdown_table(entries: Column, empty: str, left: str = "Key", right: str = "Value") -> Column:
    """A two-column table from an array of (key, text) structs, sorted by key."""
    head = f"| {left} | {right} |\n|-----|-------|\n"
    rows = F.transform(
        F.array_sort(entries),
        lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), e["text"], F.lit(" |")),
    )
    return F.when(F.coalesce(F.size(entries), F.lit(0)) <= 0, F.lit(empty)).otherwise(
        F.concat(F.lit(head), F.array_join(rows, "\n"))
    )


def web_url(remote: Column) -> Column:
    """The web address of a code remote, given in SSH or https form."""
    return F.regexp_replace(
        F.regexp_replace(remote, r"^git@([^:]+):(.*)$", "https://$1/$2"), r"\.git$", ""
    )


def duration_seconds(text: Column) -> Column:
    """Seconds in a duration such as 7d, 24h or 30m; any other form is an error."""
    amount = F.regexp_extract(text, r"^\s*([+-]?\d+)[dhmDHM]$", 1)
    unit = F.lower(F.substring(text, -1, 1))
    factor = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60)
    return F.when(amount != "", amount.cast("long") * factor).otherwise(
        F.raise_error(F.concat(F.lit("unknown duration: "), text))
    )


# What an image name and a tag may look like.
IMAGE_PART = r"^[a-z0-9][a-z0-9._/-]{0,127}\z"
TAG = r"^[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}\z"


def valid_image_part(name: Column) -> Column:
    return name.rlike(IMAGE_PART)


def valid_tag(tag: Column) -> Column:
    return tag.rlike(TAG)
