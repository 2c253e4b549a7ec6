"""Scalar text functions as Columns: tokens, masks, similarities, splits.

Everything stays in the JVM. White space is what Python's ``str.split`` takes for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "<*>"
SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """White-space tokens; none for a blank text."""
    return F.array_remove(F.split(text, SPACE), "")


def tokens_at(text: Column, separators: str) -> Column:
    """Tokens after every separator character has become a space."""
    return tokens(F.translate(text, separators, " " * len(separators)))


def mask(text: Column, patterns: Iterable[str]) -> Column:
    """Every match of each pattern, in order, becomes a wildcard."""
    for p in patterns:
        text = F.regexp_replace(text, F.lit(p), F.lit(WILD))
    return text


def mask_quoted(text: Column) -> Column:
    """Text between backticks, then between a backtick and an apostrophe, becomes ``{variable}``."""
    text = F.regexp_replace(text, "`[^`]*`", "{variable}")
    return F.regexp_replace(text, "`[^']*'", "{variable}")


def mask_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", "<N/ASCII>")


# Whole-string shapes of common parameters.
COMMON_PARAMETERS = (
    r"^(https?:\/\/)?([a-z0-9]+([\-\.]{1}[a-z0-9]+)*\.[a-z]{2,5})(:[0-9]{1,5})?(\/.*)?$",
    r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    r"^(1[0-2]|0?[1-9]):[0-5][0-9] (AM|PM)$",
    r"^\+?[1-9]\d{1,14}$",
    r"^(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$",
)


def mask_common(text: Column) -> Column:
    return mask(text, COMMON_PARAMETERS)


def wildcards(text: Column) -> Column:
    """Literal wildcards in a template."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(WILD), F.lit("")))) / len(WILD)).cast("int")


def angle_count(text: Column) -> Column:
    """Closing angle brackets: how the compatible complexity filter counts wildcards."""
    return F.length(text) - F.length(F.replace(text, F.lit(">"), F.lit("")))


def variable_looking(text: Column) -> Column:
    """Anything but letters, spaces and ``!`` outside wildcards."""
    return F.replace(text, F.lit(WILD), F.lit("")).rlike("[^ A-Za-z!]")


def sample_size(text: Column, most: int) -> Column:
    """Short plain logs need one sample, others the most."""
    return F.when(variable_looking(text), most).when(F.size(tokens(text)) <= 5, 1).otherwise(most)


def jaccard(a: Column, b: Column) -> Column:
    """Of word sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_smoothed(a: Column, b: Column) -> Column:
    return (F.size(F.array_intersect(a, b)) + 1e-5) / (F.size(F.array_union(a, b)) + 1e-5)


def jaccard_weighted(a: Column, b: Column, scale: int = 20) -> Column:
    product = F.size(a) * F.size(b) / F.lit(float(scale * scale))
    return jaccard(a, b) * product * product


def bad_word(word: Column) -> Column:
    """A word with an ASCII letter, a digit and a symbol. Letters and digits of any script and
    the underscore are no symbols."""
    return word.rlike(r"\p{Nd}") & word.rlike("[A-Za-z]") & word.rlike(r"[^\p{L}\p{N}_]")


def good_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~bad_word(w))


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def hamming_words(a: Column, b: Column) -> Column:
    """Places at which equally long token lists differ; null if lengths differ."""
    differs = F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda v: v)
    return F.when(F.size(a) == F.size(b), F.size(differs))


def word_letters(words: Column, alphabet: Column) -> Column:
    """Words as one string with a code point from U+10000 on for each distinct word of
    ``alphabet``, which leaves room for a million of them."""
    point = lambda w: F.lpad(F.hex(F.array_position(alphabet, w) + 65535), 8, "0")
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(point(w)), "UTF-32")), "")


def edit_words(a: Column, b: Column) -> Column:
    """Levenshtein distance on words, by way of one letter per distinct word."""
    both = F.array_union(a, b)
    return F.levenshtein(word_letters(a, both), word_letters(b, both))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.size(same))


def common_suffix(a: Column, b: Column) -> Column:
    return F.reverse(common_prefix(F.reverse(a), F.reverse(b)))


# Separators of template comparison besides white space, and those that stay.
SPLITTERS = "!\"#$%&'()+,-/:;=?@.[\\]^_`{|}~"
STAYING = "=|()"
_CLASS = "".join("\\" + c for c in SPLITTERS)
_GONE = "".join("\\" + c for c in SPLITTERS if c not in STAYING)


def split_message(text: Column) -> Column:
    """Tokens with their separators for template comparison: runs of white space and punctuation
    separate and are tokens themselves; tokens with a wildcard are the wildcard; punctuation
    but ``= | ( )`` goes; neighbouring wildcards are one."""
    parts = F.regexp_extract_all(text, F.lit(rf"([^\s{_CLASS}]+|[\s{_CLASS}]+)"), F.lit(1))
    parts = F.transform(parts, lambda t: F.when(t.contains(WILD), WILD).otherwise(F.regexp_replace(t, rf"[\s{_GONE}]", "")))
    return _merge_wild(F.array_remove(parts, ""))


def split_message_singly(text: Column) -> Column:
    """The same with every separator as a token of its own, so that of a run of separators those
    that stay are tokens each."""
    parts = F.regexp_extract_all(text, F.lit(rf"([^\s{_CLASS}]+|[\s{_CLASS}])"), F.lit(1))
    parts = F.transform(parts, lambda t: F.when(t.contains(WILD), WILD).otherwise(F.regexp_replace(t, rf"[\s{_GONE}]", "")))
    return _merge_wild(F.array_remove(parts, ""))


def template_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens less the shared, on message splits."""
    x, y = split_message(a), split_message(b)
    both = F.size(F.array_intersect(x, y))
    return F.try_divide(both, F.size(x) + F.size(y) - both)


def replace_hex(text: Column) -> Column:
    return F.regexp_replace(text, "0x[0-9a-fA-F]+", WILD)


def padded(items: Column, n: int) -> Column:
    """A list repeated from its start until it has n items; an empty list stays empty."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.when(F.size(items) == 0, items).when(F.size(items) >= n, F.slice(items, 1, n)).otherwise(F.transform(at, lambda i: F.get(items, i % F.size(items))))


def spread_score(similarities: Column, weight: float = 0.5) -> Column:
    """weight times the mean similarity plus the rest times the mean absolute difference of all
    pairs of them; 0 for none."""
    n = F.size(similarities)
    total = F.aggregate(similarities, F.lit(0.0), lambda a, x: a + x)
    apart = F.aggregate(similarities, F.lit(0.0), lambda a, x: a + F.aggregate(similarities, F.lit(0.0), lambda c, y: c + F.abs(x - y)))
    return F.when(n == 0, 0.0).otherwise(weight * total / n + (1 - weight) * apart / (n * n))


def spread_score_from_first(logs: Column, weight: float = 0.5) -> Column:
    """weight times the mean similarity to the first text plus the rest times the mean absolute
    difference of all pairs' similarities; 0 for fewer than two texts."""
    first, every = similarities(logs, True), similarities(logs)
    mean = F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / F.size(first)
    return F.when(F.size(logs) < 2, 0.0).otherwise(weight * mean + spread_score(every, 0.0) * (1 - weight))


def similarity_matrix(logs: Column) -> Column:
    """Word Jaccard of every text with every other as rows; 1 on the diagonal."""
    at = F.transform(logs, lambda x: tokens(x))
    return F.transform(at, lambda x, i: F.transform(at, lambda y, j: F.when(i == j, 1.0).otherwise(F.coalesce(jaccard(x, y), F.lit(0.0)))))


def similarities(logs: Column, first_only: bool = False) -> Column:
    """Word Jaccard of the first text with each other one, or of all pairs in order."""
    at = F.sequence(F.lit(0), F.size(logs) - 1)
    upto = F.lit(1) if first_only else F.size(logs)
    rows = F.transform(F.slice(at, 1, upto), lambda i: F.transform(F.slice(logs, i + 2, F.size(logs)), lambda y: F.coalesce(jaccard(tokens(F.get(logs, i)), tokens(y)), F.lit(0.0))))
    return F.when(F.size(logs) < 2, F.array().cast("array<double>")).otherwise(F.flatten(rows))


def _merge_wild(parts: Column) -> Column:
    kept = F.transform(parts, lambda t, i: F.when((t == WILD) & (F.coalesce(F.get(parts, i - 1), F.lit("")) == WILD), F.lit(None)).otherwise(t))
    return F.array_compact(kept)
