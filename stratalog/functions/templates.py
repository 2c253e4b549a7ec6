"""Template functions as Columns: matching, correction, parameters, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WILD, let, tokens, wildcards

_META = r"([\\.\[\]{}()*+?^$|])"
MOST_WILDCARDS = 50


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _META, r"\\$1")


def pattern(template: Column) -> Column:
    """Anchored pattern of a template: literals are literal, a wildcard is anything but a
    line feed, also nothing."""
    return F.concat(F.lit("(?d)^"), F.replace(escaped(template), F.lit(r"<\*>"), F.lit(".*")), F.lit("$"))


def capturing(template: Column, spaces: bool = True) -> Column:
    """Pattern with a lazy group per wildcard; short ``<...>`` are wildcards, too."""
    t = escaped(F.regexp_replace(template, "<.{1,5}>", WILD))
    t = F.replace(t, F.lit(r"<\*>"), F.lit("(.*?)"))
    if spaces:
        t = F.regexp_replace(t, " +", r"\\s+")
    return F.concat(F.lit("(?d)^"), t, F.lit("$"))


def matches(text: Column, template: Column) -> Column:
    return F.rlike(text, pattern(template))


def ends_agree(text: Column, template: Column) -> Column:
    """A template's first and last token, where they hold no wildcard, equal the text's."""
    a, b = tokens(text), tokens(template)
    end = lambda k: F.coalesce(F.try_element_at(b, F.lit(k)).contains(WILD) | (F.try_element_at(a, F.lit(k)) == F.try_element_at(b, F.lit(k))), F.lit(False))
    return end(1) & end(-1)


def constants_within(text: Column, template: Column) -> Column:
    fixed = F.filter(tokens(template), lambda t: ~t.contains(WILD))
    return F.size(F.array_except(fixed, tokens(text))) == 0


# Parts what the groups of one match have caught; a character that Unicode leaves unassigned.
_BETWEEN = "\uffff"


def parameters(text: Column, template: Column) -> Column:
    """What each wildcard stands for; none if the text doesn't match. The text is replaced by
    its groups, as many as the template has, in one match. U+FFFF is no character of a text."""
    n = wildcards(F.regexp_replace(template, "<.{1,5}>", WILD))
    p = capturing(template)
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("$"), i.cast("string"))), _BETWEEN)
    got = F.split(F.regexp_replace(text, p, groups), _BETWEEN, -1)
    return F.when((n > 0) & F.rlike(text, p), got).otherwise(F.array().cast("array<string>"))


def diagnosis(text: Column, template: Column) -> Column:
    """``ok``, or the first literal piece that is wrong: ``start``, ``missing <piece>`` or ``trailing``."""
    pieces = F.split(F.replace(template, F.lit(WILD), F.lit("\x01")), "\x01", -1)
    found = lambda piece, s: F.when(piece == "", s["at"]).otherwise(F.position(piece, text, s["at"]))
    state = F.aggregate(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct((F.length(F.get(pieces, F.lit(0))) + 1).alias("at"), F.when(F.startswith(text, F.get(pieces, F.lit(0))), F.lit("")).otherwise("start").alias("why")),
        lambda s, piece: F.struct(
            F.when((s["why"] == "") & (found(piece, s) > 0), found(piece, s) + F.length(piece)).otherwise(s["at"]).alias("at"),
            F.when(s["why"] != "", s["why"]).when(found(piece, s) > 0, F.lit("")).otherwise(F.concat(F.lit("missing "), piece)).alias("why"),
        ),
    )
    return F.when(matches(text, template), "ok").when(state["why"] != "", state["why"]).otherwise("trailing")


def more_abstract(x: Column, y: Column) -> Column:
    """Template x matches template y if a wildcard is any run of non-space; null is not."""
    p = F.replace(escaped(x), F.lit(r"<\*>"), F.lit(r"(\S+?)"))
    p = F.concat(F.lit("^"), F.regexp_replace(p, " +", r"\\s+"), F.lit("$"))
    return F.coalesce(F.rlike(y, p), F.lit(False))


# Characters between which a template is cut into tokens for correction.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
PATH_DELIMITERS = "\\s,!;:=|\"'\\[\\](){}"
DELIMITERS = PATH_DELIMITERS + ".\\-+@#$%&"


def _joined(t: Column, mark: str) -> Column:
    """Wildcards chained by ``mark`` become one."""
    quoted = "".join("\\" + c for c in mark)
    return F.regexp_replace(t, rf"<\*>(?:{quoted}<\*>)+", WILD)


def _stable(t: Column, old: str, new: str) -> Column:
    """Replaced until nothing is left to replace. Every round takes a character at least, so the
    text's length bounds the rounds; texts without ``old`` have none."""
    rounds = lambda v: F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1)))
    swapped = lambda v: F.aggregate(rounds(v), v, lambda s, _: F.when(s.contains(old), F.replace(s, F.lit(old), F.lit(new))).otherwise(s))
    return let(t, lambda v: F.when(v.contains(old), swapped(v)).otherwise(v))


def _swap(t: Column, old: str, new: str, times: int = 1) -> Column:
    for _ in range(times):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def corrected(template: Column) -> Column:
    """The correction chain; the order of its rules matters."""
    t = F.trim(F.regexp_replace(template, SPACE_RUN, " "))
    parts = F.regexp_extract_all(t, F.lit(f"([^{DELIMITERS}]+|[{DELIMITERS}])"), F.lit(1))

    def token(x: Column) -> Column:
        x = F.when(x.rlike(r"^\p{Nd}+$"), WILD).otherwise(x)
        x = F.when(x.rlike("^0x[0-9a-fA-F]+"), WILD).otherwise(x)
        x = F.regexp_replace(x, r"(?:0x)+<\*>", WILD)
        return F.when(x.rlike(r"^[^\s/]+<\*>[^\s/]+$"), WILD).otherwise(x)

    t = F.array_join(F.transform(parts, token), "")
    t = F.regexp_replace(t, r"(<\*>)[^()\[\]{},.:<>#$/\"'\s]*", "$1")
    t = _joined(t, ".")
    t = _joined(t, "")
    t = F.regexp_replace(t, r" #<\*>#(?= )| #<\*>(?= )", " " + WILD)
    for mark in (":", "#", "/", "@", "."):
        t = _joined(t, mark)
    t = _stable(t, f'"{WILD}"', WILD)
    t = _stable(t, f"'{WILD}'", WILD)
    t = _joined(t, "")
    t = _swap(t, f"( {WILD}, {WILD})", f"({WILD}, {WILD})")
    t = _swap(t, "`", "")
    t = F.regexp_replace(t, r" <\*>[.,](?= )", " " + WILD)
    t = _joined(t, "+")
    t = _joined(t, "##")
    t = _stable(t, f"#{WILD}#", WILD)
    t = _joined(t, "-")
    t = F.regexp_replace(t, r"(?: <\*>){2,}(?= )", " " + WILD)
    t = F.regexp_replace(t, r"(?: <\*>){2,}$", " " + WILD)
    t = F.regexp_replace(t, r"^<\*> (?:<\*> )+", WILD + " ")
    t = _joined(t, ",")
    t = _swap(t, f"({WILD} {WILD})", f"({WILD})")
    t = F.regexp_replace(t, r" /<\*>(?= |$)", " " + WILD)
    many = lambda v: (F.length(v) - F.length(F.replace(v, F.lit("=<*>"), F.lit("")))) / 4 >= 3
    return let(t, lambda v: F.when(many(v), F.replace(v, F.lit("= "), F.lit("=<*> "))).otherwise(v))


def placeholders(template: Column) -> Column:
    """``{name}`` becomes a wildcard."""
    return F.regexp_replace(template, r"\{[A-Za-z0-9_\-]+\}", WILD)


def too_general(template: Column) -> Column:
    """Nothing but spaces and punctuation outside wildcards."""
    return F.regexp_replace(F.replace(template, F.lit(WILD), F.lit("")), r"[\s!-/:-@\[-`{-~]", "") == ""


def post_processed(template: Column) -> Column:
    """``struct(template, ok)``: placeholders, correction, and the rejection of templates that
    say nothing."""
    told = lambda t: let(too_general(t), lambda none: F.struct(F.when(none, "").otherwise(t).alias("template"), (~none).alias("ok")))
    return let(corrected(placeholders(template)), told)


def valid(template: Column) -> Column:
    return (template != "") & (wildcards(template) <= MOST_WILDCARDS)


# Words that the oracle corrector takes for parameters.
ORACLE_WORDS = ("true", "false", "null", "root", "admin")


def corrected_for_oracle(template: Column, words: tuple[str, ...] = ()) -> Column:
    """The smaller chain for ground-truth files: paths, digits, fixed words and ``words``,
    wildcards within tokens, and chains over ``.`` or nothing. A path is a piece between path
    delimiters that is names, each after a slash."""
    t = F.trim(F.regexp_replace(template, SPACE_RUN, " "))
    pieces = F.regexp_extract_all(t, F.lit(f"([^{PATH_DELIMITERS}]+|[{PATH_DELIMITERS}])"), F.lit(1))
    t = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^(/[^/]+)+$"), WILD).otherwise(x)), "")
    parts = F.regexp_extract_all(t, F.lit(f"([^{DELIMITERS}]+|[{DELIMITERS}])"), F.lit(1))
    fixed = [*ORACLE_WORDS, *(w.lower() for w in words)]

    def token(x: Column) -> Column:
        x = F.when(F.lower(x).isin(*fixed), WILD).otherwise(x)
        x = F.when(x.rlike(r"^\p{Nd}+$"), WILD).otherwise(x)
        return F.when(x.rlike(r"^[^\s/]*<\*>[^\s/]*$"), WILD).otherwise(x)

    t = F.array_join(F.transform(parts, token), "")
    return _joined(_joined(t, "."), "")


def mergeable(a: Column, b: Column) -> Column:
    """Token lists of one length that differ in at most one place, or in two of over ten."""
    d = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda v: v))
    return (F.size(a) == F.size(b)) & ((d <= 1) | ((d == 2) & (F.size(a) > 10)))


def merged(new: Column, known: Column) -> Column:
    """Two templates as one, or null: tokens that differ become a wildcard where one side is
    the wildcard, else the new token stays; both must match the result."""
    a, b = F.split(new, " "), F.split(known, " ")
    pair = F.zip_with(a, b, lambda x, y: F.when((x != y) & ((x == WILD) | (y == WILD)), WILD).otherwise(x))
    wild = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != y) & ((x == WILD) | (y == WILD))), lambda v: v))
    out = post_processed(F.array_join(pair, " "))["template"]
    fits = valid(out) & matches(new, out) & matches(known, out)
    return F.when(new == known, new).when((F.size(a) == F.size(b)) & (wild > 0) & mergeable(a, b) & fits, out)


def _differ(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda v: v))


def mergeable_simply(a: Column, b: Column) -> Column:
    """Token lists of one length with under a fifth of the places different."""
    return (F.size(a) == F.size(b)) & F.coalesce(F.try_divide(_differ(a, b), F.size(a)) < 0.2, F.lit(False))


def mergeable_by_distance(a: Column, b: Column, jaccard_over: float = 0.8, edits_up_to: float = 0.3) -> Column:
    """One edit apart, or Jaccard over 0.8, or both longer than ten with few edits for it."""
    from .text import edit_words, jaccard

    edits = edit_words(a, b)
    long = (F.size(a) > 10) & (F.size(b) > 10) & (edits / F.greatest(F.size(a), F.size(b)) <= edits_up_to)
    return F.coalesce((edits <= 1) | (jaccard(a, b) > jaccard_over) | long, F.lit(False))


# What the judges below take for letters.
LETTER, CAPITAL = "A-Za-z", "A-Z"


def _others(token: Column, known: str) -> Column:
    """Distinct characters of a token that aren't ``known``; a wildcard is one such character."""
    rest = F.regexp_replace(F.replace(token, F.lit(WILD), F.lit("\x00")), f"[{known}]", "")
    return F.array_distinct(F.filter(F.split(rest, ""), lambda c: c != ""))


def has_letters_only(token: Column) -> Column:
    return ~token.rlike(f"[^{LETTER}]")


def ends_in_colon(token: Column) -> Column:
    return token.endswith(":")


def is_bare_call(token: Column) -> Column:
    return token.endswith("()")


def brackets_wildcard(a: Column, b: Column) -> Column:
    """One token is the wildcard in brackets, and the other has both brackets."""
    return (a == f"({WILD})") & b.contains("(") & b.contains(")")


def both_vary_naively(a: Column, b: Column) -> Column:
    """Neither token consists of letters only."""
    return ~has_letters_only(a) & ~has_letters_only(b)


def looks_variable(token: Column) -> Column:
    """Whether a token may be a parameter's value. Capitals alone may; other letters alone may
    not, nor names with just dots or just underscores, labels, bare calls, or leaders."""
    odd = _others(token, LETTER)
    named = (F.size(odd) == 1) & (F.array_contains(odd, ".") | F.array_contains(odd, "_") | ends_in_colon(token))
    call = (F.size(odd) == 2) & is_bare_call(token)
    return (F.size(_others(token, CAPITAL)) == 0) | ((F.size(odd) > 0) & ~named & ~call & ~token.contains("....."))


def both_look_variable(a: Column, b: Column) -> Column:
    return looks_variable(a) & looks_variable(b)


def both_vary(a: Column, b: Column) -> Column:
    """The judgement on a pair: capitals alone vary together; else both need a character that is
    no letter, and mustn't be of one of the fixed shapes both at once, or hold leaders."""
    x, y = _others(a, LETTER), _others(b, LETTER)
    one = lambda mark: F.array_contains(x, mark) & F.array_contains(y, mark)
    alike = (F.size(x) == 1) & (F.size(y) == 1) & (one(".") | one("_") | (ends_in_colon(a) & ends_in_colon(b)))
    calls = (F.size(x) == 2) & (F.size(y) == 2) & is_bare_call(a) & is_bare_call(b)
    capitals = (F.size(_others(a, CAPITAL)) == 0) & (F.size(_others(b, CAPITAL)) == 0)
    return capitals | ((F.size(x) > 0) & (F.size(y) > 0) & ~alike & ~calls & ~a.contains(".....") & ~b.contains("....."))


def merged_variables(a: Column, b: Column) -> Column:
    """Two tokens that vary as one: characters that differ become wildcards, what the longer has
    more stays, wildcards in a row are one; null if they aren't to be merged."""
    mark = "\x00"
    x, y = (F.replace(t, F.lit(WILD), F.lit(mark)) for t in (a, b))
    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    pair = F.zip_with(letters(x), letters(y), lambda p, q: F.when(p.isNull() | q.isNull(), F.coalesce(p, q)).when(p == q, p).otherwise(F.lit(mark)))
    out = F.replace(F.regexp_replace(F.array_join(pair, ""), f"{mark}+", mark), F.lit(mark), F.lit(WILD))
    return F.when((a == WILD) | (b == WILD), F.lit(WILD)).when(both_vary(a, b), out)


def merged_token_lists(a: Column, b: Column) -> Column:
    """Two token lists as one: what they share at the start and at the end, up to a wildcard,
    around one wildcard. Null unless one of them has two wildcards; the wildcard alone wins."""
    def shared(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        stop = lambda i: (F.get(x, i) != F.get(y, i)) | (F.get(x, i) == WILD)
        at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i >= n) | stop(i))
        return F.coalesce(F.get(at, F.lit(0)), n)

    many = lambda t: F.size(F.filter(t, lambda w: w == WILD)) > 1
    wild = F.array(F.lit(WILD))

    def around(i: Column) -> Column:
        rest = lambda t: F.slice(t, i + 1, F.greatest(F.size(t) - i, F.lit(0)))
        j = shared(F.reverse(rest(a)), F.reverse(rest(b)))
        return let(j, lambda k: F.concat(F.slice(a, F.lit(1), i), wild, F.slice(a, F.size(a) - k + 1, k)))

    return F.when(~many(a) & ~many(b), F.lit(None)).when((a == wild) | (b == wild), wild).otherwise(let(shared(a, b), around))
